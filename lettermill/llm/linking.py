"""From inverted lists to components, for joins whose links must not be lost.

Input are records (list, sig, n): ``sig`` names an element, ``n`` is its size, and any two elements
that link stand in one list at least. Lists of up to ``SHORT`` members name their pairs whose sizes
fit; longer ones tie their members to the first one. A caller's ``refine`` may drop pairs, and split long lists, that
cannot link. What is tied together, by whole chains, is a cluster: no link leaves it.
Clusters are searched whole, one after the other in a task, as long as they stay within ``CLUSTER``
elements and ``CLUSTER_SIZE`` summed sizes.

Larger clusters whose lists name no fewer pairs than they have elements squared are dealt into parts, and every two parts are searched
together, up to ``MOST_PARTS``. The others keep to their lists: each list tries its members against a few pivots, four times
as many each round, and only members of components that are still different, until every pair of a list is tested
or joined. So a list is not expanded into all its pairs while its members are linked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .packed import by_bucket
from .stage import bucket_count, stage

POSTING = {"list": "<u8", "sig": "<i8", "n": "<u4"}
ROUND = "u long, v long, list long, n long, pair boolean, long boolean"
SHORT = 12
CLUSTER, CLUSTER_SIZE = 4096, 4_000_000
PIVOT_GROWTH = 4
MEMBERS = 256
MOST_PARTS = 64

Fits = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Root (an index) of each element of a cluster, from their texts.
Search = Callable[[pa.Array], list[int]]
#: Members that link with the first text.
Block = Callable[[pa.Array], list[int]]


def _state(pairs: np.ndarray, list_: np.ndarray, sig: np.ndarray, n: np.ndarray, long: np.ndarray | None = None, pivot: np.ndarray | None = None) -> pa.Table:
    p, m = len(pairs), len(sig)
    return pa.table(
        {
            "u": pa.array(np.append(pairs[:, 0], np.zeros(m, np.int64) if pivot is None else pivot), pa.int64()),
            "v": pa.array(np.append(pairs[:, 1], sig), pa.int64()),
            "list": pa.array(np.append(np.zeros(p, np.int64), list_), pa.int64()),
            "n": pa.array(np.append(np.zeros(p, np.int64), n), pa.int64()),
            "pair": pa.array(np.arange(p + m) < p, pa.bool_()),
            "long": pa.array(np.append(np.zeros(p, bool), np.zeros(m, bool) if long is None else long), pa.bool_()),
        }
    )


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)


def _first(fits: Fits):
    """Pairs of the short lists; the members v of all lists of more than one, u being the list's first one."""

    def work(columns: list[np.ndarray]) -> pa.Table:
        list_, sig, n = columns
        order = np.lexsort((sig, list_))
        list_, sig, n = list_[order], sig[order], n[order].astype(np.int64)
        new = np.ones(len(sig), bool)
        new[1:] = (list_[1:] != list_[:-1]) | (sig[1:] != sig[:-1])
        list_, sig, n = list_[new], sig[new], n[new]
        head = np.ones(len(sig), bool)
        head[1:] = list_[1:] != list_[:-1]
        begins = np.flatnonzero(head)
        size = np.diff(np.append(begins, len(sig)))
        size_of = np.repeat(size, size)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for apart in range(1, min(SHORT, len(sig))):
            left = np.flatnonzero(size_of[: len(sig) - apart] <= SHORT)
            left = left[list_[left] == list_[left + apart]]
            left = left[fits(n[left], n[left + apart])]
            us.append(sig[left])
            vs.append(sig[left + apart])
        more = size_of > 1
        return _state(_distinct_pairs(np.concatenate(us), np.concatenate(vs)), list_[more].view(np.int64), sig[more], n[more], size_of[more] > SHORT, np.repeat(sig[begins], size)[more])

    return work


def tie_all(state: DataFrame) -> DataFrame:
    """The pairs of the short lists, and the members of the long ones tied to the first."""
    return state.where("pair or (long and u <> v)").select("u", "v")


def _later(fits: Fits, tried: int, pivots: int):
    """For each list of several components, pairs of the next pivots with members of other components."""

    def work(table: pa.Table) -> pa.Table:
        list_, sig, n, comp = (table[c].to_numpy() for c in ("list", "sig", "n", "comp"))
        order = np.lexsort((sig, list_))
        list_, sig, n, comp = list_[order], sig[order], n[order], comp[order]
        head = np.ones(len(sig), bool)
        head[1:] = list_[1:] != list_[:-1]
        begins = np.flatnonzero(head)
        size = np.diff(np.append(begins, len(sig)))
        several = np.minimum.reduceat(comp, begins) != np.maximum.reduceat(comp, begins)
        us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for j in range(tried, pivots):
            open_ = np.flatnonzero(several & (size > j))
            if not len(open_):
                break
            lengths = size[open_]
            pivot = np.repeat(begins[open_] + j, lengths)
            member = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(begins[open_], lengths)
            ok = (comp[pivot] != comp[member]) & fits(n[pivot], n[member])
            us.append(sig[pivot[ok]])
            vs.append(sig[member[ok]])
        more = np.repeat(several & (size > pivots), size)
        return _state(_distinct_pairs(np.concatenate(us), np.concatenate(vs)), list_[more], sig[more], n[more])

    return work


def _whole_clusters(search: Search):
    """(sig, component) of elements that come sorted by cluster, one row for each element at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sigs, texts = None, [], []

        def close() -> pa.RecordBatch:
            roots = search(pa.array(texts, pa.large_string())) if len(sigs) > 1 else [0] * len(sigs)
            least: dict[int, int] = {}
            for s, r in zip(sigs, roots, strict=True):
                least[r] = min(least.get(r, s), s)
            return pa.RecordBatch.from_arrays([pa.array(sigs, pa.int64()), pa.array([least[r] for r in roots], pa.int64())], ["node", "component"])

        for batch in batches:
            for cluster, sig, text in zip(*(batch.column(c).to_pylist() for c in ("cluster", "sig", "text")), strict=True):
                if cluster != at:
                    yield close()
                    at, sigs, texts = cluster, [], []
                if not sigs or sig != sigs[-1]:  # rows equal in id and text come again
                    sigs.append(sig)
                    texts.append(text)
        yield close()

    return run


def _blocks(block_search: Block):
    """Links (u, v) of each query with the members of its block; rows come sorted by (u, block), the query first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, vs, texts = None, [], []

        def close() -> pa.RecordBatch:
            linked = [i for i in block_search(pa.array(texts, pa.large_string())) if i > 0] if len(vs) > 1 and vs[0] == at[0] else []
            return pa.RecordBatch.from_arrays([pa.array([at[0]] * len(linked) if at else [], pa.int64()), pa.array([vs[i] for i in linked], pa.int64())], ["u", "v"])

        for batch in batches:
            for u, block, v, text in zip(*(batch.column(c).to_pylist() for c in ("u", "block", "v", "text")), strict=True):
                if (u, block) != at:
                    yield close()
                    at, vs, texts = (u, block), [], []
                if not vs or v != vs[-1]:
                    vs.append(v)
                    texts.append(text)
        yield close()

    return run


def _linked_pairs(pairs: DataFrame, with_text: Callable[[DataFrame], DataFrame], block_search: Block) -> DataFrame:
    counts = pairs.groupBy("u").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("parts"))
    blocks = pairs.join(counts, "u").select("u", F.expr("pmod(hash(v), parts)").alias("block"), F.col("v").alias("sig"))
    queries = blocks.select("u", "block", F.col("u").alias("sig")).distinct()
    texts = with_text(blocks.unionByName(queries)).withColumnRenamed("sig", "v")
    spread = texts.repartition(bucket_count(pairs.sparkSession, 1), "u", "block")
    return spread.sortWithinPartitions("u", "block", F.col("u") != F.col("v"), "v").select("u", "block", "v", "text").mapInArrow(_blocks(block_search), "u long, v long").distinct()


def _merge_components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Components after further links between their nodes."""
    a, b = nodes.select(F.col("node").alias("u"), F.col("component").alias("cu")), nodes.select(F.col("node").alias("v"), F.col("component").alias("cv"))
    between = links.join(a, "u").join(b, "v").where("cu <> cv").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
    merged = connected_components(between).select(F.col("node").alias("component"), F.col("component").alias("merged"))
    return stage(nodes.join(merged, "component", "left").select("node", F.coalesce("merged", "component").alias("component")), "components")


def _gathered(placed: DataFrame, with_text: Callable[[DataFrame], DataFrame], search: Search) -> DataFrame:
    """(node, component) of the elements of each cluster, searched whole."""
    texts = with_text(placed).repartition(bucket_count(placed.sparkSession, 1), "cluster").sortWithinPartitions("cluster", "sig")
    return texts.select("cluster", "sig", "text").mapInArrow(_whole_clusters(search), "node long, component long")


def _by_parts(member: DataFrame, parts: DataFrame, with_text: Callable[[DataFrame], DataFrame], search: Search) -> DataFrame:
    """(node, component) of the elements of clusters that are dealt into ``parts``; every pair of elements meets in the search of two parts."""
    dealt = member.join(parts, "cluster").withColumn("part", F.expr("pmod(hash(sig), parts)"))
    placed = dealt.withColumn("other", F.expr("explode(sequence(0, parts - 1))")).where("part <> other")
    placed = placed.select("sig", F.xxhash64("cluster", F.least("part", "other"), F.greatest("part", "other")).alias("cluster"))
    links = _gathered(placed, with_text, search).where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
    linked = connected_components(links)
    return member.join(parts, "cluster", "left_semi").select(F.col("sig").alias("node")).join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def components(packed: DataFrame, with_text: Callable[[DataFrame], DataFrame], fits: Fits, search: Search, block_search: Block, refine: Callable[[DataFrame], DataFrame] = tie_all, cluster: int = CLUSTER, cluster_size: int = CLUSTER_SIZE) -> DataFrame:
    """(node, component) of every element that shares a list with another one.

    ``packed`` holds POSTING records; ``with_text`` adds a column text to a table that has a column sig;
    ``fits`` says from two sizes whether elements can link at all; ``refine`` makes ties (u, v) of the lists.
    """
    spark = packed.sparkSession
    state = stage(by_bucket(packed, POSTING, _first(fits), ROUND), "lists")
    tied = connected_components(refine(state))
    sizes = state.where("not pair").groupBy(F.col("v").alias("node")).agg(F.max("n").alias("n"))
    member = tied.join(sizes, "node").select(F.col("node").alias("sig"), F.col("component").alias("cluster"), "n")
    member = stage(member, "members")
    large = stage(member.groupBy("cluster").agg(F.count("*").alias("elements"), F.sum("n").alias("total")).where(f"elements > {cluster} or total > {cluster_size}"), "large")
    found = stage(_gathered(member.join(large, "cluster", "left_anti").select("sig", "cluster"), with_text, search), "components")
    if large.isEmpty():
        return found
    whole = member.join(large, "cluster", "left_semi").select("cluster", "sig")
    held = state.where("not pair").select("list", F.col("v").alias("sig")).join(whole, "sig").groupBy("cluster", "list").agg(F.count("*").alias("held"))
    dense = held.groupBy("cluster").agg(F.sum(F.col("held") * F.col("held")).alias("named")).join(large, "cluster").where("named >= elements * elements")
    parts = dense.select("cluster", F.expr(f"cast(ceil(2 * greatest(elements / {cluster}, total / {cluster_size})) as int)").alias("parts"))
    parts = stage(parts.where(f"parts <= {MOST_PARTS}"), "parts")
    if not parts.isEmpty():
        found = stage(found.unionByName(_by_parts(member, parts, with_text, search)), "components")
    inside = stage(whole.join(parts, "cluster", "left_anti").select("sig"), "inside")
    lists = state.where("not pair").select("list", F.col("v").alias("sig"), "n").join(inside, "sig", "left_semi")
    nodes = inside.select(F.col("sig").alias("node"), F.col("sig").alias("component"))
    tested: DataFrame | None = None
    tried, pivots, buckets = 0, 1, bucket_count(spark)
    while not lists.isEmpty():
        known = lists.join(nodes.select(F.col("node").alias("sig"), F.col("component").alias("comp")), "sig").select("list", "sig", "n", "comp")
        state = stage(known.withColumn("bucket", F.expr(f"pmod(xxhash64(list), {buckets})")).groupBy("bucket").applyInArrow(_later(fits, tried, pivots), ROUND), "lists")
        pairs = state.where("pair").select("u", "v").distinct()
        pairs = stage(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            links = stage(_linked_pairs(pairs, with_text, block_search), "links")
            tested = pairs if tested is None else tested.unionByName(pairs)
            nodes = _merge_components(nodes, links)
        lists = state.where("not pair").select("list", F.col("v").alias("sig"), "n")
        tried, pivots = pivots, pivots * PIVOT_GROWTH
    return found.unionByName(nodes)


class Union:
    """Union-find over range(n)."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return int(i)

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.parent[max(i, j)] = min(i, j)

    def roots(self) -> np.ndarray:
        """All roots at once."""
        while (up := self.parent[self.parent]).tobytes() != self.parent.tobytes():
            self.parent = up
        return self.parent
