"""Conversation threads.

Messages are nodes; a message's references, then the message it replies to, then itself make a chain of parents
and children. Links are made in mailbox order and the last one that closes no circle wins, so the result depends on order;
but a link never leaves a connected component of the chains. Components are found with DataFrame rounds,
each is linked exactly in one group, and threads are then grouped by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_id, normalize_subject
from ..stage import stage
from .components import connected_components
from .ordering import ranked

MAX_ANCESTORS = 100
LINKED = "sequence long, depth int, thread_key string, is_root boolean"
_LINKED = pa.schema([("sequence", pa.int64()), ("depth", pa.int32()), ("thread_key", pa.string()), ("is_root", pa.bool_())])


def link_component(rows: list[dict]) -> list[tuple]:
    """(sequence, depth, thread key, is root) of each message of one component; ``rows`` come by sequence."""
    message = {row["node"]: i for i, row in enumerate(rows)}
    parent: dict[str, str] = {}
    children: dict[str, list[str]] = {}

    def closes_circle(child: str, above: str) -> bool:
        for _ in range(MAX_ANCESTORS + 1):
            if above == child:
                return True
            if above not in parent:
                return False
            above = parent[above]
        return True

    for row in rows:
        chain = row["chain"]
        for above, child in zip(chain[:-1], chain[1:], strict=True):
            if above == child or closes_circle(child, above):
                continue
            if child in parent:
                children[parent[child]].remove(child)
            parent[child] = above
            children.setdefault(above, []).append(child)

    def top(node: str) -> tuple[str, int]:
        depth = 0
        while node in parent:
            node = parent[node]
            depth += node in message
        return node, depth

    def key_of(root: str) -> str:
        # a placeholder is judged by its first child that is a message
        speaker = root if root in message else next((c for c in children.get(root, []) if c in message), None)
        if speaker is None:
            return ""
        row = rows[message[speaker]]
        return row["thread_id"] or row["norm_subject"] or ""

    keys: dict[str, str] = {}
    out = []
    for node, i in message.items():
        root, depth = top(node)
        if root not in keys:
            keys[root] = key_of(root)
        out.append((rows[i]["sequence"], depth, keys[root], node == root))
    return out


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components one after the other; rows come sorted by component and sequence."""
    at, held = None, []
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _LINKED.types, strict=True)], schema=_LINKED)

    for batch in batches:
        for row in batch.to_pylist():
            if row["component"] != at:
                out += link_component(held)
                at, held = row["component"], []
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
            held.append(row)
    out += link_component(held)
    if out:
        yield batch_of(out)


def thread_nodes(messages: DataFrame) -> DataFrame:
    """(sequence, thread_key, depth, is_root, date): every message with its thread."""
    base = messages.select("sequence", "date", "thread_id", normalize_id(F.coalesce("message_id", F.lit(""))).alias("id"), normalize_subject(F.coalesce("subject", F.lit(""))).alias("norm_subject"), "references", "in_reply_to")
    # the first message of an id has it, by an aggregation and not by a window that a frequent id would fill
    named = base.where("id <> ''")
    firsts = named.groupBy("id").agg(F.min("sequence").alias("claimed"))
    named = named.join(firsts, "id").withColumn("node", F.when(F.col("sequence") == F.col("claimed"), F.col("id")).otherwise(F.concat(F.lit("__dup_"), F.col("sequence").cast("string"), F.lit("__")))).drop("claimed").select(*base.columns, "node")
    alone = base.where("id = ''").withColumn("node", F.concat(F.lit("__synth_"), F.col("sequence").cast("string"), F.lit("__")))
    refs = F.filter(F.transform(F.coalesce("references", F.array().cast("array<string>")), normalize_id), lambda x: x != "")
    reply = normalize_id(F.coalesce("in_reply_to", F.lit("")))
    chain = F.when((reply != "") & ~F.array_contains(refs, reply), F.array_append(refs, reply)).otherwise(refs)
    chained = named.withColumn("chain", F.array_append(chain, F.col("node"))).unionByName(alone.withColumn("chain", F.array("node")))
    chained = stage(chained.select("sequence", "date", "thread_id", "norm_subject", "node", "chain"), "chains")
    pairs = F.transform(F.sequence(F.lit(0), F.size("chain") - 2), lambda i: F.struct(F.get("chain", i).alias("u"), F.get("chain", i + 1).alias("v")))
    links = chained.where("size(chain) > 1").select(F.explode(pairs).alias("e")).select("e.*")
    components = connected_components(links)
    placed = chained.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    # a message by itself needs no Python
    sizes = placed.groupBy("component").agg(F.count("*").alias("members"))
    sized = stage(placed.join(sizes, "component"), "placed")
    single = sized.where("members = 1 and size(chain) <= 2").select("sequence", F.lit(0).alias("depth"), F.coalesce(F.nullif("thread_id", F.lit("")), "norm_subject").alias("thread_key"), (F.size("chain") == 1).alias("is_root"))
    gathered = sized.where("members > 1 or size(chain) > 2").select("component", "sequence", "node", "chain", "thread_id", "norm_subject").repartition("component").sortWithinPartitions("component", "sequence")
    nodes = single.unionByName(gathered.mapInArrow(_link, LINKED))
    return stage(nodes.join(chained.select("sequence", "date"), "sequence"), "threads")


def with_positions(nodes: DataFrame) -> DataFrame:
    """``position``: a message's place by date in its thread, from 0. It comes from ranks in one range sort, so a subject that many messages share is not sorted in one task."""
    placed = stage(ranked(nodes, [F.col("thread_key"), F.col("date"), F.col("sequence")]), "positions")
    starts = placed.groupBy("thread_key").agg(F.min("rank").alias("first"))
    return placed.join(starts, "thread_key").withColumn("position", F.col("rank") - F.col("first")).drop("rank", "first")


def thread_summary(messages: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(thread_key, root_message_id, subject, total_count, oldest, newest); the root is the earliest message of the thread."""
    nodes = thread_nodes(messages) if nodes is None else nodes
    joined = nodes.select("sequence", "thread_key").join(messages.select("sequence", "date", "message_id", "subject"), "sequence")
    first = F.min_by(F.struct("message_id", "subject"), F.struct("date", "sequence"))
    out = joined.groupBy("thread_key").agg(first.alias("first"), F.count("*").alias("total_count"), F.min("date").alias("oldest"), F.max("date").alias("newest"))
    return out.select("thread_key", F.col("first.message_id").alias("root_message_id"), F.col("first.subject").alias("subject"), "total_count", "oldest", "newest")


def thread_order(nodes: DataFrame) -> DataFrame:
    """Threads by their newest message, latest first; within a thread by date."""
    newest = nodes.groupBy("thread_key").agg(F.max("date").alias("newest"))
    return nodes.join(newest, "thread_key").orderBy(F.desc("newest"), "thread_key", "date", "sequence")


def visible(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """Threads are made of all messages; this keeps the visible ones with their depth."""
    return nodes.join(messages.select("sequence"), "sequence", "left_semi")
