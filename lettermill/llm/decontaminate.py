"""Benchmark decontamination by SimHash windows.

Windows of an item's own number of words slide over the documents, a shorter document being one window; each window and each item has a
``BITS``-bit SimHash of its weighted word shingles. A multi-index over blocks of 64 bits finds all
items within ``RADIUS`` bits of a window: some block of theirs then differs in RADIUS // BLOCKS bits at most, and only
items that pass in some block are compared as a whole. Whatever is within the radius is verified, and nothing else.
Exact similarity decides: the weight of the item's shingles that the window has, as a multiset, by the weight
of all its shingles (the share of the item that is covered, not the symmetric Jaccard similarity of the two, which is never above it).
Weights are inverse document frequencies among all items, whatever their block.

A window and an item of which it covers 3/4 have an angle of about acos(3/4), so some 23 % of their bits differ, 59 of 256 give or take 7,
against 128 give or take 8 for strangers. The radius of 80 is three deviations from the former and six from the latter; the tests measure its recall
against brute force. A window without any shingle of an item of its size covers nothing, so it gets no fingerprint.
Items are sent to the executors in blocks of ``MOST_ITEMS`` items and ``MOST_BYTES`` bytes at most,
one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import bound_batches, packed_rows, stage
from .text import _PLACE, chunks, mix, shingle_sets, shingles_of, utf8, words

BLOCKS, RADIUS = 4, 80
BITS = 64 * BLOCKS
MOST_ITEMS, MOST_BYTES = 20_000, 16 << 20
#: Windows and items that are compared at once.
_AT_ONCE = 1 << 20
_SALT = np.random.default_rng(256).integers(1, 2**63, BLOCKS, dtype=np.uint64)


def sequence_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all sequences of n words, as ``shingles_of`` hashes a text of n words below the shingle size."""
    count = max(0, len(h) - n + 1)
    total = np.full(count, np.uint64(n))
    for j in range(n):
        total += h[j : j + count] * _PLACE[32 + j]
    return mix(total)


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 and -1 for the bits of each shingle."""
    wide = mix(shingles[:, None] ^ _SALT[None, :])
    return np.unpackbits(wide.view(np.uint8), axis=1).astype(np.float32) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, BLOCKS words of 64 bits each, from sums of weighted signs."""
    return np.packbits(sums > 0, axis=1).view(np.uint64)


def within_radius(windows: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, item) of the fingerprints that differ in RADIUS bits at most."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, _AT_ONCE // max(1, len(items)))
    for at in range(0, len(windows), step):
        part = windows[at : at + step]
        near = np.zeros((len(part), len(items)), bool)
        for block in range(BLOCKS):
            near |= np.bitwise_count(part[:, block, None] ^ items[None, :, block]) <= RADIUS // BLOCKS
        w, i = np.nonzero(near)
        whole = np.bitwise_count(part[w] ^ items[i]).sum(1, dtype=np.int64) <= RADIUS
        found.append((w[whole] + at, i[whole]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Items:
    """The items of one block, by their number of words.

    ``n_items`` is the number of items in all blocks, ``common`` and ``common_df`` are the block's shingles that more than
    one of them have, with how many do; without these the block is the whole benchmark.
    """

    def __init__(self, ids: list, texts: list[str], k: int, n_items: int | None = None, common: np.ndarray | None = None, common_df: np.ndarray | None = None):
        self.ids, self.k = ids, k
        column = pa.array(texts, pa.large_string())
        data, offsets = utf8(column)
        self.shingles: list[np.ndarray] = []
        self.n_words: list[int] = []
        for a, b in zip(offsets[:-1], offsets[1:], strict=True):
            h, _ = words(data[a:b], np.array([0, b - a]))
            self.n_words.append(len(h))
            self.shingles.append(shingles_of(h, k))
        sets = [np.unique(s) for s in self.shingles]
        every, df = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        if common is not None:
            df = np.ones(len(every), np.int64)
            df[np.searchsorted(every, common)] = common_df
        n_items = len(ids) if n_items is None else n_items
        self.known, self.idf = every, np.log1p(n_items / df)
        self.default = float(np.log1p(n_items))
        self.counts = []  # (distinct shingles as places in known, their numbers, total weight)
        for s in self.shingles:
            g, c = np.unique(s, return_counts=True)
            at = np.searchsorted(every, g)
            self.counts.append((at, c, float((self.idf[at] * c).sum())))
        self.sizes: dict[int, list[int]] = {}
        for i, n in enumerate(self.n_words):
            if n:
                self.sizes.setdefault(n, []).append(i)
        self.prints = {n: fingerprints(np.stack([np.round((signs(self.shingles[i]) * self.weights(self.shingles[i])[:, None]).sum(0, dtype=np.float64), 6) for i in which])) for n, which in self.sizes.items()}
        # for each size the shingles that its items have
        self.of_size = {n: np.unique(np.concatenate([self.counts[i][0] for i in which])) for n, which in self.sizes.items()}
        pairs = sorted((p, n) for n, places in self.of_size.items() for p in places.tolist())
        self.begin = np.searchsorted([p for p, _ in pairs], np.arange(len(every) + 1))
        self.size_of = np.array([n for _, n in pairs], np.int64)

    def place(self, s: np.ndarray) -> np.ndarray:
        """Places of shingles among the items' shingles, -1 for others."""
        if not len(self.known):
            return np.full(len(s), -1)
        at = np.minimum(np.searchsorted(self.known, s), len(self.known) - 1)
        return np.where(self.known[at] == s, at, -1)

    def weights(self, s: np.ndarray) -> np.ndarray:
        at = self.place(s)
        return np.where(at >= 0, self.idf[at], self.default)

    def similarity(self, item: int, places: np.ndarray) -> float:
        """Share of the item's weight that a window's shingles (as places) cover."""
        at, c, total = self.counts[item]
        found = np.bincount(np.searchsorted(at, p) if len(p := places[np.isin(places, at)]) else np.zeros(0, np.int64), minlength=len(at))
        return float((self.idf[at] * np.minimum(found, c)).sum()) / total if total else 0.0

    def sizes_at(self, places: np.ndarray) -> list[int]:
        """The sizes of the items that have any of these shingles."""
        places = np.unique(places)
        return sorted({n for p in places.tolist() for n in self.size_of[self.begin[p] : self.begin[p + 1]].tolist()})

    def matches(self, h: np.ndarray, sizes: list[int], threshold: float) -> Iterator[tuple[int, float, int]]:
        """(item, similarity, first word) of the best window of each item of these sizes that reaches the threshold, from a document's word hashes."""
        for n in sizes:
            which = self.sizes[n]
            size = min(n, len(h))  # a document shorter than the item is one window
            span = max(1, size - self.k + 1)
            s = sequence_hashes(h, size) if n < self.k else shingles_of(h, self.k)
            places = self.place(s)
            hits = np.flatnonzero(np.isin(places, self.of_size[n]))
            last = len(s) - span
            edge = np.zeros(last + 2, np.int64)
            np.add.at(edge, np.maximum(hits - span + 1, 0), 1)
            np.add.at(edge, np.minimum(hits, last) + 1, -1)
            starts = np.flatnonzero(np.cumsum(edge)[: last + 1] > 0)
            best: dict[int, tuple[float, int]] = {}
            for a in range(0, len(starts), 2048):
                part = starts[a : a + 2048]
                for g in np.split(part, np.flatnonzero(np.diff(part) > span) + 1):  # far apart: by themselves
                    if not len(g):
                        continue
                    lo, hi = int(g[0]), int(g[-1]) + span
                    sums = np.zeros((hi - lo + 1, BITS), np.float64)
                    np.cumsum(signs(s[lo:hi]) * self.weights(s[lo:hi])[:, None], axis=0, out=sums[1:])
                    prints = fingerprints(np.round(sums[g - lo + span] - sums[g - lo], 6))
                    for w, j in zip(*within_radius(prints, self.prints[n]), strict=True):
                        similarity, start = self.similarity(which[j], places[g[w] : g[w] + span]), int(g[w])
                        if similarity >= threshold and (-similarity, start) < best.get(which[j], (0.0, 0)):
                            best[which[j]] = (-similarity, start)
            for item, (negative, start) in sorted(best.items()):
                yield item, -negative, start


def _found(items: Items, known: np.ndarray, column: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(value, item, similarity, first word, words) of the matches of a text column."""
    lengths = [n for n in items.sizes if n < items.k] + [items.k]
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        h, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        owner = np.repeat(np.arange(b - a), np.diff(first))
        owners, places = [], []
        for n in lengths:
            s = sequence_hashes(h, n) if n < items.k else shingles_of(h, n) if len(h) >= n else np.zeros(0, np.uint64)
            at = np.flatnonzero(known[(s >> np.uint64(44)).astype(np.int64)])
            at = at[owner[at] == owner[at + n - 1]]  # within one document
            place = items.place(s[at])
            owners.append(owner[at][place >= 0])
            places.append(place[place >= 0])
        owners, places = np.concatenate(owners), np.concatenate(places)
        order = np.argsort(owners, kind="stable")
        owners, places = owners[order], places[order]
        begins = np.flatnonzero(np.append(True, owners[1:] != owners[:-1])) if len(owners) else np.zeros(0, np.int64)
        for lo, hi in zip(begins.tolist(), [*begins[1:].tolist(), len(owners)], strict=False):
            i = int(owners[lo])
            mine = h[first[i] : first[i + 1]]
            for m, similarity, word in items.matches(mine, items.sizes_at(places[lo:hi]), threshold):
                yield a + i, m, similarity, word, min(items.n_words[m], len(mine))


def _prepared(sent) -> tuple[Items, np.ndarray]:
    items = Items(*sent.value)
    known = np.zeros(1 << 20, bool)  # a cheap look before the exact one
    known[(items.known >> np.uint64(44)).astype(np.int64)] = True
    return items, known


def _scan(sent, threshold: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = _prepared(sent)
        for batch in batches:
            rows = list(_found(items, known, batch.column("text"), threshold))
            at = pa.array([r[0] for r in rows], pa.int64())
            rest = (pa.array([r[j] for r in rows], t) for j, t in ((2, pa.float64()), (3, pa.int64()), (4, pa.int64())))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), pa.array([items.ids[r[1]] for r in rows], id_type), *rest], ["doc_id", "item", "similarity", "first_word", "n_words"])

    return run


def _without(sent, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, known = _prepared(sent)
        for batch in batches:
            stays = np.ones(len(batch), bool)
            stays[[r[0] for r in _found(items, known, batch.column("text"), threshold)]] = False
            yield batch.filter(pa.array(stays))

    return run


def _item_shingles(k: int):
    """Each item's distinct shingles, with its part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), k))
            parts = np.repeat(batch.column("part").to_numpy(zero_copy_only=False).astype(np.int64), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)), pa.array(parts)], ["shingle", "part"])

    return run


def _item_blocks(benchmark: DataFrame, id_col: str, text_col: str, k: int) -> Iterator[tuple]:
    """What ``Items`` takes, in blocks whose size is bounded before they reach the driver. An item without text has nothing to find.

    Of several blocks each gets the number of all items and how many of them have its own shingles; a shingle not sent is in one item.
    """
    some = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    n, total = some.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    parts = max(-(-2 * n // MOST_ITEMS), -(-2 * total // MOST_BYTES)) if n > MOST_ITEMS or total > MOST_BYTES else 1
    if parts == 1:
        rows = some.collect()
        if rows:
            yield [r[0] for r in rows], [r[1] for r in rows], k
        return
    dealt = some.withColumn("part", F.expr(f"pmod(xxhash64(id, text), {parts})"))
    held = dealt.select("text", "part").mapInArrow(_item_shingles(k), "shingle long, part long").groupBy("shingle", "part").agg(F.count("*").alias("n"))
    held = stage(held, "item-shingles")
    common = held.groupBy("shingle").agg(F.sum("n").alias("df")).where("df > 1")
    common = stage(held.join(common, "shingle").select("part", "shingle", "df"), "item-frequencies")
    for part in range(parts):
        rows = dealt.where(F.col("part") == part).select("id", "text").collect()
        if rows:
            known = common.where(F.col("part") == part).select("shingle", "df").toArrow()
            yield [r[0] for r in rows], [r[1] for r in rows], k, n, known["shingle"].to_numpy().view(np.uint64), known["df"].to_numpy()


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", k: int = 5, threshold: float = 0.75) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): for each document and item the best window (the first of equals)
    of the item's number of words that covers ``threshold`` of the item's shingle weight, and the window's words.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the A-Z-lower-cased whole text; an item of fewer than ``k`` words is one
    shingle. A document shorter than an item is itself the window. Null or empty texts match nothing. Repeated rows each get
    their matches, and a null id is kept. Only the id and text columns are read, whatever others are called. An empty table on
    either side gives none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    item_type = dict(benchmark.dtypes)[item_col]
    arrow = pa.int64() if item_type == "bigint" else pa.string()
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, item {'long' if item_type == 'bigint' else 'string'}, similarity double, first_word long, n_words long"
    out = spark.createDataFrame([], schema)
    items = benchmark if item_type == "bigint" else benchmark.withColumn(item_col, F.col(item_col).cast("string"))
    for block in _item_blocks(items, item_col, item_text, k):
        out = out.unionByName(base.mapInArrow(_scan(spark.sparkContext.broadcast(block), threshold, arrow), schema))
    return out.withColumn("item", F.col("item").cast(item_type)).withColumnRenamed("item", item_col)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text", k: int = 5, threshold: float = 0.75) -> DataFrame:
    """The rows of ``docs`` in which ``contaminated`` finds nothing, with all their columns as they are.

    Rows leave where they are found, so none is told from another by a key: repeated rows stay or go together.
    Null and empty texts stay; without items all rows do.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    out = packed_rows(docs, text=text_col)
    for block in _item_blocks(benchmark.withColumn(item_text, F.col(item_text)), item_text, item_text, k):
        out = out.mapInArrow(_without(spark.sparkContext.broadcast(block), threshold), out.schema)
    return out.select("row.*")
