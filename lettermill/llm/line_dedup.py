"""Line dedup by a segment-partition edit join.

Lines within ``tau`` edits of each other fall into one class, and only a class's first line stays.
A line of l characters is cut into tau + 1 segments; a line within tau edits of it keeps one of
them whole, at a place that the lengths and the segment's rank confine (the multi-match-aware
windows). So each line goes into the lists (length, rank, segment) of its own length and of the
lengths down to tau below it. ``linking`` finds the classes; inside a cluster the pairs of a list
are verified by a banded bit-parallel edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import POSTING, Union, components
from .packed import Packer, packed_schema
from .stage import bound_batches, bucket_count, stage
from .text import CHUNK, mix, powers

LEAST_CHARS = 20
_U = np.uint64
#: Fixed value: the white space that is taken off both ends of a line.
BLANK = " \t\n\r\x0b\x0c"


def within(a: str, b: str, tau: int) -> bool:
    """Whether the edit distance of a and b is tau at most.

    Bit e + tau of ``reach[d]`` says: with d edits or fewer, i characters of a turn into the first i + e of b.
    """
    if abs(len(a) - len(b)) > tau:
        return False
    lo, n = 0, min(len(a), len(b))
    while lo < n and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < n - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b) <= tau
    band = (1 << (2 * tau + 1)) - 1
    where: dict[str, int] = {}
    for j, c in enumerate(b):
        where[c] = where.get(c, 0) | (1 << j)
    reach = [((1 << (d + 1)) - 1) << tau for d in range(tau + 1)]
    for i, c in enumerate(a):
        at = where.get(c, 0)
        same = (at >> (i - tau) if i >= tau else at << (tau - i)) & band
        before, reach[0] = reach[0], reach[0] & same
        for d in range(1, tau + 1):
            now = (reach[d] & same) | before | (before >> 1) | ((reach[d - 1] << 1) & band)
            before, reach[d] = reach[d], now
        if not reach[tau]:
            return False
    return bool(reach[tau] >> (len(b) - len(a) + tau) & 1)


class Lines:
    """Lines of many texts as one array of code points."""

    def __init__(self, lines: list[str]):
        self.codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.length = np.array([len(x) for x in lines], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        up, self.down = powers(len(self.codes))
        self.sums = np.zeros(len(self.codes) + 1, np.uint64)
        np.cumsum(mix(self.codes.astype(np.uint64) + _U(1)) * up[: len(self.codes)], out=self.sums[1:])

    def hash(self, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        return mix((self.sums[begin + length] - self.sums[begin]) * self.down[begin])

    def whole(self) -> np.ndarray:
        return self.hash(self.begin, self.length).view(np.int64)

    def segments(self, tau: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(list, line) records."""
        parts = tau + 1
        for shorter in range(tau + 1):
            of = np.flatnonzero((self.length >= least) & (self.length - shorter >= least))
            begin, length = self.begin[of], self.length[of]
            target = length - shorter
            base, longer = target // parts, target % parts
            for i in range(parts):  # the last ``longer`` segments have one character more
                size = base + (i >= parts - longer)
                start = i * base + np.maximum(0, i - (parts - longer))
                for shift in range(max(-i, shorter - (tau - i)), min(i, shorter + (tau - i)) + 1):
                    ok = (start + shift >= 0) & (start + shift + size <= length)
                    key = self.hash(begin[ok] + start[ok] + shift, size[ok])
                    yield mix(key ^ mix((target[ok] * parts + i).astype(np.uint64))), of[ok]


def split_lines(text: str | None) -> list[str]:
    """The lines of a text without the white space at their ends."""
    return [x.strip(BLANK) for x in text.split("\n")] if text else []


def _gather(batches: Iterator[pa.RecordBatch], most: int = CHUNK) -> Iterator[tuple[list, list, list[list[str]]]]:
    keys, ids, held, size = [], [], [], 0
    for batch in batches:
        for key, id_, text in zip(batch.column("key").to_pylist(), batch.column("id").to_pylist(), batch.column("text"), strict=True):
            lines = split_lines(text.as_py())
            keys.append(key)
            ids.append(id_)
            held.append(lines)
            size += sum(map(len, lines))
            if size >= most:
                yield keys, ids, held
                keys, ids, held, size = [], [], [], 0
    if keys:
        yield keys, ids, held


def _occurrences(id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids, held in _gather(batches):
            places = [(k, i, n, x) for k, i, lines in zip(keys, ids, held, strict=True) for n, x in enumerate(lines) if x]
            lines = Lines([p[3] for p in places])
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], id_type), pa.array([p[2] for p in places], pa.int32()), pa.array(lines.whole())], ["key", "id", "line", "sig"])

    return run


def _segments(tau: int, least: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, seen = Packer(buckets, POSTING), set()
        for _, _, held in _gather(batches):
            lines = Lines(list({x for one in held for x in one if len(x) >= least}))
            sig = lines.whole()
            fresh = np.array([s not in seen for s in sig.tolist()], bool)  # a task sends a line once
            seen.update(sig.tolist())
            if len(seen) > 500_000:
                seen = set()
            for key, line in lines.segments(tau, least):
                key, line = key[fresh[line]], line[fresh[line]]
                out.add(mix(key) % _U(buckets), key, sig[line], lines.length[line])
            if out.held >= out.flush_bytes:
                yield from out.flush()
        yield from out.flush()

    return run


def search_lines(tau: int, least: int):
    def search(texts: pa.Array) -> list[int]:
        lines = texts.to_pylist()
        records = list(Lines(lines).segments(tau, least))
        key, line = np.concatenate([r[0] for r in records]), np.concatenate([r[1] for r in records])
        order = np.lexsort((line, key))
        key, line = key[order], line[order]
        union, tested = Union(len(lines)), set()
        ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key))
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            some = np.unique(line[a:b]).tolist()
            for x, i in enumerate(some):
                for j in some[x + 1 :]:
                    if union.root(i) != union.root(j) and (i, j) not in tested:
                        tested.add((i, j))
                        if within(lines[i], lines[j], tau):
                            union.join(i, j)
        return [union.root(i) for i in range(len(lines))]

    return search


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, removed, kept = [], [], []
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            lines, gone = (text or "").split("\n") if text else [], set(gone or ())
            counts.append(len(lines))
            removed.append(len(gone))
            kept.append("\n".join(x for n, x in enumerate(lines) if n not in gone) if text is not None else None)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_lines", "n_removed", "kept"])


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 2, least: int = LEAST_CHARS, cluster: int = 2048) -> DataFrame:
    """(id, n_lines, n_removed, kept) for each document; kept is its text without the lines that are not the first of their class.

    Lines are split at ``\\n`` and compared without the white space at their ends. Lines of ``least`` characters or more are
    in one class if a chain of lines, each within ``tau`` edits (insertions, deletions, replacements of code points) of the
    next, joins them; shorter ones only if equal. Blank lines always stay. The first line is the one of the least id (null last), then of the
    least place. Rows equal in id and text count as one document and get the same result. A null text has no lines and stays null.
    Extra columns are ignored; an empty table gives none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = bucket_count(spark)
    id_type = pa.int64() if dict(docs.dtypes)[id_col] == "bigint" else pa.string()
    kind = "long" if id_type == pa.int64() else "string"
    base = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).cast(kind).alias("id"), F.col(text_col).alias("text"))
    places = stage(base.mapInArrow(_occurrences(id_type), f"key long, id {kind}, line int, sig long"), "lines")
    first = F.struct(F.col("id").isNull().alias("none"), "id", "key", "line")
    heads = places.groupBy("sig").agg(F.min(first).alias("first"), F.count("*").alias("times"))
    packed = base.mapInArrow(_segments(tau, least, buckets), packed_schema(POSTING))

    def with_text(needed: DataFrame) -> DataFrame:
        wanted = needed.join(heads.select("sig", "first.key", "first.line"), "sig")
        found = base.select("key", "text").join(wanted, "key")
        line = F.trim(F.get(F.split("text", "\n"), F.col("line")), F.lit(BLANK))
        return found.withColumn("text", line).drop("key", "line")

    def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.abs(a - b) <= tau

    def block_search(texts: pa.Array) -> list[int]:
        lines = texts.to_pylist()
        return [i for i, x in enumerate(lines) if within(lines[0], x, tau)]

    nodes = components(packed, with_text, fits, search_lines(tau, least), block_search, cluster=cluster)
    classes = heads.join(nodes.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "first", "times", F.coalesce("component", "sig").alias("component"))
    of_class = classes.groupBy("component").agg(F.min("first").alias("first"), F.sum("times").alias("times")).where("times > 1").select("component", F.col("first").alias("stays"))
    repeated = classes.join(of_class, "component").select("sig", "stays")
    gone = places.join(repeated, "sig").where(first != F.col("stays")).select("key", "line").distinct().groupBy("key").agg(F.collect_list("line").alias("gone"))
    return base.join(gone, "key", "left").select("id", "text", "gone").mapInArrow(_kept, f"id {kind}, n_lines long, n_removed long, kept string")
