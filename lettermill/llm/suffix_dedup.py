"""Suffix-array dedup: removes every byte covered by a string of ``width`` bytes that starts twice.

A depth-limited radix sort of suffixes, most significant digit first; nothing is ordered beyond
``width`` bytes, and a group that is down to one suffix is dropped at once.

* First digit: the least-hashed ``GRAM``-byte string inside the window (leftmost if it occurs
  again). It depends on the window's bytes only, so equal windows file under equal digits, and
  neighbouring windows share it: they travel as one run (digit, hash of the run's bytes, place),
  one for about 70 bytes of text. Runs that a task holds twice are settled there.
* Digits of one run only are finished: nothing repeats. A run that occurs again as a whole is
  finished too: all its windows repeat.
* The other windows, in runs that share the digit but differ, are sorted on by the following
  digits of 64 bytes each, until ``width`` bytes are ordered. Equal groups are the repeats.

A digit shared by more than ``HOT`` different runs is not brought together: its windows are
spread, each under its own hash, and combined within each task first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packed import Packer, by_bucket, packed_schema
from .stage import bound_batches, bucket_count, stage
from .text import CHUNK, Rolling, chunks, mix, utf8

GRAM = 64
DIGIT = 64
HOT = 50_000
GATHER = 1 << 20
_U = np.uint64
RUN = {"a": "<u8", "s": "<u8", "count": "<u4", "key": "<i8", "start": "<u4", "n": "<u4"}
SPANS = "key long, start long, n long, a long, weight int"


def _slices(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(first value, its begin within, ...) pieces of at most CHUNK bytes; a longer value in slices that overlap by a window less one byte."""
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        if hi - lo <= CHUNK:
            yield a, 0, b - a, data[lo:hi], offsets[a : b + 1] - lo
            continue
        for at in range(0, hi - lo - width + 1, CHUNK - width + 1):
            piece = data[lo + at : min(hi, lo + at + CHUNK)]
            yield a, at, 1, piece, np.array([0, len(piece)])


def window_runs(data: np.ndarray, offsets: np.ndarray, width: int):
    """Runs of neighbouring windows with one first digit: (value, begin in the value, windows, digit, hash of the run's bytes)."""
    gram = min(GRAM, width)
    if len(data) < width:
        return None
    rolling = Rolling(data)
    digit = rolling.all(gram)
    # the order of digits, with the place below it: the least one is also the leftmost
    bits = _U(21)
    order = (digit >> bits << bits) | np.arange(len(digit), dtype=np.uint64)
    reach = width - gram + 1
    count = len(order) - reach + 1
    padded = np.concatenate([order, np.full(-len(order) % reach, 2**64 - 1, np.uint64)]).reshape(-1, reach)
    ahead = np.minimum.accumulate(padded, 1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(behind[:count], ahead[reach - 1 : reach - 1 + count])
    place = (least & _U((1 << 21) - 1)).astype(np.int64)
    at = np.arange(count)
    value = np.searchsorted(offsets, at, "right") - 1
    inside = at + width <= offsets[value + 1]
    head = np.ones(count, bool)
    head[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1]) | (value[1:] != value[:-1])
    begin = np.flatnonzero(head)
    end = np.append(begin[1:], count)
    keep = inside[begin]
    begin, end = begin[keep], end[keep]
    return value[begin], begin - offsets[value[begin]], end - begin, digit[place[begin]], rolling.hash(begin, end - 1 + width)


def _merge(key: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window ranges with those that touch joined."""
    if not len(key):
        return key, start, n
    order = np.lexsort((start, key))
    key, start, n = key[order], start[order].astype(np.int64), n[order].astype(np.int64)
    head = np.ones(len(key), bool)
    head[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + n[:-1])
    first = np.flatnonzero(head)
    return key[first], start[first], np.add.reduceat(n, first)


def _combined(a, s, key, start, n):
    """One record for each (digit, run) of a task; the places of those that the task holds twice, as ranges that repeat."""
    order = np.lexsort((s, a))
    a, s, key, start, n = a[order], s[order], key[order], start[order], n[order]
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(head)
    count = np.diff(np.append(first, len(a)))
    twice = np.repeat(count > 1, count)
    return (a[first], s[first], np.minimum(count, 2), key[first], start[first], n[first]), _merge(key[twice], start[twice], n[twice])


def _send(out: Packer, parts: list[tuple[np.ndarray, ...]]) -> None:
    records, (key, start, n) = _combined(*(np.concatenate(c) for c in zip(*parts, strict=True)))
    b = _U(out.buckets)
    out.add(mix(records[0]) % b, *records)
    zero = np.zeros(len(key), np.uint64)
    out.add(mix(key.view(np.uint64) + start.astype(np.uint64)) % b, zero, zero, zero, key, start, n)


def _all_runs(width: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, parts, held = Packer(buckets, RUN), [], 0
        for batch in batches:
            keys = batch.column("key").to_numpy()
            data, offsets = utf8(batch.column("text"))
            for first, at, _, piece, within in _slices(data, offsets, width):
                if (found := window_runs(piece, within, width)) is None:
                    continue
                value, begin, n, digit, whole = found
                parts.append((digit, whole, keys[first + value], begin + at, n))
                held += len(n)
                if held >= GATHER:
                    _send(out, parts)
                    parts, held = [], 0
                    yield from out.flush()
        if parts:
            _send(out, parts)
        yield from out.flush()

    return run


def _spans(key, start, n, a=None, weight=None) -> pa.Table:
    m = len(key)
    return pa.table({"key": pa.array(key, pa.int64()), "start": pa.array(start.astype(np.int64)), "n": pa.array(n.astype(np.int64)), "a": pa.nulls(m, pa.int64()) if a is None else pa.array(a.view(np.int64)), "weight": pa.array(np.zeros(m, np.int32) if weight is None else weight.astype(np.int32))})


def _settle(columns: list[np.ndarray]) -> pa.Table:
    """Ranges that repeat (weight 0), and one record for each of the differing runs that share a digit (weight 1: the run occurs once, 2: more often; 4 more if the digit is hot)."""
    known = columns[2] == 0
    ranges = [tuple(c[known] for c in columns[3:])]
    a, s, count, key, start, n = (c[~known] for c in columns)
    order = np.lexsort((s, a))
    a, s, count, key, start, n = a[order], s[order], count[order], key[order], start[order], n[order]
    if not len(a):
        return _spans(*_merge(*ranges[0]))
    head = np.ones(len(a), bool)
    head[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(a)))
    again = np.add.reduceat(count.astype(np.int64), first) > 1
    hit = np.repeat(again, size) & (count == 1)
    ranges.append((key[hit], start[hit], n[hit]))
    of_digit = a[first]
    new = np.ones(len(first), bool)
    new[1:] = of_digit[1:] != of_digit[:-1]
    different = np.diff(np.append(np.flatnonzero(new), len(first)))
    different = np.repeat(different, different)
    ask = first[different > 1]
    weight = np.where(again, 2, 1)[different > 1] + np.where(different > HOT, 4, 0)[different > 1]
    done = _spans(*_merge(*(np.concatenate(c) for c in zip(*ranges, strict=True))))
    return pa.concat_tables([done, _spans(key[ask], start[ask], n[ask], a[ask], weight)])


CONTENT = "bucket int, a binary, weight binary, key binary, start binary, n binary, content binary"


def _contents(width: int, buckets: int):
    """The bytes of the runs that a document is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            a = np.array(as_, np.int64).view(np.uint64)
            bucket = (mix(a) % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            ids, begins = np.unique(bucket[order], return_index=True)
            cols = [c[order] for c in (a, np.array(ws, np.uint8), np.array(ks, np.int64), np.array(ss, np.uint32), np.array(ns, np.uint32))]
            cuts = list(zip(begins, np.append(begins[1:], len(order)), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array([c[x:y].tobytes() for x, y in cuts], pa.binary()) for c in cols), pa.array([b"".join(cs[i] for i in order[x:y]) for x, y in cuts], pa.binary())], ["bucket", "a", "weight", "key", "start", "n", "content"])

        as_, ws, ks, ss, ns, cs, held = [], [], [], [], [], [], 0
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            raw = data.tobytes()
            for at, key, asked in zip(offsets[:-1].tolist(), batch.column("key").to_pylist(), batch.column("asked").to_pylist(), strict=True):
                for x in asked:
                    as_.append(x["a"])
                    ws.append(x["weight"])
                    ks.append(key)
                    ss.append(x["start"])
                    ns.append(x["n"])
                    cs.append(raw[at + x["start"] : at + x["start"] + x["n"] - 1 + width])
                    held += len(cs[-1]) + 40
            if held > 24 << 20:
                yield rows()
                as_, ws, ks, ss, ns, cs, held = [], [], [], [], [], [], 0
        if as_:
            yield rows()

    return run


def radix_repeats(digit: np.ndarray, data: np.ndarray, begins: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, window of the run) of the windows that equal one of another run with the same first digit.

    ``begins`` are the runs' places in ``data``, ``n`` their numbers of windows."""
    run = np.repeat(np.arange(len(n)), n)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begins[run] + within
    group = digit[run]
    rolling = Rolling(data)
    for depth in range(0, width, DIGIT):
        key = rolling.hash(at + depth, at + min(depth + DIGIT, width))
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        head = np.ones(len(order), bool)
        head[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
        size = np.diff(np.append(np.flatnonzero(head), len(order)))
        alive = np.repeat(size > 1, size)
        group = (np.cumsum(head).astype(np.uint64))[alive]
        order = order[alive]
        run, within, at = run[order], within[order], at[order]
        if not len(run):
            break
    return run, within


def _sorted_on(width: int):
    def work(table: pa.Table) -> pa.Table:
        a, weight, key, start, n = (np.frombuffer(b"".join(table[c].to_pylist()), t) for c, t in (("a", "<u8"), ("weight", "u1"), ("key", "<i8"), ("start", "<u4"), ("n", "<u4")))
        data = np.frombuffer(b"".join(table["content"].to_pylist()), np.uint8)
        n = n.astype(np.int64)
        length = n - 1 + width
        run, within = radix_repeats(a, data, np.cumsum(length) - length, n, width)
        once = weight[run] == 1
        run, within = run[once], within[once]
        return _spans(*_merge(key[run], start[run].astype(np.int64) + within, np.ones(len(run), np.int64)))

    return work


def _single_windows(width: int, buckets: int):
    """Each asked window as a run of its own, for digits that are too hot to bring together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(buckets, RUN)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            parts = []
            for i, (key, asked) in enumerate(zip(batch.column("key").to_pylist(), batch.column("asked").to_pylist(), strict=True)):
                for x in asked:
                    piece = data[offsets[i] + x["start"] : offsets[i] + x["start"] + x["n"] - 1 + width]
                    rolling, at = Rolling(piece), np.arange(x["n"])
                    half = width // 2
                    for _ in range(x["weight"] - 4):  # a run that occurs again counts twice
                        parts.append((rolling.hash(at, at + half), rolling.hash(at + half, at + width), np.full(x["n"], key), x["start"] + at, np.ones(x["n"], np.int64)))
            if parts:
                _send(out, parts)
                yield from out.flush()

    return run


def _removed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            removed, spans, kept = [], [], []
            for a, b, ranges in zip(offsets[:-1], offsets[1:], batch.column("ranges"), strict=True):
                text = data[a:b]
                gone = np.zeros(len(text) + 1, np.int32)
                if ranges.is_valid:
                    packed = ranges.values.to_numpy()
                    starts, ns = packed[0::2], packed[1::2]
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + ns - 1 + width, -1)
                hit = np.cumsum(gone[:-1]) > 0
                removed.append(int(hit.sum()))
                spans.append(int(hit[:1].sum() + (hit[1:] & ~hit[:-1]).sum()))
                kept.append(text[~hit].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], ["id", "n_bytes", "n_removed", "n_spans", "kept"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 200) -> DataFrame:
    """For each document (id, n_bytes, n_removed, n_spans, kept): its UTF-8 bytes without those covered by
    a ``width``-byte string that also starts anywhere else, in this document or another.

    Strings never cross documents and are judged on the input; overlaps count. A null text is empty, and
    texts shorter than ``width`` stay whole. Repeated rows are documents of their own, so they lose
    everything that ``width`` covers. A null id is kept. Extra columns are ignored; an empty table gives none.
    Removal works on bytes: ``kept`` is binary, as a cut may fall inside a character.
    Rows are told apart by a 64-bit hash of id and text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    buckets = bucket_count(spark)
    base = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    keyed = base.select("key", "text")
    runs = keyed.mapInArrow(_all_runs(width, buckets), packed_schema(RUN))
    first = stage(by_bucket(runs, RUN, _settle, SPANS), "runs")
    asked = first.where("weight > 0").groupBy("key", F.expr("weight >= 4").alias("hot")).agg(F.collect_list(F.struct("start", "n", "a", "weight")).alias("asked"))
    with_texts = keyed.join(asked, "key")
    contents = with_texts.where("not hot").select("key", "text", "asked").mapInArrow(_contents(width, buckets), CONTENT)
    spans = first.where("weight = 0").unionByName(contents.groupBy("bucket").applyInArrow(_sorted_on(width), SPANS))
    if not first.where("weight >= 4").isEmpty():
        windows = with_texts.where("hot").select("key", "text", "asked").mapInArrow(_single_windows(width, buckets), packed_schema(RUN))
        spans = spans.unionByName(by_bucket(windows, RUN, _settle, SPANS).where("weight = 0"))
    ranges = spans.groupBy("key").agg(F.collect_list(F.struct("start", "n")).alias("ranges"))
    joined = base.join(ranges, "key", "left").select("id", "text", F.flatten(F.transform("ranges", lambda r: F.array(r["start"], r["n"]))).alias("ranges"))
    schema = f"id {dict(docs.dtypes)[id_col]}, n_bytes long, n_removed long, n_spans long, kept binary"
    return joined.mapInArrow(_removed(width), schema)
