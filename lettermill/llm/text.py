"""Words, word shingles and rolling hashes over Arrow text columns, in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` over the UTF-8 bytes of a text; no byte of a multi-byte
character falls into that class, so bytes and characters give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_PLAIN = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_LOWER = _PLAIN.copy()
_LOWER[65:91] = _PLAIN[97:123]
_PLACE = np.random.default_rng(77).integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64-bit words."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _U(_BASE)), np.full(n, _U(pow(_BASE, -1, 2**64)))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n + 1 of each at least."""
    size = CHUNK + 1
    while size < n + 1:
        size *= 2
    return _powers(size)


class Rolling:
    """Hash of any substring of ``data`` in constant time."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        n = len(data)
        up, self.down = powers(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_LOWER if lower else _PLAIN)[data] * up[:n], out=self.sums[1:])

    def hash(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[begin]) * self.down[begin])

    def all(self, width: int) -> np.ndarray:
        """Hash of every substring of that width."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its values; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    if column.null_count:  # Arrow leaves open what a null's slot holds
        lengths = np.diff(offsets)
        if lengths[np.asarray(column.is_null())].any():
            return utf8(column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else ""))
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of values that together hold ``most`` bytes at most, or one value that is longer."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words; no word crosses an offset."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = ~SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begins = word.copy()
    begins[1:] &= ~word[:-1] | cut[1:-1]
    ends = word
    ends[:-1] &= ~word[1:] | cut[1:-1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def _long_words(data: np.ndarray, lower: bool) -> np.ndarray:
    """Hashes of the words of one text, piece by piece, cut at white space."""
    out, at, n = [], 0, len(data)
    while at < n:
        to = min(n, at + CHUNK)
        while to < n:  # the cut goes to the next white space
            gap = np.flatnonzero(SPACE[data[to : to + CHUNK]])
            if len(gap):
                to += int(gap[0])
                break
            to = min(n, to + CHUNK)
        piece = data[at:to]
        b, e = word_bounds(piece, np.array([0, len(piece)]))
        out.append(Rolling(piece, lower).hash(b, e))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and each value's first word as offsets into them."""
    if len(offsets) == 2 and len(data) > CHUNK:
        h = _long_words(data, lower)
        return h, np.array([0, len(h)])
    b, e = word_bounds(data, offsets)
    return Rolling(data, lower).hash(b, e), np.searchsorted(b, offsets)


def shingles_of(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of one sequence in order; of a shorter one, the whole sequence."""
    n = len(h)
    if n == 0:
        return h
    if n < k:
        return mix(np.array([(h * _PLACE[32 : 32 + n]).sum(dtype=np.uint64) + _U(n)], np.uint64))
    total = h[: n - k + 1] * _PLACE[0]
    for j in range(1, k):
        total += h[j : n - k + 1 + j] * _PLACE[j]
    return mix(total)


def distinct(s: np.ndarray) -> np.ndarray:
    """Sorted without repeats; sorts in place."""
    s.sort()
    if len(s) > 1:
        new = np.ones(len(s), bool)
        np.not_equal(s[1:], s[:-1], out=new[1:])
        return s[new]
    return s


def shingle_sets(column: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes (A-Z lower-cased)."""
    data, offsets = utf8(column)
    for a, b in chunks(offsets):
        h, first = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        every = shingles_of(h, k)
        for begin, end in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            # a copy: the slice of a long text would keep the whole chunk alive
            yield distinct(every[begin : end - k + 1].copy() if end - begin >= k else shingles_of(h[begin:end], k))


def set_signature(s: np.ndarray) -> int:
    """64-bit signature of a set of hashes, as a signed number."""
    return int(mix(np.array([s.sum(dtype=np.uint64) ^ _U(len(s) * 0x2545F4914F6CDD1D % 2**64)]))[0].astype(np.int64))
