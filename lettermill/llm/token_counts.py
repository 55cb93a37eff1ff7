"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

Pre-tokens that are not yet known are held together as one array of symbols with offsets. In each
round every sequence merges all occurrences of its own lowest-rank pair, all sequences at once;
what survives is counted. A merged symbol only takes part in pairs of a higher rank than the one
that made it, so merging all occurrences at once gives what merging them one by one does.
Sequences of more than ``LONG`` symbols, for which rounds over the whole array would not pay,
merge through a heap instead.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import bound_batches

#: Fixed value: the pattern that byte-level BPE splits text with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG = 2048
CACHE = 400_000
PIECE = 1 << 21
MOST_VOCABULARY = 1 << 20
NONE = np.int64(1) << 40


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class MergeTable:
    """Ranks of symbol pairs. Symbols are numbered by themselves: bytes first, then one for each merge."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray, special: list[str]):
        self.keys, self.ranks, self.made, self.special = keys, ranks, made, special
        self.known: dict[int, int] | None = None

    @classmethod
    def read(cls, path: str) -> MergeTable:
        """From a tokenizers .json file of byte-level BPE."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        if len(merges) > MOST_VOCABULARY:
            raise ValueError(f"{len(merges)} merges; at most {MOST_VOCABULARY} are sent to the executors")
        number = {c: i for i, c in enumerate(byte_symbols())}
        pairs, made = [], []
        for left, right in merges:
            pairs.append((number[left] << 21) | number[right])
            made.append(number.setdefault(left + right, len(number)))
        order = np.argsort(pairs)
        return cls(np.array(pairs, np.int64)[order], np.arange(len(pairs), dtype=np.int64)[order], np.array(made, np.int64), [t["content"] for t in spec["added_tokens"]])

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = (left << 21) | right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def count(self, sequences: list[bytes]) -> list[int]:
        """Symbols that survive in each sequence."""
        if not sequences:
            return []
        size = np.array([len(s) for s in sequences], np.int64)
        out = np.where(size > LONG, 0, size)
        for i in np.flatnonzero(size > LONG):
            out[i] = self._count_long(sequences[i])
        ids = np.flatnonzero((size > 1) & (size <= LONG))
        symbols = np.frombuffer(b"".join(sequences[i] for i in ids), np.uint8).astype(np.int64)
        owner = np.repeat(ids, size[ids])
        while len(symbols) > 1:
            rank = np.full(len(symbols), NONE)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            least = np.minimum.reduceat(rank, heads)
            lengths = np.diff(np.append(heads, len(symbols)))
            least = np.repeat(least, lengths)
            live = least < NONE
            hit = live & (rank == least)
            # of pairs that overlap (the same symbol many times over), every other one merges
            chain = hit.copy()
            chain[1:] &= hit[:-1]
            if chain.any():
                at = np.arange(len(hit))
                begin = np.maximum.accumulate(np.where(hit & ~chain, at, 0))
                hit &= (at - begin) % 2 == 0
            merged = np.flatnonzero(hit)
            symbols[merged] = self.made[rank[merged]]
            stay = live
            stay[merged + 1] = False
            out -= np.bincount(owner[merged], minlength=len(out))
            symbols, owner = symbols[stay], owner[stay]
        return out.tolist()

    def _count_long(self, sequence: bytes) -> int:
        if self.known is None:
            self.known = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        known, made = self.known, self.made
        symbols: list[int] = list(sequence)
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := known.get((symbols[i] << 21) | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        alive = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if symbols[i] < 0 or j >= n or known.get((symbols[i] << 21) | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = int(made[rank]), -1
            alive -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := known.get((symbols[i] << 21) | symbols[k])) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := known.get((symbols[h] << 21) | symbols[i])) is not None:
                heapq.heappush(heap, (r, h))
        return alive


def _counts(sent):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table: MergeTable = sent.value
        split = regex.compile(PATTERN).findall
        special = regex.compile("|".join(map(regex.escape, sorted(table.special, key=len, reverse=True)))) if table.special else None
        cache: dict[str, int] = {}

        def learn(texts: list[str]) -> list[int]:
            nonlocal cache
            if len(cache) > CACHE:
                cache = {}
            pieces, extra = [], []
            for t in texts:
                parts = special.split(t) if special and special.search(t) else [t]
                extra.append(len(parts) - 1)
                pieces.append([p for part in parts for p in split(part)])
            fresh = list(set().union(*pieces).difference(cache))
            cache.update(zip(fresh, table.count([p.encode() for p in fresh]), strict=True))
            return [e + sum(map(cache.__getitem__, p)) for e, p in zip(extra, pieces, strict=True)]

        for column in columns:
            out, held, size = [], [], 0
            for t in column:
                held.append(t.as_py() or "")
                size += len(held[-1])
                if size > PIECE:
                    out += learn(held)
                    held, size = [], 0
            yield pa.array(out + learn(held), pa.int64())

    return run


def with_token_counts(docs: DataFrame, tokenizer: str, text_col: str = "text", into: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text (a null or empty text has none).

    ``tokenizer`` is the path of a byte-level BPE file of the tokenizers library; it is read on the driver
    and its merges (``MOST_VOCABULARY`` at most) are sent to the executors. No begin, end or other special
    token is added; an added token's string inside a text counts as that one token. All other columns stay.
    """
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(MergeTable.read(tokenizer))
    count = F.arrow_udf(_counts(sent), "long", F.ArrowUDFType.SCALAR_ITER)
    return docs.withColumn(into, count(F.col(text_col)))
