"""Arrays packed into binary columns, one row for each bucket and task.

A shuffle of many small fixed-width records costs far more as rows than as arrays. ``Packer``
gathers records in numpy arrays and hands out one row for each bucket; ``unpack`` joins the rows
of one bucket again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class Packer:
    """Collects records and yields record batches of (bucket, one binary column for each field)."""

    def __init__(self, buckets: int, fields: dict[str, str], flush_bytes: int = 16 << 20):
        self.buckets, self.fields, self.flush_bytes = buckets, fields, flush_bytes
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, bucket: np.ndarray, *columns: np.ndarray) -> bool:
        """True when enough is held for a flush."""
        if len(bucket):
            self.parts.append((bucket.astype(np.int32), *(c.astype(t) for c, t in zip(columns, self.fields.values(), strict=True))))
            self.held += sum(c.nbytes for c in self.parts[-1])
        return self.held >= self.flush_bytes

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.parts:
            return
        bucket, *columns = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        self.parts, self.held = [], 0
        order = np.argsort(bucket, kind="stable")
        ids, begins = np.unique(bucket[order], return_index=True)
        ends = np.append(begins[1:], len(order))
        arrays: list[pa.Array] = [pa.array(ids, pa.int32())]
        for c in columns:
            data = c[order]
            arrays.append(pa.array([data[b:e].tobytes() for b, e in zip(begins, ends, strict=True)], pa.binary()))
        yield pa.RecordBatch.from_arrays(arrays, ["bucket", *self.fields])


def packed_schema(fields: dict[str, str]) -> str:
    return "bucket int, " + ", ".join(f"{f} binary" for f in fields)


def unpack(table: pa.Table, fields: dict[str, str]) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(table[f].to_pylist()), t) for f, t in fields.items()]


def by_bucket(packed: DataFrame, fields: dict[str, str], work: Callable[[list[np.ndarray]], pa.Table], schema: str) -> DataFrame:
    """``work`` on the joined arrays of each bucket."""

    def run(table: pa.Table) -> pa.Table:
        return work(unpack(table, fields))

    return packed.groupBy("bucket").applyInArrow(run, schema)
