"""Single message files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.headers import clamp, message_row
from ..functions.mime import header_end
from .mbox import ARROW

_NAMES = [n for n in ARROW.names if n not in ("part", "ordinal")]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            row = message_row(content[: header_end(content)])
            rows.append(row | {"date": clamp(row["date"]), "mailbox": path, "offset": 0, "length": len(content), "raw": content})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([ARROW.field(n) for n in _NAMES]))


def read_eml(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file: the message columns at offset 0, with its raw bytes."""
    from ..schema import MESSAGE

    wanted = spark.createDataFrame([], MESSAGE).select(*_NAMES).schema
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_rows, wanted).withColumn("sequence", F.lit(0).cast("long"))
