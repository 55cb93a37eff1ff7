"""Tables that cut lineage: written to the folder all executors share, and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stage import stage

__all__ = ["bound_batches", "bucket_count", "packed_rows", "stage", "unused"]

#: Rows and bytes of a batch that goes to Python: texts are long, and a worker holds a batch several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits for batches to those of ``BATCH``; lower ones stay."""
    for key, most in BATCH.items():
        now = spark.conf.get(key, None)
        if now is None or not now.lstrip("-").isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def bucket_count(spark: SparkSession, per_partition: int = 4) -> int:
    """Buckets for packed arrays: a fixed number for each shuffle partition, so that one bucket
    stays a fraction of what the session lets a task hold."""
    return per_partition * max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))


def unused(names: list[str], wanted: str) -> str:
    """``wanted``, with as many underscores behind it as tell it from ``names`` whatever their case."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def packed_rows(docs: DataFrame, **columns: str | Column) -> DataFrame:
    """``docs`` with each row as one struct ``row`` and the named columns beside it: nothing that is added to it meets a caller's column."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *((F.col(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()))
