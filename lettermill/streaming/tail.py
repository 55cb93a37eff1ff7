"""Growing mailboxes as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RANGE_BYTES
from ..sources.mbox import MboxSource


def tail_mbox(spark: SparkSession, path: str, include_raw: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """A stream of a mailbox's messages; each appears once the next one has begun. It carries on from its checkpoint."""
    spark.dataSource.register(MboxSource)
    rows = spark.readStream.format("mbox").option("includeRaw", str(include_raw).lower()).option("rangeBytes", range_bytes).load(path)
    return rows.drop("part", "ordinal")


def hourly_counts(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages by hour and sender domain; hours close ``late`` after their end."""
    domain = F.lower(F.regexp_extract(F.col("from")["address"], "@(.*)$", 1)).alias("domain")
    return messages.withWatermark("date", late).groupBy(F.window("date", "1 hour"), domain).agg(F.count("*").alias("n"))
