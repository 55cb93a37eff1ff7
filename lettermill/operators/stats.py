"""Archive statistics and facets: one aggregation each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import address_display, rfc3339


def summary(messages: DataFrame) -> DataFrame:
    """One row: messages, the range of dates (null without messages), attachments with their percentage, repeated and unique ids (empty ids are neither)."""
    n, with_ = F.count("*"), F.count_if(F.col("has_attachments"))
    ids = F.nullif(F.col("message_id"), F.lit(""))
    return messages.agg(
        n.alias("message_count"),
        F.min("date").alias("oldest"),
        F.max("date").alias("newest"),
        with_.alias("with_attachments"),
        F.when(n == 0, F.lit(0.0)).otherwise(F.round(with_ * 100.0 / n, 1)).alias("attachment_percent"),
        (F.count(ids) - F.count_distinct(ids)).alias("duplicates"),
        F.count_distinct(ids).alias("unique_ids"),
    )


def top_senders(messages: DataFrame, n: int = 10) -> DataFrame:
    """The n senders of most messages; of equals the first by name."""
    return messages.groupBy(address_display(F.col("from")).alias("sender")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "sender").limit(n)


def label_counts(messages: DataFrame) -> DataFrame:
    """Messages by label; a label that a message has twice counts twice."""
    return messages.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("count")).orderBy("label")


def stats_json(messages: DataFrame, file: str, file_size: int, index_size: int = 0, indexing_ms: int = 0) -> DataFrame:
    """The statistics as one JSON document."""
    senders = top_senders(messages).agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("rank"), "sender", "count"))).alias("senders"))
    rows = F.transform("senders", lambda s: F.struct(s["sender"].alias("sender"), s["count"].alias("count")))
    dates = F.when(F.col("oldest").isNotNull(), F.struct(rfc3339(F.col("oldest")).alias("oldest"), rfc3339(F.col("newest")).alias("newest")))
    # two tables of one row each
    both = summary(messages).withColumn("__one", F.lit(1)).join(senders.withColumn("__one", F.lit(1)), "__one")
    doc = F.struct(F.lit(file).alias("file"), F.lit(file_size).alias("file_size"), "message_count", dates.alias("date_range"), F.lit(index_size).alias("index_size"), F.lit(indexing_ms).alias("indexing_time_ms"), "with_attachments", "duplicates", "unique_ids", rows.alias("top_senders"))
    return both.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))
