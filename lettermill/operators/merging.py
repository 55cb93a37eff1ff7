"""Union of mailboxes, with or without their repeated messages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concat(mailboxes: list[DataFrame]) -> DataFrame:
    """All messages; ``mailbox_ord`` is the mailbox's place in the list."""
    return reduce(DataFrame.unionByName, (m.withColumn("mailbox_ord", F.lit(i)) for i, m in enumerate(mailboxes)))


def first_occurrences(messages: DataFrame, order: tuple[str, ...] = ("mailbox_ord", "sequence")) -> DataFrame:
    """The first message of each Message-ID, by mailbox and place; messages without an id all stay.

    The first place of an id comes from an aggregation that combines before the shuffle, so an id that fills a mailbox
    is no hot window.
    """
    place = F.struct(*order)
    named = messages.where("message_id <> ''")
    firsts = named.groupBy("message_id").agg(F.min(place).alias("__first"))
    kept = named.join(firsts, "message_id").where(place == F.col("__first")).select(*messages.columns)
    return messages.where("message_id = '' or message_id is null").unionByName(kept)


def merge(mailboxes: list[DataFrame], dedup: bool = True) -> DataFrame:
    joined = concat(mailboxes)
    return first_occurrences(joined) if dedup else joined


def merge_stats(mailboxes: list[DataFrame], dedup: bool = True, sources: bool = False) -> DataFrame:
    """One row of counters: messages written, repeats removed, mailboxes, source headers, bytes."""
    joined = concat(mailboxes)
    ids = F.nullif(F.col("message_id"), F.lit(""))
    repeats = (F.count(ids) - F.count_distinct(ids)) if dedup else F.lit(0).cast("long")
    totals = joined.agg(F.count("*").alias("read"), repeats.alias("duplicates_removed"))
    written = F.col("read") - F.col("duplicates_removed")
    return totals.select(written.alias("total_messages"), "duplicates_removed", F.lit(len(mailboxes)).cast("long").alias("input_files"), (written if sources else F.lit(0).cast("long")).alias("source_headers"))


def numbered(messages: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """A column ``copy``: 0 for the first message of an id, 1 for the next one."""
    return messages.withColumn("copy", F.row_number().over(Window.partitionBy("message_id").orderBy(*order)) - 1)
