"""Sorting, pages and ranks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = {"date": lambda: F.col("date"), "from": lambda: F.lower(F.col("from")["address"]), "subject": lambda: F.lower(F.col("subject")), "size": lambda: F.col("length")}


def sort_keys(by: str = "date", descending: bool = True, ties: tuple[str, ...] = ("sequence",)) -> list[Column]:
    """A stable order: equals keep the mailbox's order either way."""
    key = KEYS[by]()
    return [key.desc() if descending else key.asc(), *map(F.col, ties)]


def sort_messages(messages: DataFrame, by: str = "date", descending: bool = True, ties: tuple[str, ...] = ("sequence",)) -> DataFrame:
    return messages.orderBy(*sort_keys(by, descending, ties))


def page(messages: DataFrame, offset: int, height: int, by: str = "date", descending: bool = True, ties: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Rows ``offset`` to ``offset + height`` of the order: a top-k, not a full sort."""
    return sort_messages(messages, by, descending, ties).offset(offset).limit(height)


@dataclass
class SortState:
    """What clicking on columns does: the same one turns the order, another begins ascending, but the date descending."""

    by: str = "date"
    descending: bool = True

    def choose(self, by: str) -> SortState:
        return SortState(by, not self.descending if by == self.by else by == "date")


@dataclass
class SearchHistory:
    """Queries, the latest first, each once."""

    most: int = 20
    items: list[str] = field(default_factory=list)

    def push(self, query: str) -> None:
        if query.strip():
            self.items = [query, *(q for q in self.items if q != query)][: self.most]


def ranked(messages: DataFrame, keys: list[Column]) -> DataFrame:
    """A column ``rank`` from 1 in the order of ``keys``, without one task for all rows: a range sort, and what stands before each of its partitions."""
    from pyspark.sql import Window

    from ..stage import stage

    placed = stage(messages.orderBy(*keys).withColumn("__id", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("__id", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return placed.withColumn("__part", part).join(starts, "__part").withColumn("rank", F.col("__before") + F.col("__id") - F.shiftleft("__part", 33) + 1).drop("__id", "__part", "__before")
