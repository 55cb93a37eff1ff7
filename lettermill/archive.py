"""One mailbox, or several, behind one object."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from .config import Config
from .operators import export, merging, ordering, stats, threads
from .plans.search import decode_bodies, search
from .sources.files import expand, file_size
from .sources.index import build_index, index_path, index_size
from .sources.mbox import fetch_raw, read_mbox
from .sources.naming import unique_display_names


class MailArchive:
    """``MailArchive(spark, path)``: messages, search, statistics, threads, exports and merges of a mailbox."""

    def __init__(self, spark: SparkSession, path: str, index: bool = True, force: bool = False, config: Config | None = None):
        self.spark, self.path, self.config = spark, path, config or Config()
        self.indexed = index
        self._messages = build_index(spark, path, force, range_bytes=self.config.range_bytes) if index else read_mbox(spark, path, range_bytes=self.config.range_bytes)

    @property
    def messages(self) -> DataFrame:
        return self._messages

    def search(self, query: str, bodies: bool = True) -> DataFrame:
        return search(self.messages.drop("raw"), query, bodies)

    def sorted(self, by: str = "date", descending: bool = True) -> DataFrame:
        return ordering.sort_messages(self.messages, by, descending)

    def stats(self) -> DataFrame:
        return stats.summary(self.messages)

    def stats_json(self) -> str:
        size = index_size(index_path(self.path)) if self.indexed else 0
        return stats.stats_json(self.messages, self.path, file_size(self.path), size).first()[0]

    def top_senders(self, n: int | None = None) -> DataFrame:
        return stats.top_senders(self.messages, n or self.config.top_senders)

    def labels(self) -> DataFrame:
        return stats.label_counts(self.messages)

    def thread_nodes(self) -> DataFrame:
        return threads.with_positions(threads.thread_nodes(self.messages))

    def threads(self) -> DataFrame:
        return threads.thread_summary(self.messages)

    def bodies(self, messages: DataFrame | None = None) -> DataFrame:
        return decode_bodies((self.messages if messages is None else messages).drop("raw"))

    def export(self, kind: str, output: str, query: str = "", quoted_printable: bool = False) -> int:
        """Writes the messages that match; a csv or mbox file gets a name of its own inside an output without an extension."""
        kind = export.format_of(kind)
        chosen = self.search(query)
        if kind in ("csv", "mbox"):
            path = output if os.path.splitext(output)[1] else os.path.join(output, f"export.{kind}")
            os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
            return export.export_csv(chosen, path) if kind == "csv" else export.export_mbox(fetch_raw(chosen), path)
        if kind == "eml":
            return export.write_files(export.eml_files(fetch_raw(chosen), quoted_printable), output)
        decoded = decode_bodies(chosen)
        files = export.text_files(decoded) if kind == "text" else export.html_files(decoded, self.config.sanitize_html)
        return export.write_files(files, output)

    def export_attachments(self, directory: str, query: str = "") -> int:
        return export.write_files(export.attachment_files(fetch_raw(self.search(query))), directory)


def merge_mailboxes(spark: SparkSession, inputs: list[str], output: str, dedup: bool = True, add_source: bool = False) -> dict:
    """Merges mailboxes in order into one file; returns its counters."""
    inputs = expand(inputs)
    for p in inputs:
        file_size(p)
    if not dedup and not add_source:
        written, removed = export.merge_concat_files(inputs, output), 0
    else:
        names = unique_display_names(inputs)
        boxes = [read_mbox(spark, p, include_raw=True).drop("mailbox_ord") for p in inputs]
        total = merging.merge_stats(boxes, dedup, add_source).first()
        merged = merging.merge(boxes, dedup)
        from pyspark.sql import functions as F

        named = merged.withColumn("source", F.element_at(F.array(*map(F.lit, names)), F.col("mailbox_ord") + 1))
        written = export.export_mbox(named, output, ("mailbox_ord", "sequence"), "source" if add_source else None)
        removed = total["duplicates_removed"]
    return {"total_messages": written, "duplicates_removed": removed, "input_files": len(inputs), "source_headers": written if add_source else 0, "output_size": os.path.getsize(output)}
