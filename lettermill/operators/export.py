"""What selections are written as. Each format is first a column of names and contents, then files."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.mime import inject_source, mbox_record, parse_body, sanitize_html, to_eml
from ..schema import ExportError
from ..sources.mbox import write_mbox

CSV_HEADER = "Date,From,To,CC,Subject,Size,Has_Attachments,Labels,Message_ID"
FORMATS = {"eml": "eml", "csv": "csv", "txt": "text", "text": "text", "html": "html", "mbox": "mbox"}
#: Fixed value: the style of exported pages.
STYLE = "body{font-family:sans-serif;max-width:60em;margin:1em auto}table.h td{padding:0 .6em 0 0;vertical-align:top}pre{white-space:pre-wrap}"


def format_of(name: str) -> str:
    if name.lower() not in FORMATS:
        raise ExportError(f"unknown format: {name}")
    return FORMATS[name.lower()]


def _binary(f, *columns: str | Column) -> Column:
    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([None if row[0] is None else f(*row) for row in zip(*(a.to_pylist() for a in arrays), strict=True)], pa.binary())

    return F.arrow_udf(run, "binary", F.ArrowUDFType.SCALAR)(*columns)


def joined(addresses: str | Column, glue: str) -> Column:
    return F.array_join(F.transform(addresses, T.address_display), glue)


def eml_name() -> Column:
    return T.message_file_name(F.col("date"), [(F.col("from")["address"], 30), (F.col("subject"), 80)], ".eml")


def text_name(extension: str = ".txt") -> Column:
    return T.message_file_name(F.col("date"), [(F.col("subject"), 80)], extension)


def folder_name() -> Column:
    return F.concat_ws("_", F.date_format("date", "yyyyMMdd_HHmmss"), T.file_name_part(F.col("subject"), 60))


def unique_names(rows: DataFrame, name: str = "name", folder: str | None = None, order: tuple[str, ...] = ("sequence",)) -> DataFrame:
    """Names that occur again become ``stem_1.ext`` to ``stem_999.ext``, then ``stem_dup.ext`` with their number, in order."""
    keys = [folder, name] if folder else [name]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    stem, extension = F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)
    again = F.concat(stem, F.when(F.col("__nth") <= 999, F.concat(F.lit("_"), F.col("__nth").cast("string"))).otherwise(F.concat(F.lit("_dup"), F.col("__nth").cast("string"))), extension)
    return rows.withColumn("__nth", nth).withColumn(name, F.when(F.col("__nth") == 0, F.col(name)).otherwise(again)).drop("__nth")


def eml_files(messages: DataFrame, quoted_printable: bool = False) -> DataFrame:
    """(sequence, name, content) from raw messages."""
    named = messages.withColumn("name", eml_name())
    return unique_names(named).select("sequence", "name", _binary(lambda raw: to_eml(raw, quoted_printable), "raw").alias("content"))


def csv_line() -> Column:
    """One message as a CSV line; an address is always ``name <address>``, even without a name."""
    sender = F.concat(F.col("from")["display_name"], F.lit(" <"), F.col("from")["address"], F.lit(">"))
    fields = [sender, joined("to", "; "), joined("cc", "; "), F.col("subject")]
    late = [F.array_join("labels", "; "), F.col("message_id")]
    return F.concat_ws(",", F.date_format("date", "yyyy-MM-dd HH:mm:ss"), *map(T.csv_field, fields), F.col("length").cast("string"), F.col("has_attachments").cast("string"), *map(T.csv_field, late))


def export_csv(messages: DataFrame, path: str, snippet: Column | None = None) -> int:
    """A CSV file with a byte order mark, in mailbox order; with a snippet as a last column if one is given. Rows are streamed, one partition at a time."""
    line = csv_line() if snippet is None else F.concat(csv_line(), F.lit(","), T.csv_field(F.coalesce(snippet, F.lit(""))))
    head = CSV_HEADER + ("" if snippet is None else ",Snippet")
    n = 0
    temporary = f"{path}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "w", encoding="utf-8", newline="") as f:
        f.write("﻿" + head + "\n")
        for row in messages.orderBy("sequence").select(line.alias("line")).toLocalIterator():
            f.write(row[0] + "\n")
            n += 1
    os.replace(temporary, path)
    return n


def _attachment_list(rule: str) -> Column:
    lines = F.transform("body.attachments", lambda a: F.concat(F.lit("  - "), a["filename"], F.lit(" ("), a["content_type"], F.lit(", "), T.human_size(a["size"]), F.lit(")\n")))
    return F.when(F.size("body.attachments") > 0, F.concat(F.lit(f"\n{rule}\nAttachments:\n"), F.array_join(lines, ""))).otherwise(F.lit(""))


def text_content() -> Column:
    rule = "-" * 72
    cc = F.when(F.size("cc") > 0, F.concat(F.lit("Cc:      "), joined("cc", ", "), F.lit("\n"))).otherwise(F.lit(""))
    date = F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss +0000")
    head = F.concat(F.lit("Date:    "), date, F.lit("\nFrom:    "), T.address_display(F.col("from")), F.lit("\nTo:      "), joined("to", ", "), F.lit("\n"), cc, F.lit("Subject: "), F.col("subject"), F.lit(f"\n{rule}\n\n"))
    return F.concat(head, F.coalesce("body.text", F.lit("")), F.lit("\n"), _attachment_list(rule))


def html_content(sanitize: bool = True) -> Column:
    esc = T.escape_html
    rows = [("Date", F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss +0000")), ("From", T.address_display(F.col("from"))), ("To", joined("to", ", ")), ("Cc", F.nullif(joined("cc", ", "), F.lit(""))), ("Subject", F.col("subject"))]
    table = F.concat(*(F.coalesce(F.concat(F.lit(f"<tr><td><b>{n}:</b></td><td>"), esc(c), F.lit("</td></tr>\n")), F.lit("")) for n, c in rows))
    page = T.html_clean("body.html") if sanitize else F.col("body.html")
    body = F.coalesce(page, F.concat(F.lit("<pre>"), esc(F.coalesce("body.text", F.lit(""))), F.lit("</pre>")))
    items = F.transform("body.attachments", lambda a: F.concat(F.lit("<li>"), esc(a["filename"]), F.lit(" ("), esc(a["content_type"]), F.lit(", "), T.human_size(a["size"]), F.lit(")</li>\n")))
    attached = F.when(F.size("body.attachments") > 0, F.concat(F.lit("<hr>\n<h3>Attachments</h3>\n<ul>\n"), F.array_join(items, ""), F.lit("</ul>\n"))).otherwise(F.lit(""))
    return F.concat(F.lit('<!DOCTYPE html>\n<html>\n<head>\n<meta charset="utf-8">\n<title>'), esc(F.col("subject")), F.lit(f'</title>\n<style>{STYLE}</style>\n</head>\n<body>\n<table class="h">\n'), table, F.lit("</table>\n<hr>\n"), body, F.lit("\n"), attached, F.lit("</body>\n</html>\n"))


def text_files(decoded: DataFrame) -> DataFrame:
    return unique_names(decoded.withColumn("name", text_name())).select("sequence", "name", F.encode(text_content(), "utf-8").alias("content"))


def html_files(decoded: DataFrame, sanitize: bool = True) -> DataFrame:
    return unique_names(decoded.withColumn("name", text_name(".html"))).select("sequence", "name", F.encode(html_content(sanitize), "utf-8").alias("content"))


def mbox_records(messages: DataFrame, source_col: str | None = None) -> DataFrame:
    """``messages`` with ``record``: the raw message as it stands in a mailbox, with its source if a column names one."""
    named = messages.withColumn("__line", T.from_line(F.col("from")["address"], F.col("date")))
    if source_col is None:
        record = _binary(lambda raw, line: mbox_record(raw, line.encode()), "raw", "__line")
    else:
        record = _binary(lambda raw, line, source: inject_source(mbox_record(raw, line.encode()), source or ""), "raw", "__line", source_col)
    return named.withColumn("record", record).drop("__line")


def export_mbox(messages: DataFrame, path: str, order: tuple[str, ...] = ("sequence",), source_col: str | None = None) -> int:
    return write_mbox(mbox_records(messages, source_col), path, list(order))


def merge_concat_files(inputs: list[str], output: str) -> int:
    """Byte-exact concatenation of mailboxes; counts the lines that begin with ``From ``."""
    n, temporary = 0, f"{output}.{uuid.uuid4().hex}.tmp"
    with open(temporary, "wb") as out:
        for path in inputs:
            with open(path, "rb") as f:
                for line in f:
                    n += line.startswith(b"From ")
                    out.write(line)
    os.replace(temporary, output)
    return n


def attachment_files(messages: DataFrame, folders: bool = True, flagged_only: bool = True) -> DataFrame:
    """(sequence, folder, name, content) of the attachments of messages with the attachment flag; a folder for each message unless not wanted."""
    from ..plans.search import decode_bodies

    chosen = messages.where("has_attachments") if flagged_only else messages
    parts = decode_bodies(chosen, payloads=True).select("sequence", folder_name().alias("folder") if folders else F.lit("").alias("folder"), F.posexplode("body.attachments").alias("place", "a"))
    named = parts.select("sequence", "place", "folder", T.file_name_part(F.col("a.filename"), 150).alias("name"), F.col("a.payload").alias("content"))
    return unique_names(named, folder="folder", order=("sequence", "place")).drop("place")


def extract_attachment(raw: bytes, part_index: int) -> bytes | None:
    """One attachment's bytes, by its place and never by its name."""
    return next((a["payload"] for a in parse_body(raw, payloads=True)["attachments"] if a["part_index"] == part_index), None)


def write_files(files: DataFrame, directory: str) -> int:
    """Writes (name, content), with ``folder`` if there is one, below a directory that the executors share; returns how many.

    Each file is written beside its place and renamed, so a task that runs twice leaves one whole file.
    """
    os.makedirs(directory, exist_ok=True)
    has_folder = "folder" in files.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folders = batch.column("folder").to_pylist() if has_folder else [""] * len(batch)
            for folder, name, content in zip(folders, batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                target = os.path.join(directory, folder)
                os.makedirs(target, exist_ok=True)
                handle, temporary = tempfile.mkstemp(dir=target)
                with os.fdopen(handle, "wb") as f:
                    f.write(content or b"")
                os.chmod(temporary, 0o644)
                shutil.move(temporary, os.path.join(target, name))
            yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], ["n"])

    columns = [c for c in ("folder", "name", "content") if c in files.columns]
    return files.select(*columns).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def search_json(messages: DataFrame) -> DataFrame:
    """One row: the results as a JSON document. For results that are meant to be read; it gathers them in one row."""
    item = F.struct(F.col("sequence").alias("index"), T.rfc3339(F.col("date")).alias("date"), F.struct(F.col("from")["address"].alias("address"), F.col("from")["display_name"].alias("display_name")).alias("from"), F.transform("to", T.address_display).alias("to"), "subject", "message_id", F.col("length").alias("size"), "has_attachments", "labels")
    rows = F.array_sort(F.collect_list(item))
    return messages.agg(F.to_json(F.struct(F.count("*").alias("result_count"), rows.alias("results"))).alias("json"))


def search_table(messages: DataFrame) -> DataFrame:
    """The columns of a result list: date, sender and subject cut to their widths, size."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)
    return messages.select("sequence", F.date_format("date", "yyyy-MM-dd HH:mm").alias("date"), cut(T.address_display(F.col("from")), 25).alias("from"), cut(F.col("subject"), 40).alias("subject"), T.human_size(F.col("length")).alias("size"))


def clean_page(source: str, directory: str | None = None) -> str:
    """A sanitized page in a temporary file, for a viewer."""
    handle, path = tempfile.mkstemp(suffix=".html", dir=directory)
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(sanitize_html(source) or "")
    return path


