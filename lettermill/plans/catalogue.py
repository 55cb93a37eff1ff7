"""Queries over the test tables through the engine's operators, and the SQL each is held against."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import export, merging, ordering, stats, threads
from ..sources.eml import read_eml
from ..sources.mbox import read_mbox
from . import views
from .search import decode_bodies, search, with_label, within, without

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
C, D, E = views.CONVERSATIONS_SQL, views.DOCUMENTS_SQL, views.EVENTS_SQL


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def plain_date(c: str = "date") -> Column:
    """A timestamp in UTC without its zone."""
    return F.col(c).cast("timestamp_ntz").alias(c)


def base64(c: str) -> Column:
    """On one line, which base64() is not."""
    return F.regexp_replace(F.base64(F.encode(c, "utf-8")), r"\s", "")


# ---- search ----------------------------------------------------------------------------------

#: name: (view, query, condition in SQL)
SEARCHES: dict[str, tuple[str, str, str]] = {
    "search_from": ("documents", "from:SRC1", "contains(from_name, 'src1') OR contains(from_address, 'src1')"),
    "search_to": ("documents", "to:de@", "contains(to_name, 'de@') OR contains(to_address, 'de@')"),
    "search_cc": ("documents", "cc:src5", "coalesce(contains(cc_name, 'src5') OR contains(cc_address, 'src5'), false)"),
    "search_subject": ("documents", "subject:The", "contains(lower(subject), 'the')"),
    "search_label": ("documents", "label:rc1", "contains(lang, 'rc1') OR contains(source, 'rc1')"),
    "search_id": ("documents", "id:ab", "contains(message_id, 'ab')"),
    "search_free_text": ("documents", "Inth", "contains(lower(subject), 'inth') OR contains(from_name, 'inth') OR contains(from_address, 'inth') OR contains(to_name, 'inth') OR contains(to_address, 'inth') OR contains(lower(text), 'inth')"),
    "search_metadata_only": ("documents", "Inth", "contains(lower(subject), 'inth') OR contains(from_name, 'inth') OR contains(from_address, 'inth') OR contains(to_name, 'inth') OR contains(to_address, 'inth')"),
    "search_body": ("documents", "body:Token", "contains(lower(text), 'token')"),
    "search_filename": ("documents", "filename:DOC-7", "coalesce(contains(filename, 'doc-7'), false)"),
    "search_filename_exact": ("documents", 'filename:"doc-70.txt"', "coalesce(filename = 'doc-70.txt', false)"),
    "search_has_attachment": ("documents", "has:attachment", "has_attachments"),
    "search_no_attachment": ("documents", "has:attachments -has:attachment", "NOT has_attachments"),
    "search_date_day": ("documents", "date:2020-03-05", "date::DATE = DATE '2020-03-05'"),
    "search_date_month": ("documents", "date:2020-04", "year(date) = 2020 AND month(date) = 4"),
    "search_date_year": ("documents", "date:2021", "year(date) = 2021"),
    "search_date_range": ("documents", "date:2020-02..2020-11-15", "date::DATE BETWEEN DATE '2020-02-01' AND DATE '2020-11-15'"),
    "search_before_after": ("documents", "after:2020-06-01 before:2021-01-10", "date >= TIMESTAMP '2020-06-01' AND date < TIMESTAMP '2021-01-10'"),
    "search_size_band": ("documents", "size:>1kb size:<4kb", "length > 1024 AND length < 4096"),
    "search_not": ("documents", "-subject:the", "NOT contains(lower(subject), 'the')"),
    "search_or_group": ("documents", "from:src3 OR label:fr", "contains(from_name, 'src3') OR contains(from_address, 'src3') OR contains(lang, 'fr') OR contains(source, 'fr')"),
    "search_or_and_precedence": ("documents", "from:src3 OR from:src4 label:en", "(contains(from_address, 'src3') OR contains(from_address, 'src4')) AND (contains(lang, 'en') OR contains(source, 'en'))"),
    "search_phrase": ("documents", 'body:"of the"', "contains(lower(text), 'of the')"),
    "search_combined": ("documents", 'label:en -from:src0 body:the OR subject:and size:>500 after:2020-02-01 has:no-attachment', "(contains(lang, 'en') OR contains(source, 'en')) AND NOT contains(from_address, 'src0') AND (contains(lower(text), 'the') OR contains(lower(subject), 'and')) AND length > 500 AND date >= TIMESTAMP '2020-02-01' AND NOT has_attachments"),
    "search_dropped_filter_returns_all": ("documents", "size:5mb date:2024-13 has:foo size:>1.5mb", "true"),
    "search_conversations": ("conversations", "from:user after:2024-01-02", "contains(role, 'user') AND date >= TIMESTAMP '2024-01-02'"),
    "search_events": ("events", "from:user1 size:>100", "contains(from_name, 'user1') AND length > 100"),
}


def _search(name: str):
    view, text, condition = SEARCHES[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search(getattr(views, view)(spark, sf_dir), text, bodies=name != "search_metadata_only")
        return found.select("offset", "length", plain_date())

    run.__name__ = name
    table = {"documents": ("doc", D), "conversations": ("conv", C), "events": ("ev", E)}[view]
    query(f'WITH {table[1]} SELECT "offset", length, CAST(date AS TIMESTAMP) AS date FROM {table[0]} WHERE {condition}')(run)


for _name in SEARCHES:
    _search(_name)


@query(f"""WITH {C} SELECT "offset", length, date, role AS sender, subject, message_id, CASE WHEN turn > 0 THEN '<c' || conv_id || '.t' || (turn - 1) || '@chat.example>' END AS in_reply_to, CAST(turn AS INTEGER) AS n_references FROM conv""")
def scan_messages(spark, sf_dir):
    m = views.conversations(spark, sf_dir)
    return m.select("offset", "length", plain_date(), F.col("from.display_name").alias("sender"), "subject", "message_id", "in_reply_to", F.size("references").alias("n_references"))


@query(f"""WITH {D} SELECT "offset", length FROM doc WHERE source = 'src1'""")
def label_filter_exact(spark, sf_dir):
    return with_label(views.documents(spark, sf_dir), "src1").select("offset", "length")


@query(f"""WITH {D} SELECT "offset", length FROM doc WHERE contains(lower(text), 'the') AND length > 2048""")
def search_within_results(spark, sf_dir):
    m = views.documents(spark, sf_dir)
    return within(search(m, "size:>2kb"), search(m, "body:the")).select("offset", "length")


@query(f"""WITH {D} SELECT "offset", length FROM doc WHERE "offset" IN (SELECT "offset" FROM doc WHERE lang = 'de')""")
def marked_selection(spark, sf_dir):
    m = views.documents(spark, sf_dir)
    return within(m, with_label(m, "de")).select("offset", "length")


@query(f"""WITH {D} SELECT "offset", length FROM doc WHERE NOT EXISTS (SELECT 1 FROM doc x WHERE x."offset" = doc."offset" AND x.lang = 'de')""")
def unmarked_remainder(spark, sf_dir):
    m = views.documents(spark, sf_dir)
    return without(m, with_label(m, "de")).select("offset", "length")


# ---- aggregates ------------------------------------------------------------------------------


@query(f"""WITH {D} SELECT count(*) AS message_count, min(date) AS oldest, max(date) AS newest, count(*) FILTER (has_attachments) AS with_attachments, round(100.0 * count(*) FILTER (has_attachments) / count(*), 1)::DOUBLE AS attachment_percent, count(message_id) - count(DISTINCT message_id) AS duplicates, count(DISTINCT message_id) AS unique_ids FROM doc""")
def stats_summary(spark, sf_dir):
    return stats.summary(views.documents(spark, sf_dir)).withColumns({"oldest": F.col("oldest").cast("timestamp_ntz"), "newest": F.col("newest").cast("timestamp_ntz")})


@query(f"""WITH {E} SELECT from_name || ' <' || from_name || '@events.example>' AS sender, count(*) AS count FROM ev GROUP BY from_name ORDER BY count DESC, sender LIMIT 10""")
def top_senders(spark, sf_dir):
    return stats.top_senders(views.events(spark, sf_dir))


@query(f"""WITH {D} SELECT label, count(*) AS count FROM (SELECT unnest([lang, source]) AS label FROM doc) GROUP BY label""")
def label_counts(spark, sf_dir):
    return stats.label_counts(views.documents(spark, sf_dir))


# ---- sets ------------------------------------------------------------------------------------


@query(f"""WITH {D} SELECT "offset", message_id FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY "offset") AS n FROM doc) WHERE n = 1""")
def dedup_first(spark, sf_dir):
    return merging.first_occurrences(views.documents(spark, sf_dir), ("sequence",)).select("offset", "message_id")


def _halves(spark, sf_dir):
    m = views.documents(spark, sf_dir)
    return [m.where("offset % 2 = 1"), m.where("offset % 2 = 0 or offset % 5 = 0")]


_HALVES_SQL = f"""{D}, halves AS (SELECT *, 0 AS ord FROM doc WHERE "offset" % 2 = 1 UNION ALL SELECT *, 1 FROM doc WHERE "offset" % 2 = 0 OR "offset" % 5 = 0)"""


@query(f"""WITH {_HALVES_SQL} SELECT "offset", ord AS mailbox_ord FROM (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY ord, "offset") AS n FROM halves) WHERE n = 1""")
def merge_dedup(spark, sf_dir):
    return merging.merge(_halves(spark, sf_dir)).select("offset", "mailbox_ord")


@query(f"""WITH {_HALVES_SQL} SELECT "offset", ord AS mailbox_ord FROM halves""")
def merge_concat(spark, sf_dir):
    return merging.merge(_halves(spark, sf_dir), dedup=False).select("offset", "mailbox_ord")


@query(f"""WITH {_HALVES_SQL} SELECT count(DISTINCT message_id) AS total_messages, count(*) - count(DISTINCT message_id) AS duplicates_removed, 2::BIGINT AS input_files, count(DISTINCT message_id) AS source_headers FROM halves""")
def merge_stats(spark, sf_dir):
    return merging.merge_stats(_halves(spark, sf_dir), True, True)


@query(f"""WITH {_HALVES_SQL} SELECT "offset", CASE ord WHEN 0 THEN 'odd' ELSE 'even' END AS source FROM halves""")
def merge_source_label(spark, sf_dir):
    names = spark.createDataFrame([(0, "odd"), (1, "even")], "mailbox_ord int, source string")
    return merging.merge(_halves(spark, sf_dir), dedup=False).join(F.broadcast(names), "mailbox_ord").select("offset", "source")


# ---- order -----------------------------------------------------------------------------------


def _sorted(name: str, by: str, descending: bool, sql: str):
    def run(spark, sf_dir):
        return ordering.ranked(views.documents(spark, sf_dir).select("offset", "sequence", "date", "from", "subject", "length"), ordering.sort_keys(by, descending)).select("offset", "rank")

    run.__name__ = name
    query(f"""WITH {D} SELECT "offset", row_number() OVER (ORDER BY {sql}, "offset") AS rank FROM doc""")(run)


_sorted("sort_date", "date", True, "date DESC")
_sorted("sort_from", "from", False, "lower(from_address)")
_sorted("sort_subject", "subject", False, "lower(subject)")
_sorted("sort_size", "size", True, "length DESC")


@query(f"""WITH {D} SELECT "offset", length FROM doc ORDER BY length DESC, "offset" LIMIT 25 OFFSET 50""")
def page_of_messages(spark, sf_dir):
    return ordering.page(views.documents(spark, sf_dir), 50, 25, "size").select("offset", "length")


# ---- threads ---------------------------------------------------------------------------------

_KEY = "CASE WHEN conv_id % 2 = 0 THEN CAST(conv_id AS VARCHAR) ELSE lower(regexp_replace(regexp_replace(o_subject, '^\\s+|\\s+$', '', 'g'), '^((re:|fwd:|fw:)\\s*)+', '', 'i')) END"
_THREADS = f"""{C}, th AS (SELECT conv.*, {_KEY} AS thread_key FROM conv JOIN (SELECT conv_id AS o_id, subject AS o_subject FROM conv WHERE turn = 0) ON o_id = conv_id)"""


@query(f"""WITH {_THREADS} SELECT "offset" AS sequence, thread_key, CAST(turn AS INTEGER) AS depth FROM th""")
def thread_nodes(spark, sf_dir):
    return threads.thread_nodes(views.conversations(spark, sf_dir)).select("sequence", "thread_key", "depth")


@query(f"""WITH {_THREADS} SELECT thread_key, arg_min(message_id, (date, "offset")) AS root_message_id, count(*) AS total_count, min(date) AS oldest, max(date) AS newest FROM th GROUP BY thread_key""")
def thread_summary(spark, sf_dir):
    return threads.thread_summary(views.conversations(spark, sf_dir)).select("thread_key", "root_message_id", "total_count", F.col("oldest").cast("timestamp_ntz").alias("oldest"), F.col("newest").cast("timestamp_ntz").alias("newest"))


@query(f"""WITH {_THREADS} SELECT "offset" AS sequence, thread_key, CAST(turn AS INTEGER) AS depth FROM th WHERE role = 'user'""")
def thread_visible_subset(spark, sf_dir):
    m = views.conversations(spark, sf_dir)
    return threads.visible(threads.thread_nodes(m), search(m, "from:user")).select("sequence", "thread_key", "depth")


# ---- functions -------------------------------------------------------------------------------


def _scalar(name: str, view: str, column: Callable[[], Column], sql: str):
    def run(spark, sf_dir):
        return getattr(views, view)(spark, sf_dir).select("offset", column().alias("value"))

    run.__name__ = name
    table = {"documents": ("doc", D), "conversations": ("conv", C), "events": ("ev", E)}[view]
    query(f"""WITH {table[1]} SELECT "offset", {sql} AS value FROM {table[0]}""")(run)


_SAFE = lambda c, n: f"CASE WHEN trim(replace(substr(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\-._@]', '_', 'g'), 1, {n}), '..', '_'), '.') = '' THEN 'unknown' ELSE trim(replace(substr(regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\-._@]', '_', 'g'), 1, {n}), '..', '_'), '.') END"
_CSV = lambda c: f"(CASE WHEN regexp_matches(g({c}), '[\",\\n\\r]') THEN '\"' || replace(g({c}), '\"', '\"\"') || '\"' ELSE g({c}) END)".replace(f"g({c})", f"(CASE WHEN regexp_matches({c}, '^[=+\\-@\\t\\r]') THEN '''' || {c} ELSE {c} END)")
_scalar("normalize_subject", "conversations", lambda: T.normalize_subject(F.col("subject")), "lower(regexp_replace(regexp_replace(subject, '^\\s+|\\s+$', '', 'g'), '^((re:|fwd:|fw:)\\s*)+', '', 'i'))")
_scalar("normalize_message_id", "documents", lambda: T.normalize_id(F.concat(F.lit(" <"), F.col("message_id"), F.lit("> "))), "md5(text)")
_scalar("address_display", "documents", lambda: T.address_display(F.col("from")), "source || ' <' || source || '@docs.example>'")
_scalar("filename_eml", "documents", lambda: export.eml_name(), f"strftime(date, '%Y%m%d_%H%M%S') || '_' || {_SAFE('from_address', 30)} || '_' || {_SAFE('subject', 80)} || '.eml'")
_scalar("filename_txt", "documents", lambda: export.text_name(), f"strftime(date, '%Y%m%d_%H%M%S') || '_' || {_SAFE('subject', 80)} || '.txt'")
_scalar("csv_rows", "documents", lambda: export.csv_line(), f"""strftime(date, '%Y-%m-%d %H:%M:%S') || ',' || source || ' <' || source || '@docs.example>,' || lang || ' <' || lang || '@lists.example>,' || coalesce(cc_name || ' <' || cc_address || '>', '') || ',' || {_CSV('subject')} || ',' || length || ',' || has_attachments || ',' || lang || '; ' || source || ',' || message_id""")
_scalar("html_escape", "documents", lambda: T.escape_html(F.col("body.text")), "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')")
_scalar("mbox_from_line", "documents", lambda: T.from_line(F.col("from.address"), F.col("date")), "'From ' || from_address || ' ' || strftime(date, '%a %b ') || lpad(CAST(day(date) AS VARCHAR), 2, ' ') || strftime(date, ' %H:%M:%S %Y')")
_scalar("from_quoting", "documents", lambda: F.md5(T.quote_from(F.concat(F.lit("From x\n"), F.col("body.text")))), "md5(regexp_replace('From x' || chr(10) || text, '(?m)^From ', '>From ', 'g'))")
_scalar("from_unquoting", "documents", lambda: F.md5(T.unquote_from(F.concat(F.lit(">>From x\n>From y\n"), F.col("body.text")))), "md5(regexp_replace('>>From x' || chr(10) || '>From y' || chr(10) || text, '(?m)^>(>*From )', '\\1', 'g'))")
_scalar("header_value_sanitize", "documents", lambda: T.header_value(F.col("body.text")), "trim(regexp_replace(text, '[\\x00-\\x1F\\x7F]', '', 'g'))")
_scalar("human_size", "documents", lambda: T.human_size(F.col("length")), "CASE WHEN length < 1024 THEN length || ' B' WHEN length < 1048576 THEN (CASE WHEN length % 1024 = 0 THEN CAST(length // 1024 AS VARCHAR) ELSE printf('%.2f', length / 1024.0::DOUBLE) END) || ' KiB' ELSE (CASE WHEN length % 1048576 = 0 THEN CAST(length // 1048576 AS VARCHAR) ELSE printf('%.2f', length / 1048576.0::DOUBLE) END) || ' MiB' END")
_scalar("group_labels", "documents", lambda: T.group_label(F.when(F.col("offset") % 2 == 0, F.lit(" ")).otherwise(F.lit(" g ")), F.concat(F.col("from.display_name"), F.lit("@GoogleGroups.com"))), "CASE WHEN \"offset\" % 2 = 0 THEN source ELSE 'g' END")
_scalar("body_match_count", "documents", lambda: F.size(T.body_matches(F.col("body.text"), "The")), "CAST(len(string_split(lower(text), 'the')) - 1 AS INTEGER)")
_scalar("rfc2047_decode", "documents", lambda: T.rfc2047_decode(F.concat(F.lit("=?utf-8?B?"), base64("subject"), F.lit("?= =?UTF-8?Q?_=C3=BC?="))), "subject || ' ü'")
_scalar("parse_mail_date", "documents", lambda: T.mail_date(F.concat(F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0100"))).cast("timestamp_ntz"), "CAST(date - INTERVAL 1 HOUR AS TIMESTAMP)")
_scalar("parse_address_list", "documents", lambda: F.array_join(F.transform(T.address_list(F.concat(F.lit('"Last, '), F.col("from.display_name"), F.lit('" <'), F.col("from.address"), F.lit(">, , b@x.example"))), T.address_display), "|"), "'Last, ' || source || ' <' || from_address || '>|b@x.example'")


@query(r"""SELECT page_id, unnest(regexp_extract_all(html, '(https?://[^\s>)"]*)', 1)) AS url FROM pages""")
def url_extract(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.explode(T.urls(F.col("html"))).alias("url"))


@query("SELECT page_id, true AS has_text, false AS has_script FROM pages")
def html_to_text_pages(spark, sf_dir):
    out = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.html_text("html").alias("t"))
    return out.select("page_id", (F.length("t") > 0).alias("has_text"), F.contains("t", F.lit("track(0)")).alias("has_script"))


@query("SELECT page_id, false AS has_script, false AS has_handler, contains(html, '<p>') AS has_paragraph FROM pages")
def html_sanitize_pages(spark, sf_dir):
    out = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.html_clean("html").alias("t"))
    return out.select("page_id", F.contains(F.lower("t"), F.lit("<script")).alias("has_script"), F.col("t").rlike(r"<[^>]*\son\w+=").alias("has_handler"), F.contains("t", F.lit("<p>")).alias("has_paragraph"))


@query(f"""WITH {D} SELECT "offset" AS index, strftime(date, '%Y-%m-%dT%H:%M:%S+00:00') AS date, from_address AS address, subject, message_id, length AS size FROM doc WHERE contains(from_address, 'src3')""")
def search_json(spark, sf_dir):
    doc = export.search_json(search(views.documents(spark, sf_dir), "from:src3"))
    item = "struct<index:bigint,date:string,from:struct<address:string,display_name:string>,subject:string,message_id:string,size:bigint>"
    rows = doc.select(F.explode(F.from_json("json", f"struct<result_count:bigint,results:array<{item}>>")["results"]).alias("r"))
    return rows.select("r.index", "r.date", F.col("r.from.address").alias("address"), "r.subject", "r.message_id", "r.size")


# ---- round trips -----------------------------------------------------------------------------


def _raw_mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw messages, every seventh with an attachment."""
    m = views.documents(spark, sf_dir)
    head = F.concat(F.lit("From: "), T.address_display(F.col("from")), F.lit("\nTo: "), F.col("to")[0]["address"], F.lit("\nSubject: =?utf-8?B?"), base64("subject"), F.lit("?=\nMessage-ID: "), F.col("message_id"), F.lit("\nDate: "), F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000\nX-Gmail-Labels: "), F.array_join("labels", ","), F.lit("\n"))
    text = F.concat(F.lit("Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), base64("body.text"), F.lit("\n"))
    name = F.concat(F.lit("doc-"), F.col("offset").cast("string"), F.lit(".txt"))
    parts = F.concat(F.lit("Content-Type: multipart/mixed; boundary=\"zz\"\n\n--zz\n"), text, F.lit("--zz\nContent-Type: application/octet-stream\nContent-Disposition: attachment; filename=\""), name, F.lit("\"\nContent-Transfer-Encoding: base64\n\n"), base64("subject"), F.lit("\n--zz--\n"))
    return m.withColumn("raw", F.encode(F.concat(head, F.when(F.col("has_attachments"), parts).otherwise(text), F.lit("\n")), "utf-8")).drop("body")


def _written_mbox(spark: SparkSession, sf_dir: str) -> str:
    path = os.path.join(tempfile.mkdtemp(prefix="lettermill-"), "docs.mbox")
    export.export_mbox(_raw_mails(spark, sf_dir), path)
    return path


@query(f"""WITH {D} SELECT row_number() OVER (ORDER BY "offset") - 1 AS sequence, from_address AS sender, trim(regexp_replace(subject, '\\s+$', '')) AS subject, message_id, date, has_attachments, lang || '|' || source AS labels FROM doc""")
def mbox_roundtrip(spark, sf_dir):
    m = read_mbox(spark, _written_mbox(spark, sf_dir), range_bytes=1 << 20)
    return m.select("sequence", F.col("from.address").alias("sender"), F.trim(F.regexp_replace("subject", r"\s+$", "")).alias("subject"), "message_id", plain_date(), "has_attachments", F.array_join("labels", "|").alias("labels"))


@query(f"""WITH {D} SELECT row_number() OVER (ORDER BY "offset") - 1 AS sequence, md5(text) AS text_md5 FROM doc""")
def body_roundtrip(spark, sf_dir):
    m = read_mbox(spark, _written_mbox(spark, sf_dir), range_bytes=1 << 20)
    return decode_bodies(m.drop("raw")).select("sequence", F.md5("body.text").alias("text_md5"))


@query(f"""WITH {D} SELECT from_address AS sender, message_id, date FROM doc WHERE "offset" < 50""")
def eml_roundtrip(spark, sf_dir):
    where = tempfile.mkdtemp(prefix="lettermill-")
    export.write_files(export.eml_files(_raw_mails(spark, sf_dir).where("offset < 50")), where)
    return read_eml(spark, where).select(F.col("from.address").alias("sender"), "message_id", plain_date())


def _shared_folder(spark: SparkSession) -> str:
    """A new folder that the executors share: below ``spark.checkpoint.dir`` if that is a path of files."""
    root = spark.conf.get("spark.checkpoint.dir", None) or ""
    root = root.removeprefix("file://") if root.startswith(("/", "file:///")) else None
    if root:
        os.makedirs(root, exist_ok=True)
    return tempfile.mkdtemp(prefix="lettermill-", dir=root or None)


@query(f"""WITH {D} SELECT from_address AS sender, message_id, date FROM doc""")
def eml_roundtrip_all(spark, sf_dir):
    where = _shared_folder(spark)
    export.write_files(export.eml_files(_raw_mails(spark, sf_dir)), where)
    return read_eml(spark, where).select(F.col("from.address").alias("sender"), "message_id", plain_date())


@query(f"""WITH {D} SELECT row_number() OVER (ORDER BY "offset") - 1 AS sequence, filename, CAST(strlen(subject) AS BIGINT) AS size FROM doc QUALIFY has_attachments""")
def attachments_list(spark, sf_dir):
    m = read_mbox(spark, _written_mbox(spark, sf_dir), range_bytes=1 << 20)
    return decode_bodies(m.where("has_attachments").drop("raw")).select("sequence", F.explode("body.attachments").alias("a")).select("sequence", "a.filename", "a.size")
