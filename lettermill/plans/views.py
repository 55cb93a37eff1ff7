"""The test tables in the shape of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MESSAGE_COLUMNS = ["mailbox", "offset", "sequence", "length", "date", "from", "to", "cc", "subject", "message_id", "in_reply_to", "references", "has_attachments", "content_type", "text_size", "labels", "thread_id", "body"]


def address(name: Column, at: str) -> Column:
    return F.struct(name.alias("display_name"), F.concat(name, F.lit(at)).alias("address"))


def body(text: Column, attachments: Column | None = None) -> Column:
    kind = "array<struct<filename:string,content_type:string,size:bigint>>"
    return F.struct(text.alias("text"), F.lit(None).cast("string").alias("html"), F.lit("").alias("raw_headers"), (F.array().cast(kind) if attachments is None else attachments).alias("attachments"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _finish(df: DataFrame, name: str) -> DataFrame:
    none = F.lit(None).cast("string")
    defaults = {"mailbox": F.lit(name), "sequence": F.col("offset"), "in_reply_to": none, "references": F.array().cast("array<string>"), "has_attachments": F.lit(False), "content_type": F.lit("text/plain"), "text_size": F.lit(0).cast("long"), "thread_id": none, "to": F.array().cast("array<struct<display_name:string,address:string>>"), "cc": F.array().cast("array<struct<display_name:string,address:string>>")}
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns}).select(*MESSAGE_COLUMNS)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation is a thread: each turn answers the one before."""
    c = _table(spark, sf_dir, "conversations")
    opening = c.where("turn = 0").select("conv_id", F.substring("text", 1, 60).alias("opening"))
    mid = lambda turn: F.concat(F.lit("<c"), F.col("conv_id").cast("string"), F.lit(".t"), turn.cast("string"), F.lit("@chat.example>"))
    turn = F.col("turn").cast("int")
    m = c.join(opening, "conv_id").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("offset"),
        F.col("text").alias("t"),
        F.length("text").cast("long").alias("length"),
        (F.expr("timestampadd(HOUR, cast(conv_id as int), timestamp '2024-01-01 00:00:00')") + F.make_interval(mins=turn)).alias("date"),
        address(F.col("role"), "@chat.example").alias("from"),
        F.array(address(F.lit("list"), "@chat.example")).alias("to"),
        F.when(turn > 0, F.concat(F.lit("Re: "), F.coalesce("opening", F.lit("")))).otherwise(F.coalesce("opening", F.lit(""))).alias("subject"),
        mid(turn).alias("message_id"),
        F.when(turn > 0, mid(turn - 1)).alias("in_reply_to"),
        F.when(turn > 0, F.transform(F.sequence(F.lit(0), turn - 1), mid)).otherwise(F.array().cast("array<string>")).alias("references"),
        F.array("role").alias("labels"),
        F.when(F.col("conv_id") % 2 == 0, F.col("conv_id").cast("string")).alias("thread_id"),
    )
    return _finish(m.withColumn("body", body(F.col("t"))), "conversations")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document is a mail from its source; equal texts have equal ids."""
    d = _table(spark, sf_dir, "documents")
    flagged = F.col("doc_id") % 7 == 0
    attached = F.array(F.struct(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), F.lit("text/plain").alias("content_type"), F.col("n_chars").alias("size")))
    kind = "array<struct<filename:string,content_type:string,size:bigint>>"
    m = d.select(
        F.col("doc_id").alias("offset"),
        F.col("n_chars").alias("length"),
        F.expr("timestampadd(DAY, cast(doc_id % 1500 as int), timestamp '2020-01-01 00:00:00')").alias("date"),
        address(F.col("source"), "@docs.example").alias("from"),
        F.array(address(F.col("lang"), "@lists.example")).alias("to"),
        F.when(F.col("doc_id") % 3 == 0, F.array(address(F.concat(F.lit("cc-"), F.col("source")), "@docs.example"))).otherwise(F.array().cast("array<struct<display_name:string,address:string>>")).alias("cc"),
        F.substring(F.split_part("text", F.lit("\n"), F.lit(1)), 1, 80).alias("subject"),
        F.concat(F.lit("<"), F.md5("text"), F.lit(">")).alias("message_id"),
        flagged.alias("has_attachments"),
        F.array("lang", "source").alias("labels"),
        body(F.col("text"), F.when(flagged, attached).otherwise(F.array().cast(kind))).alias("body"),
    )
    return _finish(m, "documents")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event is a mail from its user."""
    e = _table(spark, sf_dir, "events")
    m = e.select(
        F.col("event_id").cast("long").alias("offset"),
        F.floor(F.col("value") * 1000).cast("long").alias("length"),
        F.col("ts").cast("timestamp").alias("date"),
        address(F.concat(F.lit("user"), F.col("user_id").cast("string")), "@events.example").alias("from"),
        F.col("event_type").alias("subject"),
        F.concat(F.lit("<e"), F.col("event_id").cast("string"), F.lit(">")).alias("message_id"),
        F.array("event_type").alias("labels"),
        body(F.col("props").cast("string")).alias("body"),
    )
    return _finish(m, "events")


# ---- the same in DuckDB SQL, written from the tables ----------------------------------------

CONVERSATIONS_SQL = """conv AS (SELECT c.conv_id * 1000 + c.turn AS "offset", c.conv_id, c.turn, c.role, c.text, CAST(length(c.text) AS BIGINT) AS length,
  TIMESTAMP '2024-01-01' + to_hours(CAST(c.conv_id AS BIGINT)) + to_minutes(CAST(c.turn AS BIGINT)) AS date,
  CASE WHEN c.turn > 0 THEN 'Re: ' ELSE '' END || coalesce(substr(o.text, 1, 60), '') AS subject,
  '<c' || c.conv_id || '.t' || c.turn || '@chat.example>' AS message_id
  FROM conversations c JOIN conversations o ON o.conv_id = c.conv_id AND o.turn = 0)"""
DOCUMENTS_SQL = """doc AS (SELECT doc_id AS "offset", n_chars AS length, source, lang, text, source AS from_name, source || '@docs.example' AS from_address,
  lang AS to_name, lang || '@lists.example' AS to_address, CASE WHEN doc_id % 3 = 0 THEN 'cc-' || source END AS cc_name,
  CASE WHEN doc_id % 3 = 0 THEN 'cc-' || source || '@docs.example' END AS cc_address, substr(split_part(text, chr(10), 1), 1, 80) AS subject,
  '<' || md5(text) || '>' AS message_id, doc_id % 7 = 0 AS has_attachments, CASE WHEN doc_id % 7 = 0 THEN 'doc-' || doc_id || '.txt' END AS filename,
  TIMESTAMP '2020-01-01' + to_days(CAST(doc_id % 1500 AS INTEGER)) AS date FROM documents)"""
EVENTS_SQL = """ev AS (SELECT CAST(event_id AS BIGINT) AS "offset", CAST(floor(value * 1000) AS BIGINT) AS length, ts AS date, 'user' || user_id AS from_name, event_type FROM events)"""
