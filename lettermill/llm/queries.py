"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contaminated
from .jaccard_join import jaccard_components
from .line_dedup import dedup_lines
from .mixing import mix
from .quality_rules import judge
from .secret_scan import example_findings, scan, train
from .sharding import shard
from .suffix_dedup import remove_repeats
from .token_counts import with_token_counts
from .warc import derivatives, responses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "n_shingles", "component_id")


WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

ORACLE["op7_jaccard_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
reach AS (SELECT u AS node, u AS seen FROM (SELECT DISTINCT u FROM links)
  UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(c.c, w.doc_id) AS BIGINT) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(seen) AS c FROM reach GROUP BY node) c USING (doc_id)
"""


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return with_token_counts(docs, _tokenizer()).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return judge(docs, keep_text=False).select("doc_id", "measures.n_words", "measures.word_chars", "measures.n_symbols", "measures.n_dup_lines", "measures.n_repeat_words", "base_failed", "kept")


def _rule_sql(name: str, condition: str) -> str:
    """A host's shrunk rate of a rule with its deviation, and its tier: 0 suspect, 1 neither, 2 trusted."""
    return f"""
  {name}_h AS (SELECT source, count(*) AS n, count(*) FILTER ({condition}) AS k FROM m GROUP BY source),
  {name}_p AS (SELECT avg(k / n) AS mu, var_pop(k / n) AS v FROM {name}_h),
  {name}_s AS (SELECT mu, CASE WHEN mu <= 0 OR mu >= 1 THEN 1.0 WHEN v = 0 THEN 1e12 ELSE greatest(1e-6, mu * (1 - mu) / v - 1) END AS st FROM {name}_p),
  {name}_r AS (SELECT source, mu, st, n, (k + mu * st) / (n + st) AS rate FROM {name}_h, {name}_s),
  {name}_t AS (SELECT source, rate - 0.5 * sqrt(rate * (1 - rate) / (n + st + 1)) > 0.5 AS condemned,
    CASE WHEN rate - 0.5 * sqrt(rate * (1 - rate) / (n + st + 1)) > mu THEN 0 WHEN rate + 0.5 * sqrt(rate * (1 - rate) / (n + st + 1)) < mu THEN 2 ELSE 1 END AS tier FROM {name}_r)"""


RULE_SQL = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "n_symbols > 0.1::DOUBLE * n_words",
    "lines": "n_dup_lines > 0.2::DOUBLE * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
ORACLE["op1_quality_rules"] = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
  g AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, ws FROM w WHERE len(ws) > 7),
  g2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i:i + 7]) AS c FROM g),
  g3 AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM g2 WHERE c > 1) GROUP BY doc_id),
  l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM w),
  m AS (SELECT w.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words,
      CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
      len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
    FROM w JOIN l USING (doc_id) LEFT JOIN g3 USING (doc_id)),{",".join(_rule_sql(k, v) for k, v in RULE_SQL.items())}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({RULE_SQL["short"]} OR {RULE_SQL["repeats"]}) AS base_failed,
  NOT ({RULE_SQL["short"]} OR {RULE_SQL["repeats"]} OR a.condemned OR b.condemned OR c.condemned OR d.condemned OR e.condemned
    OR n_symbols > ([0.05, 0.1, 0.2])[c.tier + 1]::DOUBLE * n_words OR n_dup_lines > ([0.1, 0.2, 0.3])[d.tier + 1]::DOUBLE * n_lines
    OR word_chars < ([3.5, 3.0, 2.5])[e.tier + 1]::DOUBLE * n_words OR word_chars > ([9.0, 10.0, 12.0])[e.tier + 1]::DOUBLE * n_words) AS kept
FROM m JOIN short_t a ON a.source IS NOT DISTINCT FROM m.source JOIN repeats_t b ON b.source IS NOT DISTINCT FROM m.source
  JOIN symbols_t c ON c.source IS NOT DISTINCT FROM m.source JOIN lines_t d ON d.source IS NOT DISTINCT FROM m.source
  JOIN word_length_t e ON e.source IS NOT DISTINCT FROM m.source
"""


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE["op9_mixing"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS sid, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0))::DOUBLE AS level
  FROM w WINDOW o AS (ORDER BY source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT sid, source, source_size, CASE WHEN weight * level > 3 * source_size THEN (3 * source_size)::DOUBLE
    ELSE least(weight * (SELECT arg_min(level, source_size / weight) FROM l WHERE weight * level <= 3 * source_size), (3 * source_size)::DOUBLE) END AS target FROM l),
x AS (SELECT d.*, t.sid, t.source_size, t.target, length(bin(size)) AS o, 16 * (length(bin(size)) - 1) + ((size << 5) >> length(bin(size))) AS k FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
classes AS (SELECT sid, target, o, k, count(*) AS n, sum(size) AS words FROM x WHERE size > 0 GROUP BY ALL),
levels AS (SELECT sid, k, (target - 3 * coalesce(sum(words) OVER (PARTITION BY sid ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / (sum(k * words) OVER (PARTITION BY sid ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM classes),
f AS (SELECT sid, arg_max(level, k) AS c FROM levels WHERE level * k <= 3 GROUP BY sid),
e AS (SELECT x.*, CASE WHEN c IS NULL THEN 3::DOUBLE ELSE least(3::DOUBLE, c * k) END AS copies FROM x LEFT JOIN f USING (sid)),
odds AS (SELECT *, copies - floor(copies) AS p, u / (1 - u) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) AS odds FROM e),
ranks AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN least(CAST(floor(odds / (1 + odds) * 4096) AS INTEGER), 4095) END AS cell FROM odds),
g0 AS (SELECT sid, o, sum(n * p) AS number, sum(words * p) AS words, sum(words) AS all_words FROM (SELECT sid, o, k, p, count(*) AS n, sum(size) AS words FROM ranks WHERE cell IS NOT NULL GROUP BY ALL) GROUP BY sid, o),
g1 AS (SELECT g0.*, source, coalesce(sum(words) OVER b, 0) AS below, coalesce(sum(all_words) OVER b, 0) - coalesce(sum(words) OVER b, 0) AS spare
  FROM g0 JOIN t USING (sid) WINDOW b AS (PARTITION BY sid ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT sid, o, number, words, CASE WHEN 2::DOUBLE ** o <= least(below, spare) THEN CAST('0x' || substr(md5('mix|' || coalesce(source, '') || '|' || o), 1, 13) AS BIGINT) / 4503599627370496::DOUBLE ELSE 0.5::DOUBLE END AS start FROM g1),
ends AS (SELECT sid, o, cell, sum(n) OVER b AS held, sum(words) OVER b AS drawn FROM (SELECT sid, o, cell, count(*) AS n, sum(size) AS words FROM ranks WHERE cell IS NOT NULL GROUP BY ALL)
  WINDOW b AS (PARTITION BY sid, o ORDER BY cell) UNION ALL SELECT sid, o, -1, 0, 0 FROM g),
fold AS (SELECT sid, 64 AS o, 0::DOUBLE AS carried, -1 AS cut FROM t
  UNION ALL SELECT fold.sid, fold.o - 1, CASE WHEN g.words IS NULL THEN fold.carried ELSE g.words + fold.carried - arg_min(drawn::DOUBLE, (abs(held - floor(g.number * (g.words + fold.carried) / g.words + g.start)), held)) END,
    coalesce(arg_min(cell, (abs(held - floor(g.number * (g.words + fold.carried) / g.words + g.start)), held)), -1)
  FROM fold LEFT JOIN g ON g.sid = fold.sid AND g.o = fold.o - 1 LEFT JOIN ends ON ends.sid = fold.sid AND ends.o = fold.o - 1 WHERE fold.o > 1 GROUP BY fold.sid, fold.o, fold.carried, g.words, g.number, g.start)
SELECT doc_id, size, source_size, target, CAST(CASE WHEN size > 0 THEN size * (floor(copies) + CASE WHEN coalesce(cell <= cut, false) THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM ranks LEFT JOIN fold ON fold.sid = ranks.sid AND fold.o = ranks.o
"""


@query
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return shard(docs).select("doc_id", "n_bytes", "shard", "depth")


ORACLE["op10_sharding"] = """
WITH h AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM documents),
d AS (SELECT *, sum(n_bytes) OVER (PARTITION BY depth, h >> (60 - depth)) AS held FROM h, (SELECT CAST(unnest(range(0, 25)) AS INTEGER) AS depth))
SELECT doc_id, any_value(n_bytes) AS n_bytes, CASE WHEN min(depth) = 0 THEN '' ELSE lpad(bin(any_value(h) >> (60 - min(depth))), min(depth), '0') END AS shard, min(depth) AS depth
FROM d WHERE held <= 33554432 GROUP BY doc_id
"""


@query
def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"), "first_word", "n_words")


@query
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, train(example_findings(spark))).withColumnRenamed("id", "doc_id")


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = derivatives(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return made.select("record_id", "warc_type", "refers_to", "target_uri", "date", "content_type", "payload_digest", "block_digest", F.col("fields")["WARC-Concurrent-To"].alias("concurrent_to"), F.decode("block", "utf-8").alias("block"))
