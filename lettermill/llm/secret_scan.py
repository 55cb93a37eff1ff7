"""Secret scans: candidates from the text, false positives removed by a random forest.

All of it is DataFrame and SQL functions and Spark ML. A candidate is a run of ``[A-Za-z0-9_+/-]`` of
16 characters or more with a digit. Only texts that hold one are cut into words. The forest sees
length, character classes, transitions between them and along the alphabet, coverage by dictionary
pieces, path shape, and the words around; it learns from a table of labelled findings of bounded size.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"(?<![\w+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{16,}"
LABELLED = 4000
#: Words that go with secrets, and pieces of dictionary words.
SECRET_WORDS = r"(?i)(token|secret|passw|api.?key|apikey|access.?key|credential|bearer|auth|private)"
INNOCENT_WORDS = r"(?i)(commit|sha1|sha256|md5|checksum|digest|hash|version|revision|uuid|guid|file|path|build|order|invoice|phone|card|account|example|test)"
DICTIONARY = "tion|ment|name|test|file|data|user|page|date|time|list|item|home|index|image|version|build|report|final|draft|chapter|section|table|figure|config|main|base|local|temp|backup|server|client|public|static|assets|src|lib|the|and|for|with|from|that|this|ing|ent|est|ver|her"
FEATURES = ("length", "digits", "uppers", "lowers", "marks", "hex", "only_digits", "switches", "repeats", "steps", "distinct", "coverage", "vowels", "slashes", "extension", "dashes", "before_secret", "before_innocent", "assigned", "quoted", "after_innocent")


def features(token: Column, before: Column, after: Column, word: Column) -> dict[str, Column]:
    """Features of a candidate from itself, the text before and after it, and the word that holds it."""
    n = F.length(token).cast("double")
    share = lambda pattern: F.regexp_count(token, F.lit(pattern)) / n
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    left = F.concat_ws(" ", before, F.split_part(word, token, F.lit(1)))
    # two adjacent equal characters, and two that follow each other in the alphabet
    repeats = r"(?=(.)\1)"
    steps = "(?=" + "|".join(a + b for s in ("0123456789", "abcdefghijklmnopqrstuvwxyz") for a, b in zip(s, s[1:])) + ")"
    return {
        "length": n,
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "lowers": share("[a-z]"),
        "marks": share("[_+/-]"),
        "hex": flag(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        "only_digits": flag(token.rlike("^[0-9]+$")),
        "switches": share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"),
        "repeats": share(repeats),
        "steps": F.regexp_count(F.lower(token), F.lit(steps)) / n,
        "distinct": F.size(F.array_distinct(F.split(token, ""))) / n,
        "coverage": (n - F.length(F.regexp_replace(F.lower(token), DICTIONARY, ""))) / n,
        "vowels": share("(?i)[aeiou]"),
        "slashes": F.regexp_count(word, F.lit("/")).cast("double"),
        "extension": flag(word.rlike(r"\.[a-z]{2,4}\W*$")),
        "dashes": F.regexp_count(token, F.lit("-")).cast("double"),
        "before_secret": flag(left.rlike(SECRET_WORDS)),
        "before_innocent": flag(left.rlike(INNOCENT_WORDS)),
        "assigned": flag(left.rlike(r"[=:]\s*[\"']?\s*$")),
        "quoted": flag(left.rlike(r"[\"']$")),
        "after_innocent": flag(after.rlike(INNOCENT_WORDS)),
    }


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, nth, token, before, after, word): the candidates of every whole text, with the two words before and the one after."""
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(CANDIDATE))
    words = found.select("id", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("words"))
    # only the places of words with a candidate are exploded
    places = words.select("id", "words", F.explode(F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).rlike(CANDIDATE))).alias("place"))
    near = places.select("id", "place", F.get("words", F.col("place")).alias("word"), F.concat_ws(" ", F.get("words", F.col("place") - 2), F.get("words", F.col("place") - 1)).alias("before"), F.coalesce(F.get("words", F.col("place") + 1), F.lit("")).alias("after"))
    return near.select("id", "place", "before", "after", "word", F.posexplode(F.regexp_extract_all("word", F.lit(CANDIDATE), F.lit(0))).alias("nth", "token"))


def train(labelled: DataFrame, trees: int = 40, depth: int = 7, most: int = LABELLED) -> RandomForestClassificationModel:
    """A forest from labelled findings (token, before, after, word, label 0 or 1), ``most`` of them at most, chosen by hash."""
    bounded = labelled.orderBy(F.xxhash64("token", "before")).limit(most).coalesce(1)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(bounded.withColumns(features(*(F.col(c) for c in ("token", "before", "after", "word")))))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, featureSubsetStrategy="sqrt").fit(rows.select("features", F.col("label").cast("double").alias("label")))


def scan(docs: DataFrame, model: RandomForestClassificationModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, place, nth, token, probability, is_secret) of every candidate: ``place`` is the word's number in the text, ``nth`` the candidate's in the word.

    A null or empty text has none; a null id is kept; repeated rows repeat theirs. Other columns are ignored.
    """
    found = candidates(docs, id_col, text_col)
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found.withColumns(features(*(F.col(c) for c in ("token", "before", "after", "word")))))
    scored = model.transform(rows.select("id", "place", "nth", "token", "features")).withColumn("probability", F.round(vector_to_array("probability")[1], 6))
    return scored.select("id", "place", "nth", "token", "probability", (F.col("probability") >= threshold).alias("is_secret"))


def example_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """Invented labelled findings: secrets of common shapes in their usual surroundings, and what is mistaken for them."""
    i = F.col("id")
    h = lambda salt: F.sha2(F.concat(F.lit(salt), i.cast("string")), 256)
    b64 = lambda salt, size: F.substring(F.translate(F.base64(F.unhex(h(salt))), "=", "A"), 1, size)
    pick = lambda salt, *values: F.element_at(F.array(*map(F.lit, values)), (F.abs(F.xxhash64(F.lit(salt), i)) % len(values) + 1).cast("int"))
    word = lambda salt: pick(salt, "the", "and", "other", "report", "value", "que", "der", "nation", "", "uses", "near")
    key = pick("k", "token", "secret", "api_key", "password", "access_key", "auth", "bearer", "TOKEN")
    digits = lambda salt, size: F.substring(F.regexp_replace(F.concat(h(salt), h(salt + "x")), "[a-f]", ""), 1, size)
    secrets = F.element_at(F.array(F.substring(h("a"), 1, 40), F.upper(F.substring(h("b"), 1, 40)), F.substring(h("c"), 1, 32), b64("d", 40), b64("e", 24), F.concat(F.lit("ghp_"), b64("f", 36)), F.concat(F.lit("AKIA"), F.upper(F.substring(b64("g", 30), 1, 16))), F.concat(F.lit("sk-"), b64("h", 40))), (F.abs(F.xxhash64(F.lit("s"), i)) % 8 + 1).cast("int"))
    name = lambda salt: pick(salt, "report", "chapter", "index", "version", "image", "section", "draft", "final", "backup")
    others = F.element_at(F.array(digits("m", 16), F.concat_ws("-", name("n1"), name("n2"), digits("n3", 4)), F.concat_ws("/", F.lit("src"), name("o1"), name("o2"), digits("o3", 3)), F.concat(name("p1"), F.lit("_"), name("p2"), F.lit("_"), digits("p3", 8)), F.concat_ws("-", *(F.substring(h("q"), a, b) for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.substring(h("r"), 1, 40), F.concat(F.lit("2024-0"), digits("t", 1), F.lit("-1"), digits("t2", 1), F.lit("-"), name("t3")), digits("v", 18)), (F.abs(F.xxhash64(F.lit("o"), i)) % 8 + 1).cast("int"))
    label = (i % 2).cast("int")
    glue = pick("g", '"', "'", "", '"')
    tail = F.concat(glue, pick("w", "", "!!", "###", ",", "."))
    joined = i % 4 == 1  # key="..." in one word
    head = F.when((label == 1) & joined, F.concat(key, F.lit("="), glue)).when(label == 1, glue).otherwise(F.lit(""))
    before = F.when((label == 1) & joined, F.concat_ws(" ", word("b1"), word("b2"))).when(label == 1, F.concat_ws(" ", key, pick("e", "=", ":", "="))).otherwise(F.concat_ws(" ", word("b3"), F.when(others == F.substring(h("r"), 1, 40), pick("c", "commit", "sha1", "checksum", "digest")).otherwise(pick("b4", "the", "file", "order", "see", "and", "card", "de", "is", ""))))
    rows = spark.range(0, n, 1, 1).select(label.alias("label"), F.when(label == 1, secrets).otherwise(others).alias("token"), before.alias("before"), word("a1").alias("after"), head.alias("head"), F.when(label == 1, tail).otherwise(F.lit("")).alias("tail"))
    return rows.select("token", "before", "after", F.concat("head", "token", "tail").alias("word"), "label")
