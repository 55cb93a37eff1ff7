"""A Parquet index of a mailbox with a manifest that tells whether it is still fresh."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import INDEX_VERSION, RANGE_BYTES, InvalidIndex
from .files import file_size, local, modified_ns, open_file
from .mbox import read_mbox

PREFIX_BYTES = 4096


def freshness(path: str) -> dict:
    """What a mailbox must still be for its index to hold."""
    with open_file(path) as f:
        prefix = hashlib.sha256(f.read(PREFIX_BYTES)).hexdigest()
    return {"version": INDEX_VERSION, "path": path, "size": file_size(path), "mtime_ns": modified_ns(path), "prefix_sha256": prefix}


def index_path(mailbox: str, cache: str | None = None) -> str:
    """Beside the mailbox; in the cache folder, by a hash of the path, where that cannot be written."""
    folder, name = os.path.split(os.path.abspath(local(mailbox) or mailbox))
    if os.access(folder, os.W_OK):
        return os.path.join(folder, f".{name}.index")
    root = cache or os.path.join(os.environ.get("XDG_CACHE_HOME", os.path.expanduser("~/.cache")), "lettermill")
    return os.path.join(root, hashlib.sha256(mailbox.encode()).hexdigest())


def index_size(where: str) -> int:
    """Bytes of the index's files."""
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(where) for f in files)


def load_index(spark: SparkSession, mailbox: str, where: str | None = None) -> DataFrame | None:
    """The indexed messages; null where there is no index, or one of another version, file, time or content, or with rows beyond the file."""
    where = where or index_path(mailbox)
    manifest = os.path.join(where, "manifest.json")
    if not os.path.exists(manifest):
        return None
    try:
        with open(manifest, encoding="utf-8") as f:
            kept = json.load(f)
    except ValueError as e:
        raise InvalidIndex(f"{manifest}: {e}") from e
    if not isinstance(kept, dict) or {k: kept.get(k) for k in freshness(mailbox)} != freshness(mailbox):
        return None
    rows = spark.read.parquet(os.path.join(where, "messages"))
    found = rows.agg(F.count("*").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).first()
    if found["n"] != kept.get("row_count") or (found["end"] or 0) > kept["size"]:
        return None
    return rows


def build_index(spark: SparkSession, mailbox: str, force: bool = False, where: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The index if it is fresh, else a new one from a header scan. It is written aside and then put in place, so a canceled build leaves nothing.

    Give the job a tag (``spark.addTag``) to cancel it with ``spark.interruptTag``.
    """
    where = where or index_path(mailbox)
    if not force and (rows := load_index(spark, mailbox, where)) is not None:
        return rows
    before = freshness(mailbox)
    temporary = f"{where}.{uuid.uuid4().hex}.tmp"
    try:
        read_mbox(spark, mailbox, range_bytes=range_bytes).drop("raw").sortWithinPartitions("offset").write.parquet(os.path.join(temporary, "messages"))
        count = spark.read.parquet(os.path.join(temporary, "messages")).count()
        with open(os.path.join(temporary, "manifest.json"), "w", encoding="utf-8") as f:
            json.dump(before | {"row_count": count}, f)
        shutil.rmtree(where, ignore_errors=True)
        os.replace(temporary, where)
    finally:
        shutil.rmtree(temporary, ignore_errors=True)
    return spark.read.parquet(os.path.join(where, "messages"))
