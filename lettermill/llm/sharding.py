"""Sharding by extendible hashing.

A directory is indexed by the first bits of a 60-bit hash. Byte sums of the directory's cells tell,
from depth 0 on, which buckets are above the limit; only those split on another bit. ``ROUND_BITS``
bits are looked at in one round; a bucket that still is too large after them enters the next one.
All steps are DataFrame operations.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import stage

HASH_BITS = 60
ROUND_BITS = 12


def hash_bits(id_col: str, text_col: str) -> Column:
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))))
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("long")


def split_depths(cells: DataFrame, bits: int, shallowest: int, limit: int) -> DataFrame:
    """``cells`` (prefix of ``bits`` bits, bytes) with the least depth from ``shallowest`` on at which their bucket fits; null if none does."""
    depths = range(shallowest, bits + 1)
    sums = cells.withColumns({f"at_{d}": F.sum("bytes").over(Window.partitionBy(F.expr(f"shiftright(prefix, {bits - d})"))) for d in depths})
    return sums.select("prefix", F.coalesce(*(F.when(F.col(f"at_{d}") <= limit, F.lit(d)) for d in depths)).alias("depth"))


def shard(docs: DataFrame, limit: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8 bytes of the text, 0 for a null), shard (its bucket's hash bits) and depth.

    The bytes of a shard never exceed ``limit``, but for a single document that does so alone. Rows that are equal
    in id and text cannot be told apart by any bit: if together they are above the limit, they fill shards
    of their own, whose names end in a number. Other columns stay, unless one is called n_bytes, shard or depth. An empty
    table gives none.
    """
    hashed = docs.withColumns({"n_bytes": F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long"), "__hash": hash_bits(id_col, text_col)})
    rest = stage(hashed.groupBy(F.col("__hash").alias("hash")).agg(F.sum("n_bytes").alias("bytes")), "hashes")
    directories: list[tuple[int, DataFrame]] = []
    bits, more = 0, True
    while more and bits < HASH_BITS:
        shallowest, bits = bits, bits + ROUND_BITS
        cells = rest.groupBy(F.expr(f"shiftright(hash, {HASH_BITS - bits})").alias("prefix")).agg(F.sum("bytes").alias("bytes"))
        found = stage(split_depths(cells, bits, shallowest, limit), "directory")
        directories.append((bits, found.where("depth is not null")))
        large = found.where("depth is null").select("prefix")
        more = not large.isEmpty()
        if more:
            rest = rest.join(large, F.expr(f"shiftright(hash, {HASH_BITS - bits})") == large["prefix"], "left_semi")
    out = hashed
    for bits, directory in directories:
        named = directory.select(F.col("prefix").alias(f"__p{bits}"), F.col("depth").alias(f"__d{bits}"))
        if bits == ROUND_BITS:
            named = F.broadcast(named)  # 2**ROUND_BITS rows at most
        out = out.join(named, F.expr(f"shiftright(__hash, {HASH_BITS - bits})") == F.col(f"__p{bits}"), "left")
    depth = F.coalesce(*(F.col(f"__d{bits}") for bits, _ in directories))
    out = out.withColumn("depth", F.coalesce(depth, F.lit(HASH_BITS))).drop(*(f"__{x}{bits}" for bits, _ in directories for x in "pd"))
    name = F.expr(f"if(depth = 0, '', lpad(bin(shiftright(__hash, {HASH_BITS} - depth)), depth, '0'))")
    out = out.withColumn("shard", name)
    if more:  # hashes that are too large alone
        alone = large
        few = out.where(f"depth = {HASH_BITS}").join(alone, F.col("__hash") == alone["prefix"], "left_semi")
        others = out.join(alone, F.col("__hash") == alone["prefix"], "left_anti")
        in_one = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("n_bytes"), F.lit(1))))
        number = F.floor((F.row_number().over(Window.partitionBy("__hash").orderBy("n_bytes")) - 1) / in_one).cast("long")
        few = few.withColumn("shard", F.concat("shard", F.lit("-"), number.cast("string")))
        out = reduce(DataFrame.unionByName, [others, few])
    return out.drop("__hash")
