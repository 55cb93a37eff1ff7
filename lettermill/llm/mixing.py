"""Mixing sources to target weights by Pareto order sampling.

A document's expected number of copies grows with its size: min(3, c k), where k is about 16 (1 + log2 of its
words) and c is chosen for each source so that the expected words are the source's target. The whole
part are certain copies. The fraction is the inclusion probability p of one copy more, drawn in samples of fixed
size: documents of one octave of sizes rank by their random odds divided by their inclusion odds,
(u / (1 - u)) / (p / (1 - p)), and the first n have it. n is the sum of their p, rounded up or down at random so that
odds are kept in small octaves too, but to the nearest number where the smaller documents could not make up for one document. Octaves go from the large
sizes to the small ones, and the words by which one misses what was expected of it are added to what the next one is to draw,
so a source's sum comes near its target although each sample has a fixed size.
u is a hash of id and text, so reruns agree.

Ranks are counted in ``CELLS`` cells for each octave, and a sample ends at the cell's end that is nearest to its size, so
no source is ever sorted, or seen by one task, as a whole.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import ranked
from .stage import stage

CELLS = 4096
OCTAVES = 64
MOST_COPIES = 3
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST_COPIES) -> DataFrame:
    """``sizes`` (source, source_size) with each source's weight and target.

    Sources by code point, null last, weigh ``weights`` over and over and share the sum of all sizes;
    targets stop at ``most`` times the source's size and the excess is shared again by weight, until none is above.
    Each sharing is one aggregation over the sources.
    """
    place = (F.col("rank") - 1) % len(weights) + 1
    weight = F.element_at(F.array(*map(F.lit, weights)), place.cast("int")).cast("long")
    weighed = stage(ranked(sizes, [F.col("source").asc_nulls_last()]).select("source", "source_size", weight.alias("weight")), "weights")
    total, all_weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    limit = most * F.col("source_size")
    if total is None:
        return weighed.withColumn("target", F.lit(0.0))
    level, stopped = total / all_weights, 0
    while level is not None:
        now, size, weight_of = weighed.where(F.col("weight") * F.lit(level) > limit).agg(F.count("*"), F.sum("source_size"), F.sum("weight")).first()
        if now == stopped:
            break
        stopped = now
        level = (total - most * size) / (all_weights - weight_of) if all_weights > weight_of else None
    share = limit.cast("double") if level is None else F.least(F.col("weight") * F.lit(level), limit.cast("double"))
    return weighed.withColumn("target", share)


def random_key(id_col: str, text_col: str, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit(""))))


def uniform(key: Column) -> Column:
    """Strictly between 0 and 1, from 52 bits of a hex digest."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def octave(size: Column) -> Column:
    """Binary digits of a size."""
    return F.length(F.bin(size))


def size_class(size: str) -> Column:
    """16 classes in each octave; their numbers grow with the logarithm of the size."""
    digits = f"length(bin({size}))"
    return F.expr(f"16 * ({digits} - 1) + shiftright(shiftleft({size}, 5), {digits})").cast("long")


def expected(c: Column, k: Column) -> Column:
    """Expected copies of a document of class k."""
    return F.when(c.isNull(), F.lit(float(MOST_COPIES))).otherwise(F.least(F.lit(float(MOST_COPIES)), c * k))


def rank_cell(u: Column, p: Column) -> Column:
    """The cell of a document's rank: random odds by inclusion odds, brought between 0 and 1."""
    odds = F.try_divide(u / (1 - u), p / (1 - p))
    return F.least((odds / (1 + odds) * CELLS).cast("int"), F.lit(CELLS - 1))


def draw(classes: list[tuple[int, int, int, float]], cells: dict[int, list[tuple[int, int, int]]], starts: list[float]) -> list[int]:
    """The last cell that each octave's sample takes, -1 for none.

    ``classes`` are (octave, documents, words, p), ``cells`` hold (cell, documents, words) by octave, ``starts`` a random number for each octave.
    """
    cuts, carried = [-1] * OCTAVES, 0.0
    for o in sorted(cells, reverse=True):
        number = sum(n * p for at, n, _, p in classes if at == o)
        words = sum(w * p for at, _, w, p in classes if at == o)
        below = sum(w * p for at, _, w, p in classes if at < o)
        spare = sum(w for at, _, w, _ in classes if at < o) - below
        goal = words + carried
        start = starts[o] if 2**o <= min(below, spare) else 0.5
        wanted = math.floor(number * goal / words + start)
        best, taken, held, drawn = abs(wanted), 0, 0, 0
        for cell, n, w in sorted(cells[o]):
            held, drawn = held + n, drawn + w
            if abs(held - wanted) < best:
                best, taken, cuts[o] = abs(held - wanted), drawn, cell
        carried = goal - taken
    return cuts


def _starts(source: str, seed: str) -> list[float]:
    """A random number for each octave of a source."""
    return [int(hashlib.md5(f"{seed}|{source}|{o}".encode()).hexdigest()[:13], 16) / float(1 << 52) for o in range(OCTAVES)]


def _cuts(seed: str):
    def run(table: pa.Table) -> pa.Table:
        classes, cells = [], {}
        for r in table.to_pylist():
            if r["cell"] is None:
                classes.append((r["octave"], r["n"], r["words"], r["p"]))
            else:
                cells.setdefault(r["octave"], []).append((r["cell"], r["n"], r["words"]))
        source = table["source"][0].as_py()
        cuts = draw(sorted(classes), cells, _starts("" if source is None else str(source), seed))
        return pa.table({"source": table["source"][:1], "cuts": pa.array([cuts], pa.list_(pa.int32()))})

    return run


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix") -> DataFrame:
    """``docs`` with size (words of the text, 0 for a null), source_size, target and copies (0 to MOST_COPIES).

    A null source is a source of its own. Rows that are equal in id and text have one rank, so they are
    taken together. Documents without words are never taken. Other columns stay, unless one is called size, source_size, target
    or copies, which are replaced. An empty table gives none; with no words at all nothing is taken.
    """
    key = random_key(id_col, text_col, seed)
    sized = docs.withColumn("size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long"))
    small = stage(sized.select(F.col(source_col).alias("source"), "size", uniform(key).alias("u")), "sizes")
    shares = stage(targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights).drop("weight"), "targets")
    some = small.where("size > 0").withColumns({"octave": octave(F.col("size")), "k": size_class("size")})
    classes = stage(some.groupBy("source", "octave", "k").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "classes")
    # c: classes reach MOST_COPIES from the largest on; each one's level is what is left for it and those below
    larger = Window.partitionBy("source").orderBy(F.desc("k"))
    own = classes.join(shares.select(F.struct("source", "target").alias("s")), classes["source"].eqNullSafe(F.col("s.source")))
    left = F.col("s.target") - MOST_COPIES * F.coalesce(F.sum("words").over(larger.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = left / F.sum(F.col("k") * F.col("words")).over(larger.rowsBetween(Window.currentRow, Window.unboundedFollowing)).cast("double")
    levels = own.select(classes["source"], "k", level.alias("level"))
    factors = levels.where(F.col("level") * F.col("k") <= MOST_COPIES).groupBy("source").agg(F.max_by("level", "k").alias("c"))
    factors = shares.join(factors.select(F.struct("source", "c").alias("f")), F.col("source").eqNullSafe(F.col("f.source")), "left")
    plan = stage(factors.select(F.struct("source", "source_size", "target", F.col("f.c").alias("c")).alias("plan")), "plan")

    copies = expected(F.col("plan.c"), F.col("k"))
    fraction = copies - F.floor(copies)
    cell = rank_cell(F.col("u"), F.col("p"))
    drawn = some.join(plan, some["source"].eqNullSafe(F.col("plan.source"))).withColumn("p", fraction).where("p > 0")
    cells = drawn.groupBy(some["source"], "octave", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum("size").alias("words"), F.lit(None).cast("double").alias("p"))
    fractions = classes.join(plan, classes["source"].eqNullSafe(F.col("plan.source"))).withColumn("p", fraction).where("p > 0")
    folded = cells.unionByName(fractions.select(classes["source"], "octave", F.lit(None).cast("int").alias("cell"), "n", "words", "p"))
    # at most CELLS cells of each octave, however many documents a source has
    cuts = folded.groupBy("source").applyInArrow(_cuts(seed), f"source {dict(docs.dtypes)[source_col]}, cuts array<int>").select(F.struct("source", "cuts").alias("drawn"))
    decided = plan.join(cuts, F.col("plan.source").eqNullSafe(F.col("drawn.source")), "left")
    decided = stage(decided.select(F.struct("plan.source", "plan.source_size", "plan.target", "plan.c", "drawn.cuts").alias("__mix")), "mix")

    m = {x: F.col(f"__mix.{x}") for x in ("source_size", "target", "c", "cuts")}
    copies = expected(m["c"], size_class("size"))
    p = copies - F.floor(copies)
    once_more = F.coalesce((p > 0) & (rank_cell(uniform(key), p) <= F.get(m["cuts"], octave(F.col("size")))), F.lit(False))
    taken = F.when(F.col("size") > 0, F.floor(copies) + once_more.cast("long")).otherwise(0).cast("long")
    out = sized.join(decided, sized[source_col].eqNullSafe(F.col("__mix.source")), "left")
    return out.withColumns({"source_size": m["source_size"], "target": m["target"], "copies": taken}).drop("__mix")
