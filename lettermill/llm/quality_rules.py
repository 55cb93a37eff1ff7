"""Host-level quality rules.

Every document is measured in one pass; rule failures are summed by host; each host's failure
rates are shrunk towards a beta prior that is fitted to all hosts' rates by moments. The posterior of a rate,
its mean and deviation, is the host's verdict on a rule, and the verdicts are joined back to the documents:

* condemned: the rate is above ``host_limit``, by ``surety`` deviations at least;
* suspect: it is above the mean rate of all hosts by as much; trusted: below it by as much; else neither.

A document is rejected if

* it fails a base rule (too few words, or too many words in repeated 8-word windows), or
* its host is condemned by any rule, or
* it fails a soft rule (symbols, repeated lines, word length). The rule's limit is the strict one on a suspect host and the
  lenient one on a trusted host, so the host turns the verdict on documents between the two, either way.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stage import bound_batches, stage
from .text import SPACE, chunks, mix, shingles_of, utf8, words

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
RULES = ("short", "repeats", "symbols", "lines", "word_length")
SOFT = RULES[2:]
#: For each soft rule its limits on a suspect host, on others and on a trusted host.
SYMBOL_LIMITS = (0.05, 0.1, 0.2)
LINE_LIMITS = (0.1, 0.2, 0.3)
LENGTH_LIMITS = ((3.5, 9.0), (3.0, 10.0), (2.5, 12.0))


def repeated_words(h: np.ndarray) -> int:
    """Words in windows of WINDOW words that occur twice or more, the first one included."""
    if len(h) <= WINDOW:
        return 0
    windows = shingles_of(h, WINDOW)
    _, which, times = np.unique(windows, return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[which] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(h) + 1, np.int64)
    edge[again] += 1
    np.add.at(edge, again + WINDOW, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def _measure(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
    is_symbol = np.zeros(256, bool)
    is_symbol[list(SYMBOLS)] = True
    for column in columns:
        data, offsets = utf8(column)
        out = {m: [] for m in MEASURES}
        for a, b in chunks(offsets):
            piece, within = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            h, first = words(piece, within, lower=False)
            for name, mark in (("word_chars", ~SPACE[piece] & ((piece & 0xC0) != 0x80)), ("n_symbols", is_symbol[piece])):
                total = np.append(0, np.cumsum(mark))
                out[name] += np.diff(total[within]).tolist()
            out["n_words"] += np.diff(first).tolist()
            # only values in which a window's hash occurs twice are looked at one by one
            suspects = set()
            if len(h) > WINDOW:
                owner = np.repeat(np.arange(b - a), np.diff(first))
                windows = shingles_of(h, WINDOW) ^ mix(owner[: len(h) - WINDOW + 1].astype(np.uint64))
                windows = windows[owner[: len(windows)] == owner[WINDOW - 1 :]], owner[: len(windows)][owner[: len(windows)] == owner[WINDOW - 1 :]]
                order = np.argsort(windows[0])
                same = windows[0][order][1:] == windows[0][order][:-1]
                suspects = set(windows[1][order][1:][same].tolist())
            raw = piece.tobytes()
            for i in range(b - a):
                lines = [x for x in raw[within[i] : within[i + 1]].split(b"\n") if x.strip()]
                out["n_lines"].append(len(lines))
                out["n_dup_lines"].append(len(lines) - len(set(lines)))
                out["n_repeat_words"].append(repeated_words(h[first[i] : first[i + 1]]) if i in suspects else 0)
        yield pa.StructArray.from_arrays([pa.array(out[m], pa.int64()) for m in MEASURES], names=list(MEASURES))


def _measures(m: str) -> dict[str, Column]:
    return {x: F.col(f"{m}.{x}") for x in MEASURES}


def base_rules(measures: str) -> dict[str, Column]:
    m = _measures(measures)
    return {"short": m["n_words"] < 20, "repeats": 100 * m["n_repeat_words"] > 30 * m["n_words"]}


def soft_rules(measures: str, tier: int) -> dict[str, Column]:
    """The soft rules with their strict (0), plain (1) or lenient (2) limits."""
    m = _measures(measures)
    low, high = LENGTH_LIMITS[tier]
    return {
        "symbols": m["n_symbols"] > SYMBOL_LIMITS[tier] * m["n_words"],
        "lines": m["n_dup_lines"] > LINE_LIMITS[tier] * m["n_lines"],
        "word_length": (m["word_chars"] < low * m["n_words"]) | (m["word_chars"] > high * m["n_words"]),
    }


def failures(measures: str) -> dict[str, Column]:
    """Each rule's failure, from a struct of measures, with the plain limits."""
    return base_rules(measures) | soft_rules(measures, 1)


def beta_prior(mean: float | None, variance: float | None) -> tuple[float, float]:
    """Beta parameters with that mean and variance. Without any spread the prior outweighs every host; a rule that all documents of all hosts pass, or fail, has nothing to shrink."""
    if mean is None or mean <= 0.0:
        return 0.0, 1.0
    if mean >= 1.0:
        return 1.0, 0.0
    strength = max(mean * (1 - mean) / variance - 1, 1e-6) if variance else 1e12
    return mean * strength, (1 - mean) * strength


def host_verdicts(measured: DataFrame, host_col: str, measures: str, host_limit: float, surety: float) -> DataFrame:
    """One row for each host (null is one): n_docs, and for each rule its shrunk rate, its deviation and its tier (0 suspect, 1 neither, 2 trusted), and host_failed."""
    rules = failures(measures)
    hosts = stage(measured.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), *(F.count_if(c).alias(f"k_{r}") for r, c in rules.items())), "hosts")
    rates = {r: F.col(f"k_{r}") / F.col("n_docs") for r in rules}
    moments = hosts.agg(*(f(c).alias(f"{n}_{r}") for r, c in rates.items() for n, f in (("mean", F.avg), ("var", F.var_pop)))).first()
    out, failed = hosts, F.lit(False)
    for r in rules:
        a, b = beta_prior(moments[f"mean_{r}"], moments[f"var_{r}"])
        seen = F.col("n_docs") + F.lit(a + b)
        out = out.withColumn(f"rate_{r}", (F.col(f"k_{r}") + F.lit(a)) / seen)
        out = out.withColumn(f"spread_{r}", F.sqrt(F.col(f"rate_{r}") * (1 - F.col(f"rate_{r}")) / (seen + 1)))
        low, high = F.col(f"rate_{r}") - surety * F.col(f"spread_{r}"), F.col(f"rate_{r}") + surety * F.col(f"spread_{r}")
        mean = F.lit(moments[f"mean_{r}"])
        out = out.withColumn(f"tier_{r}", F.when(low > mean, 0).when(high < mean, 2).otherwise(1))
        failed = failed | (low > host_limit)
    return out.withColumn("host_failed", failed)


def judge(docs: DataFrame, text_col: str = "text", host_col: str = "source", host_limit: float = 0.5, surety: float = 0.5, keep_text: bool = True) -> DataFrame:
    """``docs`` with the measures (a struct ``measures``), base_failed, host_failed and kept; without the text column if that is not wanted.

    Words are ``[^\\x20\\x09-\\x0D]+``; a null or empty text has none and fails. A null host is a host of
    its own. Repeated rows are judged alike, all other columns stay, whatever their names are, unless one is called
    measures, base_failed, host_failed or kept, which are replaced. An empty table gives none.
    """
    bound_batches(docs.sparkSession)
    measure = F.arrow_udf(_measure, "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">", F.ArrowUDFType.SCALAR_ITER)
    measured = docs.withColumn("measures", measure(F.col(text_col)))
    measured = stage(measured if keep_text else measured.drop(text_col), "measures")
    tiers = [f"tier_{r}" for r in SOFT]
    hosts = host_verdicts(measured.select(F.col(host_col).alias("host"), "measures"), "host", "measures", host_limit, surety)
    hosts = hosts.select(F.struct("host", "host_failed", *tiers).alias("__host"))
    base = reduce(or_, base_rules("measures").values())
    by_tier = [soft_rules("measures", t) for t in range(3)]
    soft = reduce(or_, (F.when(F.col(f"__host.tier_{r}") == 0, by_tier[0][r]).when(F.col(f"__host.tier_{r}") == 2, by_tier[2][r]).otherwise(by_tier[1][r]) for r in SOFT))
    joined = measured.join(hosts, measured[host_col].eqNullSafe(F.col("__host.host")), "left")
    judged = joined.withColumns({"base_failed": base, "host_failed": F.col("__host.host_failed"), "kept": ~(base | F.col("__host.host_failed") | soft)})
    return judged.drop("__host")
