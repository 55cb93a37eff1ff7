"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import hashlib
import math
import os
import random
import re
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lettermill.llm import decontaminate, jaccard_join, line_dedup, linking, mixing, quality_rules, secret_scan, sharding, suffix_dedup, token_counts, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `key` string, size string, kept int"
random.seed(5)
WORD = lambda: "".join(random.choice("abcdefgh") for _ in range(random.randrange(2, 7)))
PROSE = [" ".join(WORD() for _ in range(60)) + ".\n" + " ".join(WORD() for _ in range(30)) for _ in range(12)]


def near(text, edits):
    words = text.split(" ")
    for i in random.sample(range(len(words)), edits):
        words[i] = WORD()
    return " ".join(words)


TEXTS = PROSE + [PROSE[0], PROSE[0].upper(), near(PROSE[1], 1), near(PROSE[1], 2), near(PROSE[2], 12), PROSE[3] + " " + PROSE[4], "", " \n\t", "one two", "ONE  two", "a b c d e f", None, "é " * 40, "x" * 700, "\n".join([PROSE[5].split("\n")[0]] * 4), "word " * 60_000]
ROWS = [(i, t, "en" if i % 3 else None, f"s{i % 3}" if i % 4 else None, None, "k", "z", 1) for i, t in enumerate(TEXTS)]
ROWS += [ROWS[0], ROWS[0], (None, PROSE[6], None, None, 1, None, None, None), (None, None, None, None, None, None, None, None)]
words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = words(low(t))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def jaccard_brute(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min((r[0] for r, h in zip(rows, group) if h == g and r[0] is not None), default=None) for g in group}
    return sorted(((r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, group)), key=repr)


@pytest.mark.parametrize("limits", [{}, {"cluster": 1}])
def test_jaccard(docs, empty, limits):
    got = [tuple(r) for r in jaccard_join.jaccard_components(docs, **limits).select("doc_id", "n_shingles", "component_id").collect()]
    assert sorted(got, key=repr) == jaccard_brute(ROWS)
    assert jaccard_join.jaccard_components(empty).count() == 0


def test_one_of_each(docs, empty):
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns
    brute = jaccard_brute(ROWS)
    groups = len({c for _, n, c in brute if n})
    assert kept.count() == groups + sum(not n for _, n, _ in brute)
    assert jaccard_join.one_of_each(empty).count() == 0


def test_large_groups_need_no_pairs(spark):
    """Near copies of one text, and texts that share a passage, in lists longer than SHORT and with strangers in them."""
    base = " ".join(WORD() for _ in range(120))
    passage = " ".join(WORD() for _ in range(40))
    rows = [(i, near(base, i % 4)) for i in range(40)] + [(100 + i, passage + " " + " ".join(WORD() for _ in range(12 + i % 30))) for i in range(40)] + [(200 + i, near(base, 7)) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = jaccard_brute(rows)
    for limits in ({}, {"cluster": 20}):
        got = [tuple(r) for r in jaccard_join.jaccard_components(df, **limits).select("doc_id", "n_shingles", "component_id").collect()]
        assert sorted(got, key=repr) == expected


def test_divide_skip_and_bitmaps():
    import numpy as np

    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 50), replace=False)) for _ in range(60)]
    index = jaccard_join.InvertedLists(sets)
    for percent in (50, 75, 90):
        for q in range(60):
            want = [i for i, s in enumerate(sets) if i != q and 100 * len(np.intersect1d(s, sets[q])) >= percent * len(np.union1d(s, sets[q]))]
            open_ = np.ones(60, bool)
            open_[q] = False
            assert index.reach(q, open_, percent).tolist() == want
            for i in want:
                a, b = (np.frombuffer(jaccard_join.bitmap(s), np.uint8) for s in (sets[q], sets[i]))
                assert jaccard_join.may_reach(percent, a, np.int64(len(sets[q])), b, np.int64(len(sets[i])))


def suffix_brute(rows, width):
    raw = [(r[1] or "").encode() for r in rows]
    seen = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for r, b in zip(rows, raw):
        gone = bytearray(len(b))
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((r[0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot", [50_000, 1])
def test_suffix_dedup(spark, docs, empty, monkeypatch, hot):
    rows = [r for r in ROWS if len(r[1] or "") < 10_000]
    for width in (30, 200):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        got = [(*r[:4], bytes(r[4])) for r in suffix_dedup.remove_repeats(docs.where("coalesce(length(text), 0) < 10000"), width=width).collect()]
        assert sorted(got, key=repr) == suffix_brute(rows, width)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_suffix_dedup_long_text(spark):
    """Longer than a chunk, with a repeat across a chunk's end."""
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdef ") for _ in range(500))
    filler = lambda n: "".join(rng.choice("ghijkl ") for _ in range(n))
    long = filler((1 << 20) - 300) + passage + filler(5000)
    df = spark.createDataFrame([(1, long), (2, filler(50) + passage)], "doc_id long, text string")
    got = {r[0]: r for r in suffix_dedup.remove_repeats(df).collect()}
    assert (got[1].n_removed, got[1].n_spans, got[2].n_removed) == (500, 1, 500)
    assert bytes(got[1].kept) == long.replace(passage, "").encode()


def test_quality(docs, empty):
    rows = quality_rules.judge(docs).select("doc_id", "text", "measures", "base_failed", "kept", "size").collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        w = words(r.text)
        windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        marked = {p for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for p in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        assert tuple(r.measures) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines), len(lines) - len(set(lines)), len(marked))
        assert r.base_failed == (len(w) < 20 or 100 * len(marked) > 30 * len(w))
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty).count() == 0
    assert quality_rules.beta_prior(0.2, 0.01) == pytest.approx((3.0, 12.0))


def test_bad_host(spark):
    good, bad = " ".join(WORD() for _ in range(30)), " ".join(f"{WORD()}###" for _ in range(30))
    rows = [(i, good if i % 10 else bad, f"h{i % 7}") for i in range(200)] + [(1000 + i, bad if i % 5 else good, "spam") for i in range(50)] + [(2000, good, "new")]
    kept = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[1000 + i].kept for i in range(50)) and kept[1000].host_failed
    assert all(kept[i].kept == bool(i % 10) for i in range(200))
    assert not kept[2000].host_failed and kept[2000].kept


def own_verdict(measures):
    """Rejected by the rules themselves, whatever the host."""
    from functools import reduce
    from operator import or_

    return ~reduce(or_, quality_rules.failures(measures).values())


def test_host_turns_verdicts_both_ways(spark):
    """The same text, by its own rules good or bad, is judged by its host."""
    line = lambda: " ".join(WORD() for _ in range(12))
    repeated = lambda share: "\n".join([line() for _ in range(100 - share)] + ["same line here"] * (share + 1))
    between, above, clean = repeated(15), repeated(25), repeated(0)
    rows = [(i, clean, "clean") for i in range(300)] + [(1000 + i, above if i % 3 else clean, "dirty") for i in range(100)]
    rows += [(5000, above, "clean"), (5001, between, "dirty"), (5002, between, "clean"), (5003, between, "new"), (5004, above, "new")]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id >= 5000").withColumn("own", own_verdict("measures"))
    kept = {r.doc_id: (r.own, r.kept) for r in got.collect()}
    assert kept[5000] == (False, True) and kept[5001] == (True, False) and kept[5002] == (True, True)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_host_turns_verdicts_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text", "source")
    turned = {(r.own, r.kept) for r in quality_rules.judge(docs, keep_text=False).select(own_verdict("measures").alias("own"), "kept").distinct().collect()}
    assert turned == {(True, True), (False, False), (True, False), (False, True)}


def test_tokens(docs, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    rows = token_counts.with_token_counts(docs, path).select("text", "n_tokens").collect()
    assert all(r.n_tokens == len(t.encode(r.text or "", add_special_tokens=False).ids) for r in rows)
    table = token_counts.MergeTable.read(path)
    odd = ["<|endoftext|>a<|endoftext|>", "abcabc" * 900, "".join(random.choice("etaoinshrd") for _ in range(9000)), "日本語 x　y\x1c\x85z", "'ll  don't\n\n  1234"]
    sent = type("Sent", (), {"value": table})
    import pyarrow as pa

    assert next(token_counts._counts(sent)(iter([pa.array(odd)]))).to_pylist() == [len(t.encode(x, add_special_tokens=False).ids) for x in odd]
    assert token_counts.with_token_counts(empty, path).count() == 0


def test_lines(docs, empty):
    got = {r.id: r for r in line_dedup.dedup_lines(docs.where("doc_id is not null")).collect()}
    assert got[0].n_removed == 0 and got[12].n_removed == 2 and got[12].kept == ""
    assert got[len(TEXTS) - 2].n_removed == 4
    null = next(i for i, t in enumerate(TEXTS) if t is None)
    assert got[null].kept is None and got[null].n_lines == 0
    assert line_dedup.dedup_lines(empty).count() == 0


def test_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
            row = now
        return row[-1]

    for _ in range(3000):
        a, b = ("".join(random.choice("ab") for _ in range(random.randrange(9))) for _ in range(2))
        for tau in (1, 2, 3):
            assert line_dedup.within(a, b, tau) == (distance(a, b) <= tau)


def test_line_classes(spark):
    base = "".join(random.choice("abcdefghij ") for _ in range(60)).strip("a ") + "zz"
    edited = [base, base[:-1], base + "y", "q" + base, base[:20] + "#" + base[21:], base[:10] + base[12:], base.replace("b", "??")]
    rows = [(i, f"  {x}\t\n\nunlike line number {i} {WORD()}{WORD()}{WORD()}") for i, x in enumerate(edited)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for cluster in (2048, 1):
        kept = {r.id: r for r in line_dedup.dedup_lines(df, cluster=cluster).collect()}
        assert [kept[i].n_removed for i in range(6)] == [0, 1, 1, 1, 1, 1]


def _near_copies(n, edits, seed=3):
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    return [" ".join(f"x{rng.random()}" if i in drop else w for i, w in enumerate(base)) for drop in (set(rng.sample(range(150), rng.randrange(edits))) for _ in range(n))]


def _least_linked(texts):
    """The least index that each text's links reach, from the products of all pairs."""
    sets = list(jaccard_join.shingle_sets(pa.array(texts, pa.large_string()), 5))
    every, at = np.unique(np.concatenate(sets), return_inverse=True)
    x = np.zeros((len(sets), len(every)), np.float32)
    x[np.repeat(np.arange(len(sets)), [len(s) for s in sets]), at] = 1
    both, n = x @ x.T, x.sum(1)
    links, least = 100 * both >= 75 * (n[:, None] + n[None, :] - both), np.arange(len(sets))
    while (now := np.where(links, least[None, :], len(sets)).min(1)).tolist() != least.tolist():
        least = now
    return least.tolist()


def test_cluster_search_of_many_near_copies():
    texts = _near_copies(1200, 13)
    began = time.process_time()
    roots = jaccard_join.search_cluster(5, 75)(pa.array(texts, pa.large_string()))
    took = time.process_time() - began
    first = {}
    assert [first.setdefault(r, i) for i, r in enumerate(roots)] == _least_linked(texts)
    assert 10 < len(first) < 1200 and took < 10  # seconds; a merge through a heap took 18


def test_large_cluster_by_parts(spark, monkeypatch):
    texts = _near_copies(150, 13)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []
    kept = linking._linked_pairs
    monkeypatch.setattr(linking, "_linked_pairs", lambda *a: (asked.append(1), kept(*a))[1])
    got = dict(tuple(r) for r in jaccard_join.jaccard_components(df, cluster=40).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(150)] == _least_linked(texts)
    assert not asked  # lists that hold nearly the whole cluster are not expanded into pairs


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(PROSE[0].split()[:25])), (2, " ".join(WORD() for _ in range(30))), (3, None), (4, "one two"), (5, ""), (6, " ".join(near(PROSE[7], 3).split()[:60]))], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert {(0, 1), (12, 1), (13, 1)} <= set(found) and found[(0, 1)].similarity == pytest.approx(1.0)
    assert {d for d, i in found if i == 4} == {TEXTS.index("one two"), TEXTS.index("ONE  two")}
    assert (found[(0, 1)].first_word, found[(0, 1)].n_words) == (0, 25) and not any(i in (2, 3, 5) for _, i in found)
    assert decontaminate.contaminated(docs, items).count() >= 5 + 2  # repeated rows have theirs
    assert decontaminate.contaminated(empty, items).count() == 0 and decontaminate.contaminated(docs, items.where("false")).count() == 0


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(PROSE[i].split()[:25])) for i in range(10)], "item_id long, text string")
    whole = sorted(map(tuple, decontaminate.contaminated(docs, items).select(F.coalesce("doc_id", F.lit(-1)), "item_id", "first_word", F.round("similarity", 9)).collect()))
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 4)
    assert sorted(map(tuple, decontaminate.contaminated(docs, items).select(F.coalesce("doc_id", F.lit(-1)), "item_id", "first_word", F.round("similarity", 9)).collect())) == whole


def test_decontamination_of_short_documents(spark):
    item = PROSE[0].split()[:40]
    texts = {1: item[:20] + item[21:], 2: item[:34], 3: item[4:], 4: item[:20], 5: item}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(PROSE[1].split()[:40]))], "item_id long, text string")
    whole = shingles(" ".join(item))
    brute = {i: len(whole & shingles(" ".join(t))) / len(whole) for i, t in texts.items()}
    found = {r.doc_id: r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(found) == {i for i, s in brute.items() if s >= 0.75} == {1, 2, 3, 5}
    assert all(r.item_id == 1 and r.first_word == 0 and r.n_words == len(texts[i]) and r.similarity == pytest.approx(brute[i]) for i, r in found.items())


def test_decontamination_weights_over_all_blocks(spark, monkeypatch):
    shared = PROSE[11].split()[:20]
    items = {i: PROSE[i].split()[:20] + shared for i in range(10)}
    docs = spark.createDataFrame([(i, " ".join(PROSE[i].split()[:20] + shared[: 8 + i])) for i in items], "doc_id long, text string")
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in items.items()], "item_id long, text string")
    sets = {i: shingles(" ".join(t)) for i, t in items.items()}
    df = Counter(s for x in sets.values() for s in x)
    weight = lambda x: sum(math.log1p(len(items) / df[s]) for s in x)
    brute = {(d.doc_id, i): weight(x & shingles(d.text)) / weight(x) for d in docs.collect() for i, x in sets.items()}
    brute = {p: pytest.approx(s) for p, s in brute.items() if s >= 0.75}
    run = lambda: {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs, table).collect()}
    assert run() == brute and len(brute) >= 10
    monkeypatch.setattr(decontaminate, "MOST_ITEMS", 4)
    assert run() == brute


def coverage(item, window, weight):
    have, total = Counter(window), sum(weight(x) * n for x, n in Counter(item).items())
    return sum(weight(x) * min(n, have[x]) for x, n in Counter(item).items()) / total


def windows_brute(docs, items, threshold=0.75):
    """(doc, item): best coverage and its first word, over all windows of all items."""
    gram = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
    grams = {i: gram(w) for i, w in items.items()}
    df = Counter(x for g in grams.values() for x in set(g))
    weight = lambda x: math.log1p(len(items) / df[x]) if df[x] else math.log1p(len(items))
    out = {}
    for d, w in docs.items():
        for i, g in grams.items():
            n = min(len(items[i]), len(w))
            best = max(((coverage(g, gram(w[a : a + n]), weight), -a) for a in range(len(w) - n + 1)), default=(0.0, 0)) if n else (0.0, 0)
            if best[0] >= threshold:
                out[d, i] = (pytest.approx(best[0]), -best[1])
    return out


def test_decontamination_recall(monkeypatch):
    """Edited items inside documents, against brute force; the fingerprints alone decide what is looked at."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    phrase = some(9)
    items = {i: some(rng.randrange(3, 60)) + (phrase if i % 3 == 0 else []) for i in range(40)}
    docs = {}
    for d in range(200):
        item = list(items[d % 40])
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(item))
            item[at : at + rng.randrange(2)] = some(rng.randrange(2))
        docs[d] = some(rng.randrange(0, 40)) + item[rng.randrange(4) :] + some(rng.randrange(0, 40))
    want = windows_brute(docs, items)
    held = decontaminate.Items(list(items), [" ".join(w) for w in items.values()], 5)
    import numpy as np
    import pyarrow as pa

    def run():
        known = np.ones(1 << 20, bool)
        return {(d, held.ids[i]): (s, w) for d, i, s, w, _ in decontaminate._found(held, known, pa.array([" ".join(w) for w in docs.values()]), 0.75)}

    got = run()
    assert set(got) <= set(want) and len(got) >= 0.98 * len(want) > 100
    assert sum(got[p] == want[p] for p in got) >= 0.98 * len(want)  # similarity and place
    weak = [p for p, (s, _) in want.items() if s.expected < 0.85]
    assert len(weak) > 10 and sum(p in got for p in weak) >= 0.9 * len(weak)
    monkeypatch.setattr(decontaminate, "RADIUS", 7)
    assert len(run()) < 0.6 * len(want)


def test_decontaminated_keeps_columns(spark, docs, empty):
    items = spark.createDataFrame([(1, " ".join(PROSE[0].split()[:25])), (2, "one two")], "item_id long, text string")
    found = {r.doc_id for r in decontaminate.contaminated(docs, items).collect()}
    odd = docs.withColumns({"row": F.lit(1), "item": F.lit("x"), "id": F.lit("y"), "similarity": F.lit(2)})
    kept = decontaminate.decontaminated(odd, items)
    assert kept.schema == odd.schema
    assert sorted(kept.collect(), key=repr) == sorted(odd.where(~F.coalesce(F.col("doc_id").isin(list(found)), F.lit(False))).collect(), key=repr)
    assert decontaminate.decontaminated(empty, items).count() == 0 and decontaminate.decontaminated(docs, items.where("false")).count() == len(ROWS)


def test_mixing(docs, empty):
    rows = mixing.mix(docs).select("doc_id", "source", "text", "size", "source_size", "target", "copies").collect()
    assert len(rows) == len(ROWS) and all(r["size"] == len(words(r.text)) and 0 <= r.copies <= 3 for r in rows)
    total = sum(r["size"] for r in rows)
    by = {r.source: r for r in rows}
    assert sum(r.target for r in by.values()) == pytest.approx(total)
    assert all(r.target <= 3 * r.source_size + 1e-6 for r in by.values())
    again = mixing.mix(docs).select("doc_id", "source", "text", "copies")
    assert Counter((r.doc_id, r.text, r.copies) for r in again.collect()) == Counter((r.doc_id, r.text, r.copies) for r in rows)
    assert mixing.mix(empty).count() == 0
    assert all(r.copies == 0 for r in mixing.mix(docs.where("doc_id is null and text is null")).collect())


def test_mixing_frequencies(spark):
    """300 sources of the same make-up: how often a document of each size is taken is what its inclusion odds say."""
    sizes = {17: 12, 23: 12, 30: 12, 70: 12, 100: 12, 126: 12, 300: 3, 490: 2}
    rows = [(s * 1000 + 100 * j + i, " ".join(["w"] * n), f"s{s}") for s in range(300) for j, (n, times) in enumerate(sizes.items()) for i in range(times)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(8), weights=(1,))
    kind = {r["size"]: (r.c, r.v) for r in got.groupBy("size").agg(F.avg("copies").alias("c"), F.count("*").alias("v")).collect()}
    k = {n: 16 * (n.bit_length() - 1) + (n << 5 >> n.bit_length()) for n in sizes}
    total = sum(n * t for n, t in sizes.items())
    c = total / sum(k[n] * n * t for n, t in sizes.items())
    assert max(c * x for x in k.values()) < 3
    for n, (mean, count) in kind.items():
        p = c * k[n] % 1
        assert abs(mean - c * k[n]) < 4.5 * math.sqrt(p * (1 - p) / count) + 0.02
    # in one octave the larger ones are taken more often, which a draw by random numbers alone would not do
    assert kind[30][0] - kind[17][0] > 0.7 * c * (k[30] - k[17]) and kind[126][0] - kind[70][0] > 0.7 * c * (k[126] - k[70])
    assert all(r.copies >= int(c * k[r["size"]]) for r in got.select("size", "copies").distinct().collect())  # certain copies
    taken = got.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken")).collect()
    assert sum(abs(r.taken - total) for r in taken) / len(taken) < 0.02 * total


def test_mixing_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 20, None: 500}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: (r.weight, r.target) for r in mixing.targets(df).collect()}
    weights, limits, left, targets = {"a": 1, "b": 2, "c": 3, None: 1}, {k: 3 * v for k, v in sizes.items()}, 1530.0, {}
    while True:
        free = [k for k in sizes if k not in targets]
        level = left / sum(weights[k] for k in free)
        over = [k for k in free if weights[k] * level > limits[k]]
        if not over:
            break
        for k in over:
            targets[k] = limits[k]
            left -= limits[k]
    targets |= {k: weights[k] * level for k in free}
    assert {k: v[0] for k, v in got.items()} == weights and all(got[k][1] == pytest.approx(targets[k]) for k in sizes)


def test_mixing_comes_near(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 90)), f"s{i % 5}" if i % 3 else "s0") for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target"), F.first("source_size").alias("source_size")).collect()
    assert all(abs(r.taken - r.target) <= 5 for r in got)  # a source's sizes lie up to 10 words apart


@pytest.mark.parametrize("limit", [500, 3000, 1 << 20])
def test_sharding(docs, empty, limit):
    rows = sharding.shard(docs, limit).select("doc_id", "text", "shard", "depth", "n_bytes").collect()
    assert len(rows) == len(ROWS) and all(r.n_bytes == len((r.text or "").encode()) for r in rows)
    held: dict[str, list[int]] = {}
    for r in rows:
        held.setdefault(r["shard"], []).append(r.n_bytes)
    assert all(sum(v) <= limit or len(v) == 1 for v in held.values())
    names = {r["shard"].split("-")[0] for r in rows}
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    if limit > 500_000:
        assert names == {""}
    assert sharding.shard(empty, limit).count() == 0


def test_warc_round_trip(spark):
    page = "<html><head><title>T &amp; x</title><script>no()</script></head><body><p>Hello<br>w&ouml;rld</p><!-- c --><a href='/l?a=1&amp;b=2'>link</a></body></html>"
    pages = spark.createDataFrame([(1, "http://a/", page), (2, None, None), (3, "http://b/", ""), (1, "http://a/", page)], "page_id long, url string, html string")
    source = {r.record_id: r for r in warc.responses(pages).collect()}
    made = [r.asDict() for r in warc.derivatives(warc.responses(pages)).collect()]
    assert len(source) == 3 and len(made) == 8
    for m in made:
        r = source[m["refers_to"]]
        assert (m["target_uri"], m["date"], m["payload_digest"]) == (r.target_uri, r.date, r.payload_digest)
        assert m["block_digest"] == warc.digest(bytes(m["block"]))
    texts = {m["target_uri"]: bytes(m["block"]).decode() for m in made if m["warc_type"] == "conversion"}
    assert texts["http://a/"] == "Hello\nwörld\nlink" and texts[None] == ""
    meta = next(bytes(m["block"]).decode() for m in made if m["warc_type"] == "metadata" and m["target_uri"] == "http://a/")
    assert "title: T & x" in meta and "outlink: /l?a=1&b=2" in meta and "http-header: Content-Type: text/html" in meta
    data = b"".join(warc.serialize(m) for m in made)
    back = list(warc.parse(data))
    assert [b["record_id"] for b in back] == [m["record_id"] for m in made] and all(b["block"] == bytes(m["block"]) and b["fields"] == m["fields"] for b, m in zip(back, made))
    with pytest.raises(ValueError):
        list(warc.parse(data[:-40]))
    assert warc.derivatives(warc.responses(pages.where("false"))).count() == 0


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<html><head><title>t</title><body><p>all the text</p></body></html>", "all the text"),
        ("<html><head><title>t</title><meta charset=utf-8><p>all the text<p>more", "all the text\nmore"),
        ("<head><title>t</title><link href=a>plain text<div>more</div>", "plain text\nmore"),
        ("<head><title>t</title><style>p{}</style></head><p>one</p>", "one"),
        ("<head><title>t <!-- x</title></head><body>one<p>two", "one\ntwo"),
        ("<head><title>t<meta charset=utf-8></head><body>one", "one"),
        ("<body>one<script>var a = '<!--';</script><p>two</p><!-- c --><p>three</p>", "one\ntwo\nthree"),
        ("<body>one<!-- <script> --><p>two</p><!-- </script> <style> --><p>three</p>", "one\ntwo\nthree"),
        ("<body>one<header>two</header><!-- open", "one\ntwo"),
    ],
)
def test_warc_text(page, text):
    assert warc.plain_text(page) == text


def test_warc_files(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>") for i in range(5)], "page_id long, url string, html string")
    records = warc.serialized(warc.responses(pages)).collect()
    (tmp_path / "a.warc").write_bytes(b"".join(bytes(r[0]) for r in records))
    assert warc.derivatives(warc.read_warc(spark, str(tmp_path))).count() == 10


def test_secrets(spark, docs, empty):
    findings = secret_scan.example_findings(spark, 1500)
    held_out = secret_scan.example_findings(spark, 2300).subtract(findings)
    model = secret_scan.train(findings)
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(secret_scan.FEATURES), outputCol="features").transform(held_out.withColumns(secret_scan.features(*(F.col(c) for c in ("token", "before", "after", "word")))))
    right = model.transform(rows).select((F.col("prediction") == F.col("label")).alias("ok")).collect()
    assert len(right) > 500 and sum(r.ok for r in right) / len(right) > 0.97
    sha = hashlib.sha1(b"x").hexdigest()
    texts = [(1, f'a token = "{sha}" here'), (2, f"commit {sha} fixes it"), (3, "call 4111111111111111 now"), (4, f'api_key="{sha}" api_key="{sha}"'), (5, None), (6, ""), (7, "x1" * 40_000)]
    got = secret_scan.scan(spark.createDataFrame(texts, "doc_id long, text string"), model)
    found = {(r.id, r.place): r.is_secret for r in got.collect()}
    assert found[(1, 3)] and not found[(2, 1)] and not found[(3, 1)] and found[(4, 0)] and found[(4, 1)]
    assert secret_scan.scan(empty, model).count() == 0
