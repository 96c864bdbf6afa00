import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

from shelfmark.llm import collocations


def mined(docs, min_count, inside, top):
    """The contract, phrase by phrase."""
    f, n = defaultdict(Counter), Counter()
    for r in docs:
        lang = "und" if r.lang is None else r.lang
        text = re.sub("[A-Z]", lambda m: m.group().lower(), r.text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 5):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    rows = []
    for lang, count in f.items():
        cand = {p: a for p, a in count.items() if len(p) > 1 and a >= min_count}
        best = []
        for p, a in cand.items():
            cuts = [(2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            inside_longer = any(
                100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                for q, b in cand.items() if len(q) > len(p))
            if not inside_longer:
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def collected(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in df.collect())


def test_collocations_by_brute_force(spark, messy):
    rng, rows = random.Random(5), []
    vocabulary = ["a", "b", "B", "c", "d", "é", "\U0001F600", "z9", "\x0b", "\xa0"]
    for i in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" "] * 6 + ["  ", "\t", ". ", "\n", ";"]) for _ in range(60))
        rows.append((i, text, rng.choice(["x", "y", None, "und", ""])))
    docs = messy.unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string"), allowMissingColumns=True)
    found = docs.select("text", "lang").collect()
    for min_count, inside, top in ((30, 80, 2000), (3, 50, 7)):
        assert collected(collocations.collocations(docs, min_count, inside, top)) == mined(found, min_count, inside, top)


def test_no_rows(spark, messy):
    assert collocations.report(messy.limit(0)).count() == 0
    assert collocations.report(messy.filter("doc_id = 10")).count() == 0


def test_scores_are_exact_beyond_64_bits(spark):
    a, one, two = 7_000_000_000_000_001, 9_000_000_000_000_000, 9_000_000_000_000_007
    rows = [("x", ["p"], one), ("x", ["q"], two), ("x", ["p", "q"], a)]
    counts = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    assert [tuple(r) for r in collocations.scored(counts).select("l", "r", "score").collect()] == [
        (one, two, 2_000_000 * a // (one + two))]


def test_ties_go_to_the_first_cut(spark):
    rows = [("x", ["p"], 42), ("x", ["q"], 50), ("x", ["r"], 41), ("x", ["p", "q"], 41), ("x", ["q", "r"], 40),
            ("x", ["p", "q", "r"], 40)]
    counts = spark.createDataFrame(rows, "lang string, words array<string>, f long")
    got = {tuple(r.words): (r.l, r.r, r.score) for r in collocations.scored(counts).collect()}
    assert got["p", "q", "r"] == (42, 40, 2_000_000 * 40 // 82)


def test_windows_are_counted_once_and_rolled_up(spark, messy):
    plan = collocations.phrase_counts(messy)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1 and plan.count("arrays_zip") == 1


def test_words_are_numbered_from_bytes():
    texts = pa.array([None, "A\tb  É.a", "", ".\x0b", "a b \U0001F600", "Z"])
    found = collocations._Words.of(pa.array(["x"] * 6), texts)
    words = found.words.to_pylist()
    assert [words[c] for c in found.codes] == ["a", "b", "É", "a", "a", "b", "\U0001F600", "z"]
    assert found.near[1].tolist() == [True, True, False, False, True, True, False, False]
    assert found.near[2].tolist() == [True, False, False, False, True, False, False, False]


def test_equal_windows_of_a_batch_are_one_row(spark):
    """The passes leave text once per batch: counts are packed bytes, windows come with their number."""
    docs = spark.createDataFrame([("a b c. " * 40, "x"), ("q r. " * 3, "x")], "text string, lang string").coalesce(1)
    assert sorted(tuple(r) for r in collocations.windows(docs).collect()) == [
        ("x", "a", "b", "c", None, 40), ("x", "b", "c", None, None, 40), ("x", "c", None, None, None, 40),
        ("x", "q", None, None, None, 3), ("x", "r", None, None, None, 3)]
    blocks = collocations.frequent_parts(docs, 2, [], 30).collect()
    assert sum(bin(b).count("1") for r in blocks for b in r["bits"]) == 2
    assert sorted(r["block"] for r in blocks) == list(range(collocations.BUCKETS // collocations._RANGE))
