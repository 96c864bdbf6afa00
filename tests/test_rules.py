import itertools
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import rules
from shelfmark.operators.rules import Rule, RuleSet

DEFAULT = RuleSet.default()


def judge(evaluate, name, description, rule_set=DEFAULT):
    (v,) = evaluate(rules.verdict(F.lit(name), "c", rule_set), [description])
    return v


def by_hand(name, description, rule_set):
    """The scoring rules spelled out for one record."""
    import re

    def clean(t):
        return " ".join(re.sub("[^a-z0-9]", " ", (t or "").lower()).split())

    n, d = clean(name), clean(description)
    both = f"{n} {d}"
    totals = {category: 2.0 * sum(s in both for s in rule_set.context_stems) for _, category in rule_set.categories}
    for r in rule_set.rules:
        if r.kind == "feature":
            totals[r.category] += r.weight if r.keyword in both else 0
        elif f" {r.keyword} " in f" {both} ":
            totals[r.category] += 2 * r.weight
        elif r.keyword in n:
            totals[r.category] += 1.5 * r.weight
        elif r.keyword in d:
            totals[r.category] += r.weight
    best = max(totals.values())
    if best >= rule_set.min_score:
        return next(c for c, t in totals.items() if t == best), best
    if best > 0 and any(s in both for s in rule_set.document_stems):
        return rule_set.document_category, best
    return rule_set.default_category, best


def test_rule_table():
    assert len(DEFAULT.rules) == 158
    assert [c for _, c in DEFAULT.categories][:2] == ["Marketing & Advertising", "Social Media Marketing"]
    twice = [r.weight for r in DEFAULT.rules if r.keyword == "newsletter" and r.kind == "keyword"]
    assert sorted(twice) == [1.0, 3.0]


@pytest.mark.parametrize("name, description, score", [
    ("ad campaign x", "", 6.0), ("mad campaigns", "", 4.5), ("", "mad campaigns", 3.0), ("ad", "campaign", 6.0),
])
def test_hit_scores(evaluate, name, description, score):
    one = RuleSet((Rule("x", 0, "ad campaign", 3),), "none")
    assert judge(evaluate, name, description, one)["score"] == score


def test_context_lifts_every_category(evaluate):
    v = judge(evaluate, "", "brandy advertisement")
    assert v["category"] == "Marketing & Advertising"
    assert min(s["score"] for s in v["scores"]) == 4.0
    assert v["context"] == ["advertis", "brand"]


def test_no_match_and_low_scores(evaluate):
    assert judge(evaluate, "x", "y")["category"] == "Marketing & Advertising"
    assert judge(evaluate, None, None)["category"] == "Marketing & Advertising"
    assert judge(evaluate, "", "convert ranks")["category"] == "Content Marketing"
    assert judge(evaluate, "", "convert q")["category"] == "Marketing & Advertising"


def test_tie_goes_to_the_first_category(evaluate):
    tie = RuleSet((Rule("b", 1, "k", 3), Rule("a", 2, "k", 3)), "none")
    assert judge(evaluate, "", "k", tie)["category"] == "b"


def test_against_the_rules_spelled_out(spark):
    rng = random.Random(5)
    words = [w for r in DEFAULT.rules for w in r.keyword.split()] + ["read", "pdf", "convert", "x", "brands", "&"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 3))), " ".join(rng.choices(words, k=rng.randint(0, 9))))
            for i in range(300)]
    df = spark.createDataFrame(rows, "id int, name string, description string")
    got = {r["id"]: (r["v"]["category"], r["v"]["score"])
           for r in df.select("id", rules.verdict("name", "description", DEFAULT).alias("v")).collect()}
    assert got == {i: by_hand(n, d, DEFAULT) for i, n, d in rows}


def test_gates_are_part_of_their_keyword():
    keywords = [r.keyword for r in DEFAULT.rules]
    gates = rules._gates(keywords)
    assert all(gates[k] in k for k in keywords)
    assert len(set(gates.values())) < len(set(keywords)) / 2


def _rule_table(spark):
    rows = [("a", 0, "Ad Hoc", 3), ("a", 0, "x", 1), ("b", 1, "hoc", 2), ("b", 1, "oc q", 3), ("c", 2, "zz top", 2), ("c", 2, "--", 9)]
    return spark.createDataFrame(rows, "category string, cat_order int, keyword string, weight int")


def test_join_form_equals_fold_form(spark):
    parts = ["ad hoc", "mad hocus", "x", "", "zz top", "q", "oc", "hoc q", "ad", "zz"]
    rows = [(i, n, d) for i, (n, d) in enumerate(itertools.product(parts, parts))] + [(1000, None, None)]
    df = spark.createDataFrame(rows, "id int, name string, description string")
    table = _rule_table(spark)
    inline = RuleSet.from_dataframe(table, "none")
    fold = rules.category_scores(df, "id", "name", "description", inline)
    join = rules.category_scores_by_join(df, "id", "name", "description", table)
    assert sorted(map(tuple, fold.collect())) == sorted(map(tuple, join.collect()))
    small = rules.classify(df, "id", "name", "description", table, "none")
    large = rules.best_by_join(df, "id", "name", "description", table, "none")
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect()))


def test_forms_agree_on_any_rule_table(spark):
    """Shared and repeated orders, NULL and repeated keys, repeated rules, keywords no text holds."""
    rng = random.Random(9)
    parts = ["ad hoc", "mad hocus", "x", "zz top", "q", "oc", "hoc q", "zz", "hoc hoc"]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, *parts]), " ".join(rng.choices(parts, k=rng.randint(0, 4))))
            for _ in range(200)]
    df = spark.createDataFrame([*rows, *rows[:20]], "id int, name string, description string")
    for trial in range(4):
        table = [(rng.choice("abcd"), rng.randint(0, 2), rng.choice([*parts, "absent one", "--", "o"]), rng.randint(1, 4)) for _ in range(12)]
        rule_table = spark.createDataFrame(table, "category string, cat_order int, keyword string, weight int")
        inline = RuleSet.from_dataframe(rule_table, "none")
        for fold, join in (
            (rules.category_scores(df, "id", "name", "description", inline),
             rules.category_scores_by_join(df, "id", "name", "description", rule_table)),
            *[(rules.classify(df, "id", "name", "description", rule_table, "none"),
               rules.classify(df, "id", "name", "description", rule_table, "none", form="join"))],
        ):
            assert sorted(map(repr, fold.collect())) == sorted(map(repr, join.collect())), (trial, table)


def test_ten_thousand_rules(spark, monkeypatch):
    monkeypatch.setattr(rules, "BROADCAST_RULES", 4_000)
    table = spark.range(10_000).selectExpr("concat('c', id % 50) category", "cast(id % 50 as int) cat_order", "concat('w', id, ' x') keyword", "2 weight")
    df = spark.createDataFrame([(1, "w77 x", ""), (2, "w5", "w6 x w9999 x w56 x"), (3, None, None)], "id int, name string, d string")
    got = {r["id"]: r["category"] for r in rules.classify(df, "id", "name", "d", table, "none", form="join").collect()}
    assert got == {1: "c27", 2: "c6", 3: "none"}


def test_scores_for_one_category_are_explained(spark):
    df = spark.createDataFrame([(1, "seo kit", "keyword research and newsletters")], "id int, name string, d string")
    hits = rules.explain_matches(df, "id", "name", "d", DEFAULT).filter("category = 'SEO Tools'")
    got = {(r["keyword"], r["kind"]): r["score"] for r in hits.collect()}
    assert got == {("keyword research", "keyword"): 6.0, ("seo", "keyword"): 2.0, ("seo", "feature"): 1.0,
                   ("search", "feature"): 1.0, ("keyword", "feature"): 1.0}


def test_join_form_on_ten_thousand_rules(spark):
    rng = random.Random(3)
    letters = "abcdefghij0 "
    keywords = {"".join(rng.choices(letters, k=rng.randint(1, 9))).strip() for _ in range(11_000)}
    table = spark.createDataFrame(
        [(f"c{i % 40}", i % 40, k, float(1 + i % 3)) for i, k in enumerate(sorted(keywords))],
        "category string, cat_order int, keyword string, weight double")
    rows = [(i, "".join(rng.choices(letters, k=12)), "".join(rng.choices(letters, k=rng.randint(0, 150)))) for i in range(40)]
    df = spark.createDataFrame([*rows, (40, None, None), (41, "", "")], "id int, name string, description string")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rules", "planning")
    join = rules.category_scores_by_join(df, "id", "name", "description", table)
    planned = len(jobs.getJobIdsForGroup("rules"))
    fold = rules.category_scores(df, "id", "name", "description", rules.RuleSet.from_dataframe(table, "none"))
    got, want = sorted(map(tuple, join.collect())), sorted(map(tuple, fold.collect()))
    assert len(got) == len(want) > 400 and all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert planned <= 2  # the count of the rules alone
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == 0
