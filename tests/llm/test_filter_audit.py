import re
from itertools import permutations

import pytest

from shelfmark.llm import filter_audit

LABELS = "doc_id long, quality int, toxic int, text string"


def audited(docs, labels):
    """The contract, row by row."""
    good = {r.doc_id for r in labels if r.quality == 1 and r.doc_id is not None}
    toxic = {r.doc_id for r in labels if r.toxic == 1 and r.doc_id is not None}
    ids = {}
    for r in docs:
        ids.setdefault(r.text or "", set()).add(r.doc_id)
    facts = []
    for r in docs:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": r.doc_id is not None and any(i is not None and i < r.doc_id for i in ids[text]),
        }
        facts.append((r.source or "", {f for f in fails if fails[f]}, r.doc_id in good, r.doc_id in toxic))
    rows, orders = {}, ["".join(p) for p in permutations("ABCDE")]
    for part in {f[0] for f in facts}:
        mine, shapley = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in orders:
            alive = list(mine)
            for step, letter in enumerate(order, 1):
                gone = [f for f in alive if letter in f[1]]
                alive = [f for f in alive if letter not in f[1]]
                failing = [f for f in mine if letter in f[1]]
                shapley[letter] += len(gone)
                rows[part, order, step] = (
                    len(alive), len(gone), len(failing) - len(gone), sum(f[1] == {letter} for f in mine),
                    sum(f[2] for f in gone), sum(f[3] for f in gone))
        for order in orders:
            for step, letter in enumerate(order, 1):
                rows[part, order, step] += (shapley[letter],)
    return rows


def collected(df):
    got = {(r.part, r.filter_order, r.step): (
        r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}
    assert len(got) == df.count()
    return got


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, None, 1), (10, 1, 1), (None, 1, 1), (99, 1, 1)]
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


def test_audit_by_brute_force(spark, messy, labels):
    extra = spark.createDataFrame(
        [(20, "a b " * 40, "s"), (21, "a b " * 40, "t"), (22, "A# B", "s"), (23, None, "s"), (-4, "", None)],
        "doc_id long, text string, source string")
    docs = messy.unionByName(extra, allowMissingColumns=True)
    assert collected(filter_audit.report(docs, labels)) == audited(docs.collect(), labels.collect())


def test_empty_tables(spark, messy, labels):
    assert filter_audit.report(messy.limit(0), labels).count() == 0
    got = filter_audit.report(messy, labels.limit(0)).collect()
    assert len(got) == 600 * 4 and not any(r.good_lost or r.toxic_lost for r in got)


def test_more_parts_than_a_recursion_may_have_rows(spark):
    # 4,000 parts: 1.3 million prefixes, above Spark's default limit of a million rows.
    counted = spark.range(4000).selectExpr("cast(id AS string) AS part", "1 AS mask", "id AS n", "0L AS good", "0L AS toxic")
    found = filter_audit.steps(counted)
    assert found.count() == 4000 * 325
    assert found.filter("prefix = 'A'").selectExpr("sum(removed)").first()[0] == sum(range(4000))
