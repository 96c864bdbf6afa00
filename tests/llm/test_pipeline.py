"""Every registered query of the package beside its SQL twin, and the pipeline beside brute force."""

import hashlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest

import corpus_pipeline
from check_queries import rows_of
from shelfmark.llm import language_id, mixing
from shelfmark.llm.oracle import ORACLE
from shelfmark.llm.queries import QUERIES
from tests.llm.test_exact import scan_by_hand
from tests.llm.test_similar import components_by_hand

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_twin(spark, duck, name):
    found = QUERIES[name](spark, SF)
    answer = duck.execute(ORACLE[name])
    assert rows_of(found.columns, found.collect()) == rows_of([d[0] for d in answer.description], answer.fetchall())


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


class Row:
    def __init__(self, doc_id, text, source):
        self.doc_id, self.text, self.source = doc_id, text, source


def test_pipeline_by_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    # The learned stage is taken as it is; what follows is worked out by hand.
    known = {r.doc_id for r in language_id.report(docs).collect() if r.lang_pred != "und"}
    rows = [Row(r.doc_id, r.text, r.source) for r in docs.collect() if r.doc_id in known]
    total, pages = Counter(r.source for r in rows), Counter()
    for r in rows:
        pages.update({(r.source, x.strip(" \t\r")) for x in r.text.split("\n")})
    for r in rows:
        r.text = "\n".join(
            x for x in r.text.split("\n")
            if not x.strip(" \t\r") or not (pages[r.source, x.strip(" \t\r")] >= 2 and pages[r.source, x.strip(" \t\r")] > 0.05 * total[r.source]))
    least = {d: c for d, _, c in components_by_hand(rows, 5, 80)}
    rows = [r for r in rows if least[r.doc_id] == r.doc_id]
    dirty = {k[0] for k in scan_by_hand(rows, benchmark) if k[5]}
    rows = [r for r in rows if r.doc_id not in dirty]
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.text) for r in got} == {(r.doc_id, r.text) for r in rows} and len(got) == len(rows)
    assert sorted(r.mix_position for r in got) == list(range(len(rows)))
    # Within a source, the order of the digests; over the first period, the shares.
    order = defaultdict(list)
    for r in sorted(got, key=lambda r: r.mix_position):
        order[r.mix_source].append(hashlib.md5(str(r.doc_id).encode()).hexdigest())
    assert all(x == sorted(x) for x in order.values())


def test_stages_keep_the_columns(spark, messy, tmp_path):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, messy, SF)
        extra = 3 if name == "mix_sources" else 0
        assert out.columns[: len(messy.columns)] == messy.columns and len(out.columns) == len(messy.columns) + extra
        assert stage(spark, messy.limit(0), SF).count() == 0
