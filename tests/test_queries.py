"""Registered queries beside their SQL twins, and the shape of their plans."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as registered
from check_queries import rows_of
from shelfmark.plans.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"
TWINS = registered.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for file in Path(SF_DIR).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


_frames = {}


def frame(spark, name):
    if name not in _frames:
        _frames[name] = QUERIES[name](spark, SF_DIR)
    return _frames[name]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, duck, name):
    found = frame(spark, name)
    got = rows_of(found.columns, found.collect())
    answer = duck.execute(TWINS[name])
    assert got == rows_of([d[0] for d in answer.description], answer.fetchall())
    assert got[0]


def test_entry(spark):
    assert registered.entry(spark).count() > 0


def plan(spark, name):
    return frame(spark, name)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_join_and_no_row_python(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text


@pytest.mark.parametrize("name", [
    "classify_default_rules", "classify_explain", "format_records", "page_details", "card_records", "listing_records",
    "registry_fields", "logo_candidates", "validate_records",
])
def test_row_local_queries_do_not_shuffle_on_keys(spark, name):
    text = plan(spark, name)
    assert not any(kind in text for kind in ("hashpartitioning", "rangepartitioning", "SinglePartition"))


def test_physical_choices(spark):
    def planned(name):
        return QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()

    assert "LeftAnti" in planned("frontier_minus_processed")
    assert planned("dedup_first_by_name").count("WindowGroupLimit") == 2
    assert "partial_max" in planned("best_logo")
    assert "ReadSchema: struct<url:string>" in planned("frontier_minus_processed")
