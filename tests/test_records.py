import pytest
from pyspark.sql import functions as F

from shelfmark.operators import merge, quality, records, summary
from shelfmark.operators.rules import RuleSet
from shelfmark.settings import SiteProfile

SITE = SiteProfile(placeholder_email="desk@d.org")
RULES = RuleSet.default()


def test_clean_records(spark):
    rows = [
        (1, "A", "x Q1 A1 y", "", ["f"], ["http://a", "b"], "desk@d.org", None, "/2.9.4/img/logo.f3a91ce.png", None),
        (2, None, "blog", None, None, None, "a@b.c", "", "i", None),
        (3, "B", None, None, None, None, None, None, None, None),
        (4, "C", "", "email automation", None, None, None, None, None, None),
        (5, "D", None, "seo", None, None, None, None, None, "Given"),
    ]
    layout = ("id int, name string, full_description string, description string, features array<string>, "
              "social_links array<string>, support_email string, pricing_link string, image_url string, category string")
    got = {r["id"]: r for r in records.clean(spark.createDataFrame(rows, layout), SITE, RULES, keep=("id",)).collect()}
    assert got[1]["full_description"] == "x y" and got[1]["social_links"] == ["http://a"]
    assert got[1]["support_email"] == "" and got[1]["image_url"] == "" and got[1]["pricing_link"] is None
    assert got[2]["features"] == [] and got[2]["social_links"] == [] and got[2]["category"] == "Other"
    assert got[3]["category"] == "Other" and got[4]["category"] == "Email Marketing" and got[5]["category"] == "Given"


def test_format_fills_missing_columns(spark):
    df = spark.createDataFrame([(1, " N ", "What is N it edits video. How to use N Core Features fast  small Use Cases #1 a")],
                               "id int, name string, description string")
    (r,) = records.format_records(df, SITE, RULES, keep=("id",)).collect()
    assert (r["name"], r["short_description"], r["features"], r["use_cases"]) == ("N", "it edits video.", ["fast", "small"], ["a"])
    assert r["links"]["pricing"] == "" and r["social_links"]["twitter"] == "" and r["category"] == "Visual Marketing"


def test_flatten_link_forms(spark):
    rows = [(1, '{"a": "http://x", "b": ""}', None), (2, '["http://y", "z"]', '{"l": "https://q"}'), (3, None, None)]
    df = spark.createDataFrame(rows, "id int, social_links string, links string")
    got = [tuple(r) for r in records.flatten(df, keep=("id",)).orderBy("id").select("social_links", "important_links", "name").collect()]
    assert got == [("a: http://x", "", ""), ("http://y", "l: https://q", ""), ("", "", "")]


def _record(**changes):
    base = {"name": "n", "description": "", "rating": "3", "image_url": "N/A", "pricing_link": "http://p",
            "social_links": {"twitter": "N/A", "linkedin": "x"}, "support_email": "a@b"}
    return {**base, **changes}


@pytest.mark.parametrize("changes, failed", [
    ({}, []), ({"rating": None}, []), ({"rating": "5"}, []), ({"rating": " 4.5 "}, []), ({"name": None}, ["name"]),
    ({"description": "N/A"}, ["description"]), ({"rating": "NaN"}, ["rating"]), ({"rating": "5.1"}, ["rating"]),
    ({"rating": "bad"}, ["rating"]), ({"rating": "1d"}, ["rating"]), ({"rating": "-1"}, ["rating"]),
    ({"image_url": None}, ["image_url"]), ({"pricing_link": "ftp://x"}, ["pricing_link"]),
    ({"social_links": {"twitter": "a"}}, ["social_links"]), ({"social_links": None}, ["social_links"]),
    ({"support_email": None}, ["support_email"]), ({"support_email": "N/A"}, []),
    ({"support_email": "x", "rating": "6"}, ["rating", "support_email"]),
])
def test_validate(spark, changes, failed):
    layout = ("name string, description string, rating string, image_url string, pricing_link string, "
              "social_links map<string,string>, support_email string")
    record = _record(**changes)
    df = spark.createDataFrame([tuple(record[c.split()[0]] for c in layout.split(", "))], layout)
    (r,) = quality.validate(df).collect()
    assert r["failed_rules"] == failed and r["valid"] == (not failed)


def test_every_record_is_valid_or_rejected(spark):
    df = spark.range(50).select("id", F.lit("n").alias("name"), F.lit("d").alias("description"),
                                (F.col("id") % 8).cast("string").alias("rating"), F.lit("N/A").alias("image_url"),
                                F.lit("N/A").alias("pricing_link"), F.lit("N/A").alias("support_email"),
                                F.create_map(F.lit("twitter"), F.lit("a"), F.lit("linkedin"), F.lit("b")).alias("social_links"))
    good, bad = quality.split_valid(quality.validate(df))
    assert good.count() + bad.count() == 50 and bad.count() == 12


def test_conform(spark):
    df = spark.createDataFrame([(1, "n", "d", "4.5", "TRUE"), (2, None, "d", "9", "x"), (3, "n", "d", None, None)],
                               "id int, name string, description string, rating string, api_available string")
    got = {r["id"]: r for r in quality.conform(df).collect()}
    assert got[1]["rating"] == 4.5 and got[1]["api_available"] is True and got[1]["violations"] == []
    assert got[2]["violations"] == ["name", "rating", "api_available"]
    assert (got[3]["rating"], got[3]["pricing_model"], got[3]["last_updated"], got[3]["features"]) == (0.0, "N/A", None, [])


def test_complete_and_placeholder(spark):
    df = spark.createDataFrame([("a", ""), (None, "x")], "name string, image_url string")
    got = df.select(quality.is_complete(("name", "image_url")).alias("c"),
                    quality.is_placeholder("image_url", F.col("image_url"), {}).alias("p")).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False)]


def test_first_by_is_decided_by_order(spark):
    rows = [("a", 3, "x"), ("a", 1, "y"), ("b", 2, "z"), ("a", 2, "w")]
    df = spark.createDataFrame(rows, "name string, page int, v string")
    assert sorted(map(tuple, merge.first_by(df, "name", "page").collect())) == [("a", 1, "y"), ("b", 2, "z")]
    assert sorted(map(tuple, merge.first_k(df, "name", 2, "page").collect())) == [("a", 1, "y"), ("a", 2, "w"), ("b", 2, "z")]


def test_overlay_keeps_base_for_null(spark):
    base = spark.createDataFrame([(1, "a", "b"), (2, "c", "d")], "k int, x string, y string")
    new = spark.createDataFrame([(1, None, "B")], "k int, x string, y string")
    assert sorted(map(tuple, merge.overlay(base, new, "k", ["x", "y"]).collect())) == [(1, "a", "B"), (2, "c", "d")]


def test_new_pages(spark):
    pages = spark.createDataFrame([(1, "u", "h1"), (2, "u", "h2"), (3, "v", "h3"), (4, "w", "h4"), (5, None, "h5")],
                                  "page_id bigint, url string, html string")
    done = spark.createDataFrame([("v",)], "url string")
    assert sorted(r["html"] for r in merge.new_pages(pages, done).collect()) == ["h1", "h2", "h4", "h5"]
    done = spark.createDataFrame([("v", 3), (None, 5)], "url string, page_id bigint")
    assert sorted(r["html"] for r in merge.new_pages(pages, done).collect()) == ["h1", "h2", "h4"]
    assert sorted(r["html"] for r in merge.first_success(pages).collect()) == ["h1", "h3", "h4", "h5"]


def test_category_summary(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "z"), ("a", "y"), ("a", "y"), (None, None)], "category string, name string")
    assert [tuple(r) for r in summary.category_summary(df).collect()] == [
        ("Other", "category", None, 1), ("Other", "name", None, 1), ("a", "category", None, 3), ("a", "name", "y", 2),
        ("a", "name", "z", 1), ("b", "category", None, 1), ("b", "name", "x", 1),
    ]


def test_by_category(spark):
    df = spark.createDataFrame([(i, "c" + str(i % 4) if i % 5 else None) for i in range(40)], "id int, category string")
    rows = summary.by_category(df).collect()
    sizes = {}
    for r in rows:
        sizes[r["category"]] = sizes.get(r["category"], 0) + 1
    assert len(rows) == 40 and all(r["n_in_category"] == sizes[r["category"]] for r in rows) and sizes["Other"] == 8


def test_run_metrics_and_observed(spark):
    frontier = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "url string")
    done = spark.createDataFrame([("a",), ("z",)], "url string")
    assert tuple(summary.run_metrics(frontier, done).first()) == (4, 3, 1, 2)
    df, seen = summary.observed(frontier)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 4, "failed": 0}


def test_column_profile(spark):
    df = spark.createDataFrame([("a", ""), ("b", None), ("", "x")], "p string, q string")
    assert sorted(map(tuple, summary.column_profile(df).collect())) == [("p", 2, 3), ("q", 1, 3)]
