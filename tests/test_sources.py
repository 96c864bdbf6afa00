import json
from pathlib import Path

import pytest

from shelfmark.operators import records
from shelfmark.schemas import FLAT_COLUMNS
from shelfmark.sources import readers, writers
from shelfmark.sources.progress import Progress

RECORDS = [
    {"name": "A", "social_links": ["http://a", "x"], "features": ["f", "g"], "full_description": "What is A good", "rating": 1},
    {"name": "B", "social_links": {"twitter": "https://t", "x": None}, "links": {"login": "http://l"}, "logo_url": "http://logo"},
]


@pytest.mark.parametrize("array_file", [True, False])
def test_read_records(spark, folder, array_file):
    text = json.dumps(RECORDS, indent=2) if array_file else "\n".join(map(json.dumps, RECORDS))
    Path(folder, "r.json").write_text(text, encoding="utf-8")
    df = readers.read_records(spark, f"{folder}/r.json", array_file=array_file)
    flat = {r["name"]: r for r in records.flatten(df).collect()}
    assert flat["A"]["social_links"] == "http://a" and flat["A"]["features"] == "f|g"
    assert flat["B"]["social_links"] == "twitter: https://t" and flat["B"]["important_links"] == "login: http://l"
    assert flat["B"]["logo_url"] == "http://logo" and flat["A"]["logo_url"] == ""


def test_csv_round_trip(spark, folder):
    rows = [(" a ", 'q "x", y', "l1\nl2", "", "ü|v") + ("",) * 6]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in FLAT_COLUMNS))
    assert writers.write_csv(df.coalesce(1), f"{folder}/out")
    (file,) = Path(folder, "out").glob("*.csv")
    import csv

    with file.open(encoding="utf-8", newline="") as lines:
        assert list(csv.reader(lines)) == [list(FLAT_COLUMNS), list(rows[0])]


def test_json_keys_are_sorted_and_nulls_kept(spark, folder):
    df = spark.sql("SELECT 'é' AS z, CAST(NULL AS STRING) AS a, named_struct('y', 1, 'b', array(named_struct('d', 1, 'c', 2))) AS m")
    assert writers.write_json(df, f"{folder}/out")
    (file,) = Path(folder, "out").glob("*.json")
    assert file.read_text(encoding="utf-8") == '{"a":null,"m":{"b":[{"c":2,"d":1}],"y":1},"z":"é"}\n'


def test_no_records_are_told(spark, folder):
    empty = spark.createDataFrame([], "id int, category string")
    for i, write in enumerate((writers.write_json, writers.write_csv, writers.write_by_category)):
        assert write(empty, f"{folder}/{i}") is False
        assert not any(p.stat().st_size for p in Path(folder, str(i)).glob("*.json"))


def test_write_by_category(spark, folder):
    df = spark.createDataFrame([(1, "SEO Tools"), (2, None)], "id int, category string")
    assert writers.write_by_category(df, f"{folder}/out")
    back = spark.read.parquet(f"{folder}/out")
    assert sorted((r["id"], r["category"]) for r in back.collect()) == [(1, "SEO Tools"), (2, "Other")]


def test_html_files_and_listing_pages(spark, folder):
    Path(folder, "a.html").write_text("<h1>x\ny</h1>", encoding="utf-8")
    (page,) = readers.read_html_files(spark, folder).collect()
    assert page["html"] == "<h1>x\ny</h1>" and page["url"].endswith("/a.html")
    bases = spark.createDataFrame([("b", 3), ("c", 0)], "base_url string, n_pages int")
    assert [r["url"] for r in readers.listing_pages(bases).orderBy("page_no").collect()] == ["b", "b/page/2", "b/page/3"]


def test_page_files_share_folders(spark, folder):
    rows = [(i, f"<h1>é {i}</h1>\n<p>x") for i in range(300)] + [(7, "again"), (300, None), (301, "")]
    folders = writers.write_html_files(spark.createDataFrame(rows, "page_id long, html string").repartition(5), f"{folder}/html")
    assert len(folders) <= 8 == int(spark.conf.get("spark.sql.shuffle.partitions"))
    # A try that failed left a folder behind, which nobody reads.
    Path(folder, "html", "0-999999").mkdir()
    Path(folder, "html", "0-999999", "page_id=1.html").write_text("half", encoding="utf-8")
    back = {int(r["url"].split("page_id=")[1].split(".")[0]): r["html"] for r in readers.read_html_files(spark, folders).collect()}
    assert set(back[7].splitlines()) == {"<h1>é 7</h1>", "<p>x", "again"} and back.pop(7)
    assert back == {i: (html or "") + "\n" for i, html in rows if i != 7}


def test_html_files_query_makes_no_folder_for_each_page(spark, folder, monkeypatch):
    from shelfmark.plans import queries

    rows = [(i, "u", f"<title>t{i}</title>") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    monkeypatch.setattr(queries, "_folder", lambda spark, name: f"{folder}/{name}")
    found = queries.html_files(spark, folder).collect()
    assert sorted(tuple(r) for r in found) == [(i, f"t{i}") for i in range(200)]
    assert len([p for p in Path(folder, "html").rglob("*") if p.is_dir()]) <= 8



def none(done):
    return done.selectExpr("1 AS page_id", "url", "'' AS html", "'' AS reason", "1 AS attempts").limit(0)


def stored(progress, rows, run, batch):
    own = rows.selectExpr("*", "url AS _key", "CAST(NULL AS string) AS _failed")
    progress.finish(run, batch, progress.write_outcomes(own, run, batch)[0], [], [])


def test_progress(spark, folder):
    progress = Progress(spark, f"{folder}/p", {"url": "string", "v": "int"})
    assert progress.results().count() == 0 and progress.next_batch("r") == 0

    def save(run, batch, *rows):
        stored(progress, spark.createDataFrame(rows, "url string, v int"), run, batch)

    save("r", 0, ("a", 1))
    save("r", 1, ("b", 2))
    save("s", 0, ("c", 3))
    save("r", 1, ("b", 9))  # a repeated batch replaces its rows
    assert sorted((r["url"], r["v"], r["run"], r["batch_id"]) for r in progress.results().collect()) == [
        ("a", 1, "r", 0), ("b", 9, "r", 1), ("c", 3, "s", 0)]
    assert (progress.next_batch("r"), progress.next_batch("s"), progress.next_batch("t")) == (2, 1, 0)
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert sorted(r["key"] for r in progress.seen(asked, "r", 1).collect()) == ["a", "c"]


def test_unfinished_batch_is_not_seen(spark, folder):
    progress = Progress(spark, f"{folder}/p", {"url": "string"})
    stored(progress, spark.createDataFrame([("a",)], "url string"), "r", 0)
    spark.createDataFrame([("b",)], "url string").write.parquet(f"{folder}/p/results/unfinished")
    assert [r["url"] for r in progress.results().collect()] == ["a"] and progress.next_batch("r") == 1
    stored(progress, spark.createDataFrame([("c",)], "url string"), "r", 1)
    assert sorted(r["url"] for r in progress.results().collect()) == ["a", "c"]
