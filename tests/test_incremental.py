from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import extract, merge, summary
from shelfmark.operators.elements import parse_pages
from shelfmark.operators.matching import Page
from shelfmark.plans.catalogue import detail_records, update
from shelfmark.plans.export import json_to_csv, save_listings
from shelfmark.schemas import DETAIL
from shelfmark.settings import SiteProfile
from shelfmark.sources.keys import KeyIndex
from shelfmark.sources.manifest import KEPT, Manifest
from shelfmark.sources.progress import Progress, Retries
from shelfmark.sources.summaries import Summaries
from shelfmark.streaming.ingest import distinct_pages, run_batch, shared_folder, start_stream

LAYOUT = {"page_id": "bigint", "url": "string", "name": "string"}


def work(pages):
    return parse_pages(pages).select("page_id", "url", extract.title(Page()).alias("name")).filter("name IS NOT NULL")


def some_pages(spark, ids):
    rows = [(i, f"https://h/{i % 17}", f"<title>t{i}</title>" if i % 5 else "<p>no title") for i in ids]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def final(progress):
    return sorted((r["page_id"], r["url"], r["name"]) for r in progress.results().collect())


def test_many_batches_equal_one(spark, folder):
    ids = [i for i in range(60) if i % 5]
    one, many = (Progress(spark, f"{folder}/{n}", LAYOUT) for n in "ab")
    run_batch(some_pages(spark, ids), one, work)
    for part in (ids[:7], ids[7:20], ids[:30], ids[30:]):
        run_batch(some_pages(spark, part), many, work)
    assert final(one) == final(many) and len(final(one)) == 17


def test_failed_pages_are_tried_again(spark, folder):
    progress = Progress(spark, f"{folder}/p", LAYOUT)
    run_batch(some_pages(spark, [0, 1]), progress, work)
    assert [u for _, u, _ in final(progress)] == ["https://h/1"]
    run_batch(some_pages(spark, [17, 18]), progress, work)  # the same two addresses
    assert [(i, u) for i, u, _ in final(progress)] == [(1, "https://h/1"), (17, "https://h/0")]


def test_stream_equals_batches(spark, folder):
    ids = [i for i in range(60) if i % 5]
    batch, stream = (Progress(spark, f"{folder}/{n}", LAYOUT) for n in "ab")
    run_batch(some_pages(spark, ids), batch, work)
    for n, part in enumerate((ids[:20], ids[20:33], ids[33:])):
        some_pages(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        if n == 1:
            start_stream(spark, f"{folder}/in", stream, work, f"{folder}/cp", files_per_trigger=1).awaitTermination()
    start_stream(spark, f"{folder}/in", stream, work, f"{folder}/cp", files_per_trigger=1).awaitTermination()
    assert {(u) for _, u, _ in final(batch)} == {u for _, u, _ in final(stream)}
    assert len(final(stream)) == 17 and stream.next_batch("stream") == 3


def test_stream_resumes_after_a_failure(spark, folder):
    progress = Progress(spark, f"{folder}/p", LAYOUT)
    for part in ([1, 2], [3, 4], [6, 7]):
        some_pages(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    calls = []

    def shaky(pages):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return work(pages)

    with pytest.raises(Exception, match="lost"):
        start_stream(spark, f"{folder}/in", progress, shaky, f"{folder}/cp", files_per_trigger=1).awaitTermination()
    assert len(final(progress)) == 2
    start_stream(spark, f"{folder}/in", progress, shaky, f"{folder}/cp", files_per_trigger=1).awaitTermination()
    assert [i for i, _, _ in final(progress)] == [1, 2, 3, 4, 6, 7]


def test_distinct_pages_of_a_stream(spark, folder):
    timed = some_pages(spark, [1, 18, 2]).withColumn("seen_at", F.timestamp_seconds(F.col("page_id")))
    timed.coalesce(1).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(timed.schema).parquet(f"{folder}/in")
    query = (distinct_pages(stream, "seen_at").writeStream.format("memory").queryName("seen")
             .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start())
    query.awaitTermination()
    assert sorted(r["url"] for r in spark.table("seen").collect()) == ["https://h/1", "https://h/2"]


def test_update_and_export(spark, folder):
    html = '<h1>N{0}</h1><div class="tool-detail-information">What is N{0} newsletter aid How to use N{0}</div>'
    pages = spark.createDataFrame([(i, f"https://h/{i}", html.format(i)) for i in range(5)], "page_id bigint, url string, html string")
    progress = Progress(spark, f"{folder}/p", DETAIL)
    assert update(pages.limit(2), progress, SiteProfile()) == 0 and update(pages, progress, SiteProfile()) == 1
    stored = progress.results()
    assert stored.count() == 5
    shown = save_listings(stored.drop("social_links"), f"{folder}/json", SiteProfile())
    assert [tuple(r) for r in shown.collect()][:2] == [("Email Marketing", "category", None, 5), ("Email Marketing", "name", "N0", 1)]
    profile = {r["column_name"]: (r["non_empty"], r["n_rows"]) for r in json_to_csv(spark, f"{folder}/json", f"{folder}/csv").collect()}
    assert profile["name"] == (5, 5) and profile["short_description"] == (5, 5) and profile["features"] == (0, 5)
    assert save_listings(stored.filter("false"), f"{folder}/none", SiteProfile()) is None


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark, "x") == spark.conf.get("spark.checkpoint.dir").rstrip("/") + "/x"


def test_detail_records(spark):
    html = ('<h1>Acme</h1><div class="tool-detail-information">Newsletter and drip campaign sender'
            '<img src="/logo.png" width=40 height=40></div><a href="https://own.site"><div class="visitWebsite">v</div></a>')
    rows = [(1, "https://d/1", html), (2, "https://d/2", "<h1>none</h1>"), (3, "https://d/3", html.replace("own.site", "gone.site"))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    own = spark.createDataFrame([("https://own.site", "<img src=/brand.png width=50 height=50><img src=/z.png>")], "url string, html string")
    got = {r["page_id"]: r for r in detail_records(pages, SiteProfile(), own_sites=own).collect()}
    assert sorted(got) == [1, 3] and set(got[1].asDict()) == set(DETAIL)
    assert got[1]["logo_url"] == "https://own.site/brand.png"
    assert got[3]["logo_url"] == "https://directory.example.com/logo.png"
    assert got[1]["category"] == "Email Marketing"
    assert got[1]["img_url"] == "https://assets.example.com/screenshots/acme_content.png"
    assert got[1]["features_screenshot_url"] is None


def test_pages_without_address_are_all_kept_once(spark, folder):
    progress = Progress(spark, f"{folder}/p", LAYOUT)
    rows = [(i, None, f"<title>t{i}</title>") for i in (1, 2)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for _ in range(3):
        run_batch(pages, progress, work)
    assert [i for i, _, _ in final(progress)] == [1, 2]


def test_a_failed_first_copy_does_not_hide_a_whole_one(spark, folder):
    progress = Progress(spark, f"{folder}/p", LAYOUT)
    rows = [(3, "https://h/x", "<p>cut"), (4, "https://h/x", "<title>whole</title>"), (5, "https://h/x", "<title>later</title>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    run_batch(pages, progress, work)
    assert final(progress) == [(4, "https://h/x", "whole")]
    assert progress.rejected("batch").count() == 0


def test_rejects_say_why_and_come_back(spark, folder):
    progress = Progress(spark, f"{folder}/p", LAYOUT)
    pages = spark.createDataFrame([(1, "u", None), (2, "v", "<p>x")], "page_id bigint, url string, html string")
    run_batch(pages, progress, work)
    run_batch(pages.limit(0), progress, work)
    got = {r["page_id"]: (r["reason"], r["attempts"]) for r in progress.rejected("batch").collect()}
    assert got == {1: ("no page", 2), 2: ("no record", 2)}
    told = lambda p: p.selectExpr("page_id", "url", "'n' AS name", "CASE WHEN page_id = 2 THEN 'broken' END AS parse_error")
    run_batch(pages.limit(0), progress, told)
    assert [tuple(r) for r in progress.rejected("batch").select("page_id", "reason", "attempts").collect()] == [(2, "broken", 3)]
    assert final(progress) == [(1, "u", "n")]


def test_failed_pages_of_a_stream_come_back(spark, folder):
    progress, open_ = Progress(spark, f"{folder}/p", LAYOUT), []

    def later(pages):
        return work(pages) if open_ else work(pages).filter("page_id <> 2")

    for part in ([1, 2], [3]):
        some_pages(spark, part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        start_stream(spark, f"{folder}/in", progress, later, f"{folder}/cp").awaitTermination()
        open_.append(1)
    assert [i for i, _, _ in final(progress)] == [1, 2, 3]


def test_many_batches_are_compacted(spark, folder):
    progress = Progress(spark, f"{folder}/p", LAYOUT)
    for i in (1, 2, 3, 4):
        run_batch(some_pages(spark, [i]), progress, work)
    before = final(progress)
    progress.compact("batch")
    # The last batch stays by itself, as a stream may repeat it.
    assert final(progress) == before and [(b["first"], b["last"]) for b in progress.batches("batch")] == [(0, 2), (3, 3)]
    run_batch(some_pages(spark, [1, 6]), progress, work)
    assert [i for i, _, _ in final(progress)] == [1, 2, 3, 4, 6]


def streamed(spark, folder, progress, ids, retries=Retries(), then=work):
    some_pages(spark, ids).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    start_stream(spark, f"{folder}/in", progress, then, f"{folder}/cp", files_per_trigger=1, retries=retries).awaitTermination()


def test_a_stream_goes_on_after_compaction(spark, folder):
    progress = Progress(spark, f"{folder}/p", LAYOUT)
    for i in (1, 2, 3, 4):
        streamed(spark, folder, progress, [i])
    progress.compact("stream")
    progress.index()
    streamed(spark, folder, progress, [4, 6, 21])  # 21 has the address of 4
    assert [i for i, _, _ in final(progress)] == [1, 2, 3, 4, 6]
    progress.compact("stream")
    streamed(spark, folder, progress, [1, 7])
    assert [i for i, _, _ in final(progress)] == [1, 2, 3, 4, 6, 7]
    assert progress.vacuum(0) > 0 and [i for i, _, _ in final(progress)] == [1, 2, 3, 4, 6, 7]


def test_a_repeated_batch_takes_the_place_of_its_first_try(spark, folder):
    from shelfmark.streaming.ingest import _step

    progress = Progress(spark, f"{folder}/p", LAYOUT)
    run_batch(some_pages(spark, [1]), progress, work)
    run_batch(some_pages(spark, [2]), progress, work)
    run_batch(some_pages(spark, [3]), progress, work)
    progress.compact("batch")
    progress.index()
    _step(some_pages(spark, [3, 4, 1]), progress, work, "batch", 2)
    assert [i for i, _, _ in final(progress)] == [1, 2, 3, 4] and progress.next_batch("batch") == 3


def test_two_writers_at_once_lose_nothing(spark, folder):
    manifest = Manifest(spark, f"{folder}/m")

    def add(writer):
        for i in range(25):
            manifest.commit(lambda state: {"seen": [*state.get("seen", []), f"{writer}:{i}"]})

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, "abcd"))
    version, state = manifest.read()
    assert version == 100 and sorted(state["seen"]) == sorted(f"{w}:{i}" for w in "abcd" for i in range(25))
    assert len([f for f in Path(f"{folder}/m").iterdir() if not f.name.startswith(".")]) == KEPT

    progress = Progress(spark, f"{folder}/p", LAYOUT)
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda r: run_batch(some_pages(spark, [1, 2] if r == "x" else [3, 4]), progress, work, run=r), "xy"))
    assert [i for i, _, _ in final(progress)] == [1, 2, 3, 4]


def test_a_table_of_many_batches_opens_with_one_file(spark, folder):
    progress = Progress(spark, f"{folder}/p", LAYOUT)
    run_batch(some_pages(spark, [1]), progress, work)
    one = progress.batches()[0]
    progress.manifest.commit(lambda state: {**state, "batches": [{**one, "run": "r", "first": i, "last": i} for i in range(10_000)]})
    opened = []

    class Counting:
        def __init__(self, files):
            self.files = files

        def __getattr__(self, name):
            return (lambda *a: opened.append(1) or self.files.open(*a)) if name == "open" else getattr(self.files, name)

    progress.manifest.files = Counting(progress.manifest.files)
    assert progress.next_batch("r") == 10_000 and len(opened) == 1


def test_queue_waits_gives_up_and_keeps_each_page_once(spark, folder):
    progress, retries, start = Progress(spark, f"{folder}/p", LAYOUT), Retries(limit=3, wait_seconds=60), datetime(2024, 1, 1)
    tried = []

    def never(pages):
        tried.append(sorted(r.page_id for r in pages.select("page_id").collect()))
        return work(pages).filter("page_id <> 2")

    nothing, at = some_pages(spark, [1]).limit(0), lambda s: start + timedelta(seconds=s)
    run_batch(some_pages(spark, [1, 2]), progress, never, retries=retries, now=at(0))
    for seconds in (59, 60, 179, 180, 1000):
        run_batch(nothing, progress, never, retries=retries, now=at(seconds))
    # Due after 60 seconds, then after 120 more; three times in all.
    assert tried == [[1, 2], [], [2], [], [2], []]
    assert progress.rejected("batch").count() == 0
    assert [tuple(r) for r in progress.dead_letters("batch").drop("html").collect()] == [(2, "https://h/2", "no record", 3)]
    assert len(list(Path(f"{folder}/p/stored").iterdir())) == 1
    progress.compact("batch")
    assert progress.dead_letters("batch").first()["html"] == "<title>t2</title>"
    # A new copy of a dead page is tried, and its success ends the matter.
    run_batch(some_pages(spark, [2]), progress, work, retries=retries, now=at(2000))
    assert progress.dead_letters("batch").count() == 0 and [i for i, _, _ in final(progress)] == [1, 2]


def test_work_runs_once_for_rows_and_reasons(spark, folder):
    seen = spark.sparkContext.accumulator(0)

    def told(pages):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return pages.mapInArrow(count, pages.schema).selectExpr(
            "page_id", "url", "'n' AS name", "CASE WHEN page_id = 2 THEN 'broken' END AS parse_error")

    progress = Progress(spark, f"{folder}/p", LAYOUT)
    run_batch(some_pages(spark, [1, 2, 3]), progress, told)
    assert seen.value == 3
    assert [(r.page_id, r.reason) for r in progress.rejected("batch").collect()] == [(2, "broken")]


def test_catalogue_tells_why_a_page_cannot_be_read(spark, folder):
    progress = Progress(spark, f"{folder}/p", DETAIL)
    pages = spark.createDataFrame([(1, "u", "<h1>x</h1>"), (2, "v", None)], "page_id long, url string, html string")
    update(pages, progress, SiteProfile())
    assert {r.page_id: r.reason for r in progress.rejected("batch").collect()} == {1: "no detail area", 2: "no page"}


def test_key_index(spark, folder):
    index = KeyIndex(spark, f"{folder}/k")
    index.build(spark.range(20_000).selectExpr("concat('k', id) AS key").union(spark.sql("SELECT cast(null AS string)")))
    asked = spark.range(19_000, 24_000).selectExpr("concat('k', id) AS key")
    assert index.candidates(asked).count() < 1000 + 0.05 * 4000
    seen = index.seen(asked.union(asked))
    assert sorted(r.key for r in seen.collect()) == sorted(f"k{i}" for i in range(19_000, 20_000))
    few = index.seen(spark.createDataFrame([("k7",), ("k8",), (None,), ("new",)], "key string"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = few._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.key for r in few.collect()) == ["k7", "k8"]
    # The history is read by bucket and by folder, and what stands above it up to the join moves nothing.
    lines = [line for line in plan.split("== Initial Plan ==")[-1].splitlines() if line.strip()]
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    assert "PartitionFilters: [slot" in lines[at]
    depth, above = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            depth = indent
            above.append(line.lstrip(" :+-"))
    assert not any("Exchange" in line for line in above[:[i for i, line in enumerate(above) if "SortMergeJoin" in line][0]])
    empty = KeyIndex(spark, f"{folder}/none")
    empty.build(asked.limit(0))
    assert empty.seen(asked).count() == 0


def test_summaries_equal_the_whole(spark, folder):
    rows = [(i, f"n{i % 7}" if i % 5 else None, [None, "A", "B"][i % 3], "" if i % 2 else "x") for i in range(60)]
    df = spark.createDataFrame(rows, "id int, name string, category string, note string")
    kept = Summaries(spark, f"{folder}/s", ("name", "note"))
    assert kept.category_summary().count() == 0 and kept.column_profile().count() == 0
    for n, (low, high) in enumerate(((0, 10), (10, 11), (11, 40), (40, 60))):
        kept.add(df.filter(f"id < {high}"), "r", n)  # a first try that reads too much, and its repeat
        kept.add(df.filter(f"id >= {low} AND id < {high}"), "r", n)
        if n == 2:
            kept.compact()
    assert kept.category_summary().collect() == summary.category_summary(df).collect()
    assert sorted(kept.column_profile().collect()) == sorted(summary.column_profile(df, "name", "note").collect())
    assert len(kept.manifest.read()[1]["deltas"]) == 2


def test_latest_reply_before_the_page(spark):
    base = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c"), (None, 5, "d"), (None, 5, "d"), (3, None, "e")], "k int, at int, name string")
    log = spark.createDataFrame([
        (1, 10, 1, '{"name": "same"}'), (1, 10, 2, '{"name": "time"}'), (1, 11, 1, "bad"), (1, 12, 1, '[{"name": "list"}]'),
        (1, 12, 1, '[{"name": "list"}]'), (1, 21, 1, '{"name": "late"}'), (2, 6, 1, '{"name": "late"}'), (3, 1, 1, '{"name": "x"}'),
        (None, 1, 1, '{"name": "x"}')], "k int, told int, n int, reply string")
    got = [tuple(r) for r in merge.enriched(base, log, "k", "at", "told", "name string", "n").collect()]
    assert sorted(got, key=repr) == sorted([
        (1, 10, "time", True), (1, 20, "list", True), (2, 5, "c", False), (None, 5, "d", False), (None, 5, "d", False),
        (3, None, "e", False)], key=repr)
