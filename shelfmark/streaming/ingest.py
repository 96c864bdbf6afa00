"""Incremental ingestion: the same step for batches and for streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfmark.operators.merge import first_by, page_key
from shelfmark.schemas import PAGES, ddl
from shelfmark.sources.progress import Progress, Retries

Work = Callable[[DataFrame], DataFrame]
RETRIES = Retries()


def _step(pages: DataFrame, progress: Progress, work: Work, run: str, batch_id: int, retries: Retries = RETRIES,
          now: datetime | None = None) -> None:
    """Process the new addresses of ``pages`` and store what succeeded, and what did not.

    Failed pages whose time has come are tried again with this batch, beside new
    copies of them. Of several copies of an address the first that succeeds is
    stored. Rows of the batch itself do not count as processed: a repeated batch
    does its work again and replaces its folders. A row of ``work`` with a
    ``parse_error`` is a failure, and so is a page without a row. Pages with
    neither an address nor a number are tried, but not kept for another time.
    """
    clock = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    arrived = pages.select(*PAGES).withColumn("key", page_key())
    queue = progress.queue(run, before=batch_id)
    waiting = queue.filter((F.col("state") == "open") & (F.col("due") <= clock))
    again = progress.kept_pages(waiting).select("key", *PAGES)
    tried = arrived.withColumn("fresh", F.lit(True)).unionByName(again.withColumn("fresh", F.lit(False)))
    new = tried.join(progress.seen(tried.select("key"), run, batch_id), "key", "left_anti")

    # One row for each key, the first success or else the first failure, from one run of the work.
    rows = work(new.select(*PAGES))
    failed = F.col("parse_error") if "parse_error" in rows.columns else F.lit(None).cast("string")
    marked = rows.withColumns({"_key": page_key(), "_failed": failed})
    folder, stored = progress.write_outcomes(first_by(marked, "_key", F.col("_failed").isNotNull(), "page_id"), run, batch_id)

    told = stored.select(F.col("_key").alias("key"), F.col("_failed").alias("told"), F.col("_failed").isNull().alias("done"))
    asked = new.groupBy("key").agg(
        F.min_by(F.struct("page_id", "url"), F.coalesce("page_id", F.lit(0))).alias("p"), F.max("fresh").alias("fresh"),
        F.max(F.col("html").isNotNull()).alias("whole"))
    before = queue.select("key", F.col("attempts").alias("tries"), "stored")
    outcome = asked.filter(F.col("key").isNotNull()).join(told, "key", "left").join(before, "key", "left")
    done = F.coalesce("done", F.lit(False))
    # Successes matter to the queue only where it holds the page.
    outcome = outcome.filter(~done | F.col("tries").isNotNull())
    attempts = F.coalesce("tries", F.lit(0)) + 1
    wait = F.lit(retries.wait_seconds) * F.pow(F.lit(2.0), attempts - 1)
    events = outcome.select(
        "key", "p.page_id", "p.url",
        F.coalesce("told", F.when(F.col("whole"), "no record").otherwise("no page")).alias("reason"), attempts.alias("attempts"),
        F.timestamp_seconds(F.unix_micros(clock) / 1_000_000 + wait).alias("due"),
        F.when(done, "done").when(attempts >= retries.limit, "dead").otherwise("open").alias("state"),
        F.coalesce("stored", F.array().cast("array<string>")).alias("stored"), (F.col("fresh") & ~done).alias("fresh"))
    progress.finish(run, batch_id, folder, *progress.write_queue(events, arrived, batch_id))


def run_batch(pages: DataFrame, progress: Progress, work: Work, run: str = "batch", retries: Retries = RETRIES,
              now: datetime | None = None) -> int:
    """Process one batch and return its number.

    ``run`` belongs to one writer; see ``Progress``. Pages that fail are kept
    with the reason and tried again when they are due (``Progress.rejected``),
    until they are given up (``Progress.dead_letters``). ``now`` stands in for
    the clock.
    """
    batch_id = progress.next_batch(run)
    _step(pages, progress, work, run, batch_id, retries, now)
    return batch_id


def start_stream(spark: SparkSession, folder: str, progress: Progress, work: Work, checkpoint: str,
                 files_per_trigger: int = 1000, run: str = "stream", retries: Retries = RETRIES) -> StreamingQuery:
    """Process the page files that arrived in ``folder``, then stop.

    ``folder`` is a folder or a path pattern. ``checkpoint`` must be on storage
    every executor and a later driver can reach; see ``shared_folder``. Pages
    that wait for another try are taken up by batches of new files.
    """
    arriving = (
        spark.readStream.schema(ddl(PAGES)).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    )
    return (
        arriving.writeStream.foreachBatch(
            lambda pages, batch_id: _step(pages, progress, work, run, batch_id, retries))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder for ``name`` below the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Spark fixes that setting when a session starts, so a session without it is refused.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        raise ValueError("start the session with spark.checkpoint.dir, a folder that all executors share")
    return f"{shared.rstrip('/')}/{name}"


def distinct_pages(pages: DataFrame, event_time: str, delay: str = "1 hour") -> DataFrame:
    """Stream of pages without repeats of an address inside ``delay``.

    For streams that carry an event time; the state is dropped with the
    watermark. Without one, the step above compares with the stored results.
    """
    return pages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["url"])
