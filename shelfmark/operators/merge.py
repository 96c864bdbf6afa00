"""Combine record sets: what is left to do, first wins, overlays, fallbacks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.functions.arrays import parse_reply
from shelfmark.functions.base import ColumnLike, col


def remaining(frontier: DataFrame, processed: DataFrame, key: str = "url") -> DataFrame:
    """Distinct keys of ``frontier`` that were not processed yet."""
    return frontier.select(key).distinct().join(processed.select(key), key, "left_anti")


def page_key(url: ColumnLike = "url", row_id: ColumnLike = "page_id") -> Column:
    """What tells pages apart: the address, or the page's own number where it has none."""
    return F.coalesce(col(url), F.concat(F.lit("page:"), col(row_id).cast("string")))


def new_pages(pages: DataFrame, processed: DataFrame) -> DataFrame:
    """Pages whose key (``page_key``) was not processed yet, copies of an address included.

    Which copy of an address is stored is decided after the work, among those
    that succeeded; a copy that fails must not hide a whole one.
    """
    number = "page_id" if "page_id" in processed.columns else F.lit(None).cast("string")
    done = processed.select(page_key("url", number).alias("_done")).distinct()
    return pages.join(done, page_key() == F.col("_done"), "left_anti")


def first_success(rows: DataFrame) -> DataFrame:
    """Of the rows of each page key the one with the lowest ``page_id``."""
    return first_by(rows.withColumn("_key", page_key()), "_key", "page_id").drop("_key")


def first_by(df: DataFrame, key: str | list[str], *order: str | Column) -> DataFrame:
    """The first row of each key in the given order.

    Spark keeps one row per key and task before the shuffle (window group
    limit), so a key that holds much of the data does not gather in one task.
    """
    return first_k(df, key, 1, *order)


def first_k(df: DataFrame, key: str | list[str], k: int, *order: str | Column) -> DataFrame:
    """The first ``k`` rows of each key in the given order."""
    keys = [key] if isinstance(key, str) else key
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def unseen(df: DataFrame, history: DataFrame, key: str, *order: str | Column) -> DataFrame:
    """First row of each key that ``history`` does not hold.

    Repeats go first, so only one row per key meets the history.
    """
    return first_by(df, key, *order).join(history.select(key), key, "left_anti")


def overlay(base: DataFrame, enriched: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Replace ``fields`` of base by the enriched values that are not NULL.

    ``enriched`` holds one row per key at most.
    """
    new = enriched.select(key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    joined = base.join(new, key, "left")
    return joined.select(
        *[F.coalesce(f"_new_{c}", c).alias(c) if c in fields else F.col(c) for c in base.columns]
    )


def fallback_source(primary: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """All rows of ``primary`` and the rows of ``other`` for keys it lacks."""
    return primary.unionByName(other.join(primary.select(key), key, "left_anti"))


def append(*parts: DataFrame) -> DataFrame:
    """Records one after the other; a field missing in one part is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def mark_processed(processed: DataFrame, done: DataFrame, key: str = "url") -> DataFrame:
    """Processed keys after a batch; failed items are not in ``done``."""
    return processed.select(key).union(done.select(key)).distinct()


def as_of(base: DataFrame, log: DataFrame, key: str, at: str, log_at: str, value: str, *order: str) -> DataFrame:
    """``base`` with the ``value`` of the latest row of ``log`` for its key that is not after its time.

    Rows of the log at the same time as a base row count; among themselves they go by ``order``. Both
    sides pass one sort by key and time, so nothing is paired: work is linear in their rows. A key that
    is NULL has no log, and its rows are spread over tasks. Rows of ``base`` all stay; ``value`` is NULL where no row of the log is early enough.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in base.columns])
    asked = base.select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_asked"), row.alias("_row"),
                        F.when(F.col(key).isNull(), F.monotonically_increasing_id()).otherwise(0).alias("_spread"),
                        *[F.lit(None).cast(log.schema[c].dataType).alias(f"_o{i}") for i, c in enumerate(order)],
                        F.lit(None).cast(log.schema[value].dataType).alias("_value"))
    told = log.filter(F.col(key).isNotNull() & F.col(log_at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(log_at).alias("_at"), F.lit(0).alias("_asked"),
        F.lit(None).cast(asked.schema["_row"].dataType).alias("_row"), F.lit(0).cast("long").alias("_spread"),
        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], F.col(value).alias("_value"))
    by_time = W.partitionBy("_key", "_spread").orderBy("_at", "_asked", *[f"_o{i}" for i in range(len(order))])
    latest = F.last("_value", ignorenulls=True).over(by_time.rowsBetween(W.unboundedPreceding, W.currentRow))
    met = asked.unionByName(told).withColumn("_latest", F.when(F.col("_key").isNotNull() & F.col("_at").isNotNull(), latest))
    return met.filter("_asked = 1").select("_row.*", F.col("_latest").alias(value))


def enriched(listings: DataFrame, replies: DataFrame, key: str, at: str, reply_at: str, schema: str, *order: str) -> DataFrame:
    """Listings with the fields of their latest good reply in place of their own.

    ``replies`` has JSON text in ``reply``: an object or a list whose first counts. Text that is no such
    reply is passed over, so an earlier good one stays in force. A field the reply lacks keeps its value;
    ``enriched`` tells whether there was a reply.
    """
    good = replies.withColumn("reply", parse_reply("reply", schema)).filter("reply IS NOT NULL")
    met = as_of(listings, good, key, at, reply_at, "reply", *order)
    fields = met.schema["reply"].dataType.names
    return met.select(
        *[F.coalesce(F.col("reply")[c], F.col(c)).alias(c) if c in fields else F.col(c) for c in listings.columns],
        F.col("reply").isNotNull().alias("enriched"))
