"""Counts, listings and profiles of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from shelfmark.functions.labels import OTHER


def category_counts(df: DataFrame, category: str = "category") -> DataFrame:
    """Records per category; a missing one counts as ``Other``."""
    named = df.select(F.coalesce(category, F.lit(OTHER)).alias("category"))
    return named.groupBy("category").agg(F.count("*").alias("n_tools"))


def by_category(df: DataFrame, category: str = "category") -> DataFrame:
    """The records with their category filled in and its record count.

    Groups stay as rows, so the largest category never gathers in one task:
    the counts are aggregated before they are shuffled, and skewed join
    partitions are split.
    """
    filled = df.withColumn(category, F.coalesce(category, F.lit(OTHER)))
    counts = filled.groupBy(category).agg(F.count("*").alias("n_in_category"))
    return filled.join(counts, category).select(*filled.columns, "n_in_category")


def category_summary(df: DataFrame, category: str = "category", name: str = "name") -> DataFrame:
    """Sorted categories, each with its count and then its sorted names.

    Rows of ``level`` *category* hold the count of a category, rows of level
    *name* how often a name occurs in it. Both come from one grouped pass, and
    the sort is a range partitioning, so large categories are split by name.
    """
    filled = df.select(F.coalesce(category, F.lit(OTHER)).alias("category"), F.col(name).alias("name"))
    total = F.grouping("name") == 1
    grouped = filled.groupingSets([["category"], ["category", "name"]], "category", "name").agg(
        F.when(total, "category").otherwise("name").alias("level"), F.count("*").alias("n_tools")
    )
    return grouped.select("category", "level", "name", "n_tools").orderBy("category", "level", "name")


def column_profile(df: DataFrame, *columns: str) -> DataFrame:
    """Rows and non-empty values per text column, in one pass."""
    chosen = list(columns) or df.columns
    counted = df.agg(
        F.count("*").alias("_rows"), *[F.count_if(F.length(c) > 0).alias(c) for c in chosen]
    )
    return counted.unpivot("_rows", chosen, "column_name", "non_empty").select(
        "column_name", "non_empty", F.col("_rows").alias("n_rows")
    )


def run_metrics(frontier: DataFrame, processed: DataFrame, key: str = "url") -> DataFrame:
    """One row: addresses seen, distinct, done and left."""
    state = frontier.groupBy(key).agg(F.count("*").alias("n")).join(
        processed.select(key).distinct().withColumn("done", F.lit(True)), key, "left"
    )
    return state.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count("*").alias("n_unique"),
        F.count_if(F.col("done")).alias("n_processed"),
        F.count_if(F.col("done").isNull()).alias("n_remaining"),
    )


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """Count rows and failures while ``df`` is written, without another job."""
    seen = Observation()
    failed = F.count_if(F.col("parse_error").isNotNull()) if "parse_error" in df.columns else F.sum(F.lit(0))
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), failed.alias("failed")), seen
