"""Summaries kept up batch by batch.

A batch adds a delta: its counts by category and name, and its profile. Reading
sums the deltas, so nothing is counted twice and no batch is read again for the
next one. A repeated batch takes the place of its earlier delta. ``compact``
sums all deltas into one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.labels import OTHER
from shelfmark.schemas import Layout, ddl
from shelfmark.sources.manifest import Manifest

DELTA: Layout = {"category": "string", "name": "string", "column_name": "string", "n": "bigint", "n_rows": "bigint"}


class Summaries:
    """Deltas below ``path``, for records with the text columns ``columns``."""

    def __init__(self, spark: SparkSession, path: str, columns: tuple[str, ...], category: str = "category", name: str = "name") -> None:
        self.spark, self.path, self.columns, self.category, self.name = spark, path.rstrip("/"), columns, category, name
        self.manifest = Manifest(spark, f"{self.path}/manifest")

    def add(self, records: DataFrame, run: str, batch_id: int) -> None:
        """Store the delta of one batch, read once."""
        folder = uuid.uuid4().hex
        cells = [F.struct(F.lit(c).alias("column_name"), (F.length(c) > 0).cast("bigint").alias("non_empty")) for c in self.columns]
        grouped = records.select(
            F.coalesce(self.category, F.lit(OTHER)).alias("category"), F.col(self.name).alias("name"), F.explode(F.array(
                F.struct(F.lit(None).cast("string").alias("column_name"), F.lit(1).cast("bigint").alias("non_empty")), *cells)).alias("c"))
        # One grouping for both: rows without a column name are the counts, the others the profile.
        is_profile = F.col("c.column_name").isNotNull()
        delta = grouped.groupBy(
            F.when(~is_profile, F.col("category")).alias("category"), F.when(~is_profile, F.col("name")).alias("name"),
            F.col("c.column_name").alias("column_name")).agg(F.sum("c.non_empty").alias("n"), F.count(F.lit(1)).alias("n_rows"))
        delta.write.parquet(f"{self.path}/deltas/{folder}")

        def change(state: dict) -> dict:
            others = [d for d in state.get("deltas", []) if (d["run"], d["batch_id"]) != (run, int(batch_id))]
            return {**state, "deltas": [*others, {"run": run, "batch_id": int(batch_id), "folder": folder}]}

        self.manifest.commit(change)

    def _deltas(self) -> DataFrame:
        folders = [d["folder"] for d in self.manifest.read()[1].get("deltas", [])]
        if not folders:
            return self.spark.createDataFrame([], ddl(DELTA))
        return self.spark.read.schema(ddl(DELTA)).parquet(*[f"{self.path}/deltas/{f}" for f in folders])

    def category_summary(self) -> DataFrame:
        """What ``summary.category_summary`` gives over all batches together."""
        total = F.grouping("name") == 1
        return (
            self._deltas().filter("column_name IS NULL").groupingSets([["category"], ["category", "name"]], "category", "name")
            .agg(F.when(total, "category").otherwise("name").alias("level"), F.sum("n").alias("n_tools"))
            .select("category", "level", "name", "n_tools").orderBy("category", "level", "name"))

    def column_profile(self) -> DataFrame:
        """What ``summary.column_profile`` gives over all batches together; without records no rows."""
        return self._deltas().filter("column_name IS NOT NULL").groupBy("column_name").agg(
            F.sum(F.coalesce("n", F.lit(0))).alias("non_empty"), F.sum("n_rows").alias("n_rows"))

    def compact(self) -> None:
        """Sum the deltas up to now into one; batches that are repeated later must be newer than these."""
        before = self.manifest.read()[1].get("deltas", [])
        if len(before) < 2:
            return
        folder, gone = uuid.uuid4().hex, {d["folder"] for d in before}
        self._deltas().groupBy("category", "name", "column_name").agg(F.sum("n").alias("n"), F.sum("n_rows").alias("n_rows")).write.parquet(
            f"{self.path}/deltas/{folder}")

        def change(state: dict) -> dict:
            deltas = state.get("deltas", [])
            if not gone <= {d["folder"] for d in deltas}:
                return state  # a batch was repeated meanwhile
            return {**state, "deltas": [{"run": "", "batch_id": -1, "folder": folder}, *(d for d in deltas if d["folder"] not in gone)]}

        self.manifest.commit(change)
