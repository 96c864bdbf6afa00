"""Stored records to exchange files, with their summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.operators import records, summary
from shelfmark.operators.rules import RuleSet
from shelfmark.schemas import FLAT_COLUMNS, FORMATTED, ddl
from shelfmark.settings import SiteProfile
from shelfmark.sources import readers, writers


def json_to_csv(spark: SparkSession, json_path: str, csv_path: str, array_file: bool = False) -> DataFrame | None:
    """Convert record files to CSV; gives the profile of the written columns.

    The profile reads the written files, so the records are flattened once.
    """
    flat = records.flatten(readers.read_records(spark, json_path, array_file=array_file))
    if not writers.write_csv(flat, csv_path):
        return None
    layout = ddl({name: "string" for name in FLAT_COLUMNS})
    written = spark.read.schema(layout).options(header=True, quote='"', escape='"', multiLine=True).csv(csv_path)
    return summary.column_profile(written, *FLAT_COLUMNS)


def save_listings(raw: DataFrame, json_path: str, site: SiteProfile, rules: RuleSet | None = None) -> DataFrame | None:
    """Format records and write them as JSON; gives the category summary.

    The summary reads the written files, so the records are classified once.
    """
    if not writers.write_json(records.format_records(raw, site, rules), json_path):
        return None
    written = raw.sparkSession.read.schema(ddl(FORMATTED)).json(json_path)
    return summary.category_summary(written)
