"""Inputs: record files, page tables, page files and listing addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.urls import listing_page_url
from shelfmark.schemas import PAGES, RAW, Layout, ddl


def read_records(spark: SparkSession, path: str, layout: Layout = RAW, array_file: bool = False) -> DataFrame:
    """Listing records from JSON.

    JSON Lines files split over many tasks. A file that is one JSON array does
    not, so ``array_file`` is for files of moderate size. List-or-object fields
    are read as their JSON text.
    """
    return spark.read.schema(ddl(layout)).option("multiLine", array_file).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages from parquet."""
    return spark.read.schema(ddl(PAGES)).parquet(path)


def read_html_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw pages from a folder, or folders, of page files; the file path is the address."""
    files = spark.read.text(path, wholetext=True)
    url = F.input_file_name()
    return files.select(F.xxhash64(url).alias("page_id"), url.alias("url"), F.col("value").alias("html"))


def listing_pages(bases: DataFrame, base_url: str = "base_url", n_pages: str = "n_pages") -> DataFrame:
    """One row per page of each paged listing, numbered from 1."""
    pages = bases.filter(F.col(n_pages) > 0).withColumn(
        "page_no", F.explode(F.sequence(F.lit(1), F.col(n_pages).cast("int")))
    )
    return pages.withColumn("url", listing_page_url(base_url, "page_no"))
