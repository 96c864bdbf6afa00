"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The letters that normalising folds, and no others.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Largest row count of a table that is sent to every executor by a hint.
BROADCAST_ROWS = 200_000

# Rows and bytes of a batch that goes to Python; a larger row goes alone.
BATCH_ROWS, BATCH_BYTES = 200, 4 << 20


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z only; NULL counts as empty.

    ``lower`` does the same for text without other letters and is much faster
    than ``translate``, which goes character by character.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one all executors share (``spark.checkpoint.dir``).

    Spark fixes that setting when a session starts, so a session without it is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("start the session with spark.checkpoint.dir, a folder that all executors share")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: object) -> Iterator[None]:
    """A session setting for as long as a table is written."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stored(df: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage.

    A lost executor then costs a re-read, not the work before. The folder is
    left to the owner of ``spark.checkpoint.dir``, like checkpoint files.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    # Few rows and bytes at once go to Python: texts, sets and packed columns can be large.
    rows = setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    with rows, setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a stored table for broadcast if its counted rows are within ``limit``.

    Beyond the limit the table is returned as it is and joined by a shuffle;
    the rows of the join are the same.
    """
    return F.broadcast(df) if df.count() <= limit else df


def without(df: DataFrame, *names: str) -> list[Column]:
    """All columns of a frame but ``names``, safe for names with dots."""
    return [df[f"`{c}`"] for c in df.columns if c not in names]


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the frame does not have."""
    taken, name, i = {c.lower() for c in df.columns}, stem, 0
    while name.lower() in taken:
        i += 1
        name = f"{stem}_{i}"
    return name


def cut_words(text: Column, spans: Column, word: str) -> Column:
    """Text without the words in ``spans`` (word numbers ``start, end``) and what stands before each.

    ``word`` is the class of a word's characters, ``[^...]``.
    """
    gap = f"[{word[2:-1]}]*"
    pieces = F.regexp_extract_all(text, F.lit(f"{gap}{word}+"), F.lit(0))

    def outside(i: Column) -> Column:
        return ~F.exists(spans, lambda s: (i >= s["start"]) & (i < s["end"]))

    return F.concat(F.array_join(F.filter(pieces, lambda _, i: outside(i)), ""), F.regexp_extract(text, gap + r"\z", 0))
