"""Outputs: JSON Lines, CSV, page files and folders by category. Rows are counted while they are written."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from shelfmark.operators.summary import observed


def _sorted(value: Column, kind: DataType) -> Column:
    """Fields of nested structs in name order."""
    if isinstance(kind, StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        ordered = F.struct(*[_sorted(value[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(value.isNotNull(), ordered)
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return F.transform(value, lambda x: _sorted(x, kind.elementType))
    return value


def sorted_fields(df: DataFrame) -> DataFrame:
    """Columns and nested fields in name order."""
    return df.select(*[_sorted(F.col(f.name), f.dataType).alias(f.name)
                       for f in sorted(df.schema.fields, key=lambda f: f.name)])


def _written(df: DataFrame, write: Callable[[DataFrame], None]) -> bool:
    """Write, counting the rows on the way; whether there were any."""
    counted, seen = observed(df)
    write(counted)
    return seen.get["rows"] > 0


def write_json(df: DataFrame, path: str, sort_keys: bool = True, mode: str = "errorifexists") -> bool:
    """Write JSON Lines with NULL fields; False, and a folder without records, for none."""
    rows = sorted_fields(df) if sort_keys else df
    return _written(rows, lambda d: d.write.mode(mode).option("ignoreNullFields", False).json(path))


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> bool:
    """Write CSV with a header; False, and a folder without records, for none."""
    options = {
        "header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False,
        "ignoreTrailingWhiteSpace": False,
    }
    return _written(df, lambda d: d.write.mode(mode).options(**options).csv(path))


def write_by_category(df: DataFrame, path: str, category: str = "category", mode: str = "errorifexists") -> bool:
    """Write one folder per category; a missing one goes to ``Other``.

    Tasks write their own files, so no category has to pass through one task.
    """
    filled = df.withColumn(category, F.coalesce(category, F.lit("Other")))
    return _written(filled, lambda d: d.write.mode(mode).partitionBy(category).parquet(path))


def write_html_files(pages: DataFrame, path: str) -> list[str]:
    """Write ``page_id, html`` as files ``page_id=<number>.html``, a line break after each row; the folders.

    Rows of one number share a file. Every try of a task has a folder of its own,
    and the folders of those that succeeded are returned, so folders grow with
    the tasks and not with the pages.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        own = f"{path}/{context.partitionId()}-{context.taskAttemptId()}"
        store, folder = fs.FileSystem.from_uri(own)
        store.create_dir(folder)
        last, out = None, None
        for batch in batches:
            for number, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if out is None or number != last:
                    if out is not None:
                        out.close()
                    last, out = number, store.open_output_stream(f"{folder}/page_id={number}.html")
                out.write((html or "").encode() + b"\n")
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays([pa.array([own])], names=["folder"])

    rows = pages.select("page_id", "html").repartition("page_id").sortWithinPartitions("page_id")
    return [row["folder"] for row in rows.mapInArrow(work, "folder string").collect()]
