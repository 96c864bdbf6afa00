"""Line dedup by site-relative frequency.

For every host the pages that contain a line are counted and divided by the
host's pages. A line on more than ``ratio`` of them is boilerplate of that host
and is dropped from all of its pages, at every size of the host; only a line on
fewer than ``least_pages`` pages, which repeats nothing, stays. Lines are compared without the blanks around them; blank lines are
neither counted nor dropped. A line is known by two 64-bit hashes.

Edge cases. Rows without host form one host. NULL text stays NULL and counts as
a page without lines. A line repeated in a page counts once. A page may lose
all its lines: its text is then empty. Rows that repeat are pages like any
other. An empty table gives an empty result. Other columns, whatever their
names, are kept; ``n_chars`` is set to the new length where it exists as a
number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import BROADCAST_ROWS, fresh, stored

RATIO, LEAST_PAGES = 0.05, 2
_BLANKS = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _name(line: Column) -> Column:
    """Identity of a line, NULL if it is blank."""
    bare = F.btrim(line, F.lit(_BLANKS))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("x"), F.xxhash64(bare, F.lit("line")).alias("y")))


def boilerplate(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """``host, line, pages`` of the lines to drop."""
    pages = docs.select(F.col(host).alias("host"), F.array_distinct(F.transform(_lines(F.col("text")), _name)).alias("names"))
    counts = (
        pages.select("host", F.explode_outer("names").alias("line")).filter(F.col("line").isNotNull())
        .groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= least_pages)
    )
    totals = docs.groupBy(F.col(host).alias("of")).agg(F.count(F.lit(1)).alias("total"))
    return (
        counts.join(totals, F.col("host").eqNullSafe(F.col("of")))
        .filter(F.col("pages") > F.lit(ratio) * F.col("total")).select("host", "line", "pages")
    )


def marked(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> tuple[DataFrame, str]:
    """(documents with the lines of their host that are dropped, the column's name).

    A host has few such lines: at most its lines per page divided by ``ratio``.
    They are gathered per host and joined to the pages, so that texts stay in
    place where the lines of all hosts together are few enough to send to every
    executor; else texts move once, by host.
    """
    found = stored(boilerplate(docs, host, ratio, least_pages))
    name, h = fresh(docs, "dropped"), fresh(docs, "_host")
    per_host = found.groupBy(F.col("host").alias(h)).agg(F.collect_list("line").alias(name))
    if found.count() <= BROADCAST_ROWS:
        per_host = F.broadcast(per_host)
    return docs.join(per_host, F.col(host).eqNullSafe(F.col(h)), "left").drop(h), name


def _kept(name: str) -> Column:
    return F.filter(_lines(F.col("text")), lambda line: ~F.coalesce(F.array_contains(F.col(name), _name(line)), F.lit(False)))


def drop_lines(docs: DataFrame, host: str = "source", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Documents without the boilerplate lines of their host; columns unchanged."""
    rows, name = marked(docs, host, ratio, least_pages)
    text = F.when(F.col(name).isNull(), F.col("text")).otherwise(F.array_join(_kept(name), "\n"))
    rows = rows.withColumn("text", text).drop(name)
    kinds = dict(docs.dtypes)
    if kinds.get("n_chars") in ("bigint", "int"):
        rows = rows.withColumn("n_chars", F.coalesce(F.char_length("text"), F.col("n_chars")).cast(kinds["n_chars"]))
    return rows


def report(docs: DataFrame) -> DataFrame:
    """Lines before and after for every document, and a digest of the text that stays."""
    rows, name = marked(docs)
    rows = rows.select(
        "doc_id", F.coalesce(F.size(_lines(F.col("text"))), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull(), None).when(F.col(name).isNull(), _lines(F.col("text"))).otherwise(_kept(name)).alias("kept"))
    return rows.select(
        "doc_id", F.when(F.col("kept").isNull(), 0).otherwise(F.col("n_lines")).alias("n_lines"),
        F.when(F.col("kept").isNull(), 0).otherwise(F.size("kept")).cast("long").alias("n_kept"),
        F.sha2(F.coalesce(F.array_join("kept", "\n"), F.lit("")), 256).alias("text_sha256"))
