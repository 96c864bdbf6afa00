"""Exact dedup by recipes of content-defined chunks.

Texts are equal when identical after lower-casing A-Z. A text is cut where its
own content says so: at the first sentence or line end after ``LEAST``
characters, at ``MOST`` at the latest. So equal passages give equal chunks
wherever they stand. A chunk's identifier is its 64-bit hash, verified by
bringing the distinct chunks of all texts together once: where two chunks share
a hash, the identifier is void. A text's recipe is the ordered list of its
identifiers. Texts with the same recipe of valid identifiers are equal; a text
with a void one is compared as a whole. Whole documents are never shuffled
(but for those with void identifiers), chunks once, recipes after that.

Edge cases. NULL counts as the empty text, whose recipe is empty; so all NULL
and empty rows are equal. The row with the largest id stays; rows without id
come last, and of rows that repeat in full all have the same answer, ``kept``
included. An empty table gives an empty result. Extra columns are ignored by
``groups`` and kept by ``keep_last``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.base import each
from shelfmark.llm.common import fold_ascii, fresh, small, stored

LEAST, MOST = 512, 8_192


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """Content-defined pieces of a text; joined they are the text."""
    cut = rf"(?s).{{{least},{most - 1}}}?(?:[.\n]|\z)|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def recipes(docs: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, recipe, whole`` for every row.

    ``recipe`` lists the chunks' identifiers; ``whole`` is NULL, or the text if
    one of them is void.
    """
    texts = docs.select("doc_id", fold_ascii(F.col("text")).alias("norm"))
    pieces = texts.select(each(chunks(F.col("norm"))).alias("chunk")).filter(F.col("chunk").isNotNull())
    distinct = pieces.groupBy(F.xxhash64("chunk").alias("id"), "chunk").agg(F.count(F.lit(1)).alias("n"))
    void = stored(distinct.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id"))
    rows = texts.select(
        "doc_id", F.sha2("norm", 256).alias("text_sha256"),
        F.transform(chunks(F.col("norm")), lambda c: F.xxhash64(c)).alias("recipe"), "norm",
    )
    if void.isEmpty():
        return rows.select("doc_id", "text_sha256", "recipe", F.lit(None).cast("string").alias("whole"))
    # The void identifiers of each text, found by identifier; texts themselves stay where they are.
    bad = stored(
        rows.select(F.explode(F.array_distinct("recipe")).alias("id"), "recipe").join(small(void), "id", "left_semi")
        .select(F.col("recipe").alias("_r")).distinct())
    return rows.join(small(bad), F.col("recipe") == F.col("_r"), "left").select(
        "doc_id", "text_sha256", "recipe", F.when(F.col("_r").isNotNull(), F.col("norm")).alias("whole"))


def groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row."""
    rows = stored(recipes(docs))
    sizes = rows.groupBy(F.col("recipe").alias("_r"), F.col("whole").alias("_w")).agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    same = (F.col("recipe") == F.col("_r")) & F.col("whole").eqNullSafe(F.col("_w"))
    return rows.join(sizes, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_last(docs: DataFrame) -> DataFrame:
    """Of equal texts the row with the largest id; columns are unchanged.

    Rows are known by id and text together. Of rows with the same id and equal texts one stays, so
    one of those whose text has no id at all.
    """
    d, m = fresh(docs, "_d"), fresh(docs, "_m")
    found = stored(groups(docs).select(F.col("doc_id").alias(d), F.col("text_sha256").alias(m), "kept"))
    own = F.sha2(fold_ascii(F.col("text")), 256)
    same = F.col("doc_id").eqNullSafe(F.col(d)) & (own == F.col(m))
    kept = docs.join(small(stored(found.filter("not kept").select(d, m).distinct())), same, "left_anti")
    again = stored(found.filter("kept").groupBy(d, m).count().filter("count > 1").select(d, m))
    if again.isEmpty():
        return kept
    twice = kept.join(small(again), same, "left_semi").withColumn(m, own)
    return kept.join(small(again), same, "left_anti").unionByName(twice.dropDuplicates(["doc_id", m]).drop(m))


def report(docs: DataFrame) -> DataFrame:
    return groups(docs)
