"""Benchmark decontamination: word windows of test items found in documents.

Words are runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z. An
item's windows are its runs of ``n`` consecutive words; an item with fewer
words, but not none, is one window. Every document position is looked up by
the hash of the words that follow it, and a hit counts only if the words
themselves are equal.

Edge cases. NULL or empty text: no words, not contaminated. A NULL ``doc_id``
is a key like any other. Repeated rows are answered once each. An item whose
text is NULL or has no word never matches, an empty benchmark matches nothing.
Other columns, whatever their names, are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.llm.common import cut_words, fold_ascii, fresh, small, stored

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10


# Windows sent to every executor at most; a larger set is joined by a shuffle.
BROADCAST_WINDOWS = 1_000_000


def word_hashes(words: str | Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def words(text: Column) -> Column:
    """Words of a text in order."""
    return F.filter(F.split(fold_ascii(text), NOT_WORD), lambda w: w != "")


def with_window_hashes(df: DataFrame, n: int) -> DataFrame:
    """Replace the array ``h`` of word hashes by the hashes of ``n`` words at each position.

    Built by doubling: two words, four, eight, and the rest. Each level is a
    column of its own, so it is worked out once. Entries that run past the end
    hash fewer words; comparing the words themselves rules them out.
    """

    def joined(left: str, right: str, by: int) -> Column:
        rest = F.slice(right, F.lit(by + 1), F.greatest(F.size(right) - by, F.lit(0)))
        return F.zip_with(left, rest, lambda a, b: F.xxhash64(a, b))

    size = 1
    df = df.withColumnRenamed("h", "h1")
    while size * 2 <= n:
        df = df.withColumn(f"h{size * 2}", joined(f"h{size}", f"h{size}", size))
        size *= 2
    whole, covered = f"h{size}", size
    while covered < n:
        step = 1 << ((n - covered).bit_length() - 1)
        df = df.withColumn(f"t{covered + step}", joined(whole, f"h{step}", covered))
        whole, covered = f"t{covered + step}", covered + step
    kept = [c for c in df.columns if c[0] not in "ht" or not c[1:].isdigit()]
    return df.select(*kept, F.col(whole).alias("h"))


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """``item_id, size, window`` (text of the window's words), distinct."""
    listed = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = listed.select(
        "item_id", "w", F.least(F.lit(n), F.size("w")).alias("size"),
        F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))).alias("at"),
    )
    return starts.select(
        "item_id", "size", F.array_join(F.slice("w", F.col("at"), F.col("size")), " ").alias("window")
    ).distinct()


def scan(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document: ``doc_id, mark, n_words, n_hit, spans, item_ids``.

    ``mark`` hashes the text, so that ``doc_id, mark`` tells rows apart also
    where an id was given twice. ``spans`` are the disjoint word ranges covered,
    as ``start, end`` (end not included); ``item_ids`` are sorted as strings.
    """
    items = stored(item_windows(benchmark, n))
    windows = items.select("size", "window", F.xxhash64("size", "window").alias("window_id")).distinct()
    counts = {r["size"]: r["count"] for r in windows.groupBy("size").count().limit(n).collect()}
    listed = (
        docs.select("doc_id", F.xxhash64("text").alias("mark"), words(F.col("text")).alias("w"))
        .withColumn("h", word_hashes("w"))
    )
    # Sets of windows small enough to send to every executor; several where there are more windows.
    sets = [(size, part, -(-count // BROADCAST_WINDOWS)) for size, count in sorted(counts.items())
            for part in range(-(-count // BROADCAST_WINDOWS))] or [(n, 0, 1)]
    seen = None
    for size, part, parts in sets:
        wanted = with_window_hashes(
            windows.filter((F.col("size") == size) & (F.pmod("window_id", F.lit(parts)) == part))
            .withColumn("h", word_hashes(F.split("window", " "))), size,
        ).select(F.col("h")[0].alias("key"), "window", "window_id")
        placed = with_window_hashes(listed, size)
        # A first entry that is no window carries the document's word count through the same pass.
        # The outer form: the inner one has the array worked out twice, for a filter on its size.
        keys = F.concat(F.array(F.xxhash64("doc_id", "mark")), "h") if seen is None else F.col("h")
        first = 1 if seen is None else 0
        placed = placed.select("doc_id", "mark", "w", F.posexplode_outer(keys).alias("at", "key")).withColumn(
            "at", F.col("at") - first)
        equal = F.array_join(F.slice("w", F.col("at") + 1, F.lit(size)), " ") == F.col("window")
        rows = placed.join(F.broadcast(wanted), "key", "left").select(
            "doc_id", "mark", F.when(F.col("at") < 0, F.size("w")).alias("n_words"), "at", F.lit(size).alias("size"),
            F.when((F.col("at") >= 0) & F.col("window").isNotNull() & equal, F.col("window_id")).alias("window_id"),
        ).filter((F.col("at") < 0) | F.col("window_id").isNotNull())
        seen = rows if seen is None else seen.union(rows)
    seen = stored(seen)
    pairs = items.select(F.xxhash64("size", "window").alias("window_id"), "item_id").distinct()

    key = ["doc_id", "mark"]
    found = seen.filter("at >= 0").select(*key, "at", "size", "window_id").distinct()
    so_far = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    up_to = W.partitionBy(*key).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    covered = (
        found.groupBy(*key, "at").agg(F.max("size").alias("size"))
        .withColumn("end", F.col("at") + F.col("size"))
        .withColumn("before", F.coalesce(F.max("end").over(so_far), F.lit(0)))
        .withColumn("block", F.sum(F.when(F.col("at") > F.col("before"), 1).otherwise(0)).over(up_to))
        .groupBy(*key, "block").agg(F.min("at").alias("start"), F.max("end").alias("end"))
        .groupBy(*key).agg(
            F.sum(F.col("end") - F.col("start")).cast("long").alias("n_hit"),
            F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
        )
    )
    named = (
        found.select(*key, "window_id").distinct().join(pairs, "window_id")
        .groupBy(*key).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    all_rows = seen.filter("at < 0").select(*key, "n_words")
    for part in (covered, named):
        part = part.withColumnsRenamed({"doc_id": "_d", "mark": "_m"})
        on = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("mark") == F.col("_m"))
        all_rows = all_rows.join(part, on, "left").drop("_d", "_m")
    return all_rows


def with_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> tuple[DataFrame, str]:
    """(every document with a struct of ``n_hit, spans, item_ids``, NULL if clean; the struct's name)."""
    name, d, m = fresh(docs, "decon"), fresh(docs, "_d"), fresh(docs, "_m")
    found = stored(scan(docs, benchmark, n).filter("n_hit > 0").select(
        F.col("doc_id").alias(d), F.col("mark").alias(m), F.struct("n_hit", "spans", "item_ids").alias(name)).distinct())
    on = F.col("doc_id").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(m))
    return docs.join(small(found), on, "left").drop(d, m), name


def remove_documents(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Documents without any hit, columns unchanged."""
    marked, name = with_hits(docs, benchmark, n)
    return marked.filter(F.col(name).isNull()).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """Documents with hit words cut out, and what stands between two of them."""
    marked, name = with_hits(docs, benchmark, n)
    text = F.col("text")
    kept = F.when(F.col(name).isNull(), text).otherwise(cut_words(text, F.col(name)["spans"], WORD_ANY_CASE[:-1]))
    return marked.withColumn("text", kept).drop(name)


def report(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row per document: word and hit counts, and a digest of the items found."""
    return scan(docs, benchmark, n).select(
        "doc_id", F.col("n_words").cast("long"),
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.when(F.col("item_ids").isNull(), 0).otherwise(F.size("item_ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("item_ids", ","), F.lit("")), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )
