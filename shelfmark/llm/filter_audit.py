"""Filter interaction audit by recursive enumeration of filter orders.

Every document is tested by five filters at once, which gives a mask of the
filters it fails. Documents with the same part and mask are one cell, counted
once; from then on work depends on the number of parts only. A recursive CTE
starts at the empty prefix of each part, extends each prefix by every letter
not applied yet, joins the part's mask cells and carries the bits applied so
far; each level emits the metrics of that step. A prefix is worked out once and
serves all orders that begin with it: 325 prefixes instead of 600 steps.

Filters: A short, B repetitive words, C capitals, D symbols, E a text that a
smaller ``doc_id`` has as well. Texts are compared by their SHA-256. The first
holder of each text comes from a grouping, which combines copies before they
are moved, and is joined back by ``doc_id`` and digest, so copies of one text
are spread over tasks.

Edge cases. NULL text counts as empty: it fails A, and E unless it is the first
empty text. NULL source is the part ''. A row without ``doc_id`` has no smaller
one, so it never fails E, is no other row's first holder and has no labels.
Rows that repeat with one ``doc_id`` count once each and do not make each other
fail E. Several labels of one ``doc_id``: it is good or toxic if any of them
says so. An empty table of documents gives no rows, an empty table of labels
zeros. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from shelfmark.llm.common import setting, stored

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
_BITS = {letter: 1 << i for i, letter in enumerate(LETTERS)}
# Keys that spread rows without doc_id over tasks; they find no partner.
_SPREAD = 1_000_003

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 50, 65, 5


def failed_filters(text: Column) -> Column:
    """Bits of the filters A to D that a text fails."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    fails = {
        "A": n < MIN_WORDS,
        "B": 100 * distinct < MIN_DISTINCT_PERCENT * n,
        "C": 100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.char_length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    mask = F.lit(0)
    for letter, fail in fails.items():
        mask = mask.bitwiseOR(F.when(fail, _BITS[letter]).otherwise(0))
    return mask


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each part by the filters they fail."""
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    rows = docs.select(
        "doc_id", F.coalesce("source", F.lit("")).alias("part"), digest.alias("digest"),
        failed_filters(text).alias("mask"))
    # Small rows are read several times; texts are read once.
    rows = stored(rows)
    firsts = rows.groupBy("digest").agg(F.min("doc_id").alias("first_id")).select(F.col("digest").alias("_digest"), "first_id")
    marks = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    spread = F.when(rows["doc_id"].isNull(), F.pmod(F.xxhash64("digest", F.spark_partition_id()), F.lit(_SPREAD)) + 1).otherwise(0)
    keyed = rows.withColumn("spread", spread).withColumn("_key", F.coalesce("doc_id", -F.col("spread")))
    keyed = keyed.join(firsts, (F.col("digest") == F.col("_digest")) & (F.col("_key") == F.col("first_id"))
                       & (F.col("spread") == 0), "left")
    copied = F.col("first_id").isNull() & F.col("doc_id").isNotNull()
    mask = F.col("mask").bitwiseOR(F.when(copied, _BITS["E"]).otherwise(0))
    keyed = keyed.withColumn("mask", mask)
    marks = marks.withColumn("_none", F.lit(0).cast("long"))
    joined = keyed.join(marks, (F.col("_key") == F.col("_id")) & (F.col("spread") == F.col("_none")), "left")
    return joined.groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


# One level of the recursion: cells of the part, split by the filters applied before and by the new one.
_STEPS = """
WITH RECURSIVE step (part, prefix, applied, kept, removed, redundant, unique_fails, good_lost, toxic_lost) AS (
  SELECT part, '', 0, 0L, 0L, 0L, 0L, 0L, 0L FROM {cells}
  UNION ALL
  SELECT part, concat(prefix, f.letter), applied | f.bit,
    aggregate(cells, 0L, (s, c) -> s + if((c.mask & (applied | f.bit)) = 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if((c.mask & f.bit) <> 0 AND (c.mask & applied) = 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if((c.mask & f.bit) <> 0 AND (c.mask & applied) <> 0, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if(c.mask = f.bit, c.n, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if((c.mask & f.bit) <> 0 AND (c.mask & applied) = 0, c.good, 0L)),
    aggregate(cells, 0L, (s, c) -> s + if((c.mask & f.bit) <> 0 AND (c.mask & applied) = 0, c.toxic, 0L))
  FROM (
    SELECT step.part, step.prefix, step.applied, c.cells,
      explode(filter(array(FILTERS), f -> (step.applied & f.bit) = 0)) AS f
    FROM step JOIN {cells} c ON c.part = step.part)
)
SELECT * FROM step WHERE applied > 0
"""


def steps(counted: DataFrame) -> DataFrame:
    """One row per part and filter prefix, with the metrics of the prefix's last step.

    ``counted`` is the result of ``cells``. A part has at most 32 cells, which
    are packed in one row. The number of rows is the parts' times 325, so
    Spark's limit on rows of a recursion is lifted while it runs.
    """
    packed = stored(counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells")))
    filters = ", ".join(f"named_struct('letter', '{letter}', 'bit', {bit})" for letter, bit in _BITS.items())
    spark = counted.sparkSession
    with setting(spark, "spark.sql.cteRecursionRowLimit", "-1"):
        return stored(spark.sql(_STEPS.replace("FILTERS", filters), cells=packed))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Metrics of every step of every filter order, for every part."""
    found = steps(cells(docs, labels))
    # A prefix of k letters begins (5 - k)! orders.
    orders = F.lit(0)
    for k in range(1, len(LETTERS) + 1):
        orders = F.when(F.length("prefix") == k, factorial(len(LETTERS) - k)).otherwise(orders)
    letter = F.right("prefix", F.lit(1))
    shapley = F.sum(F.col("removed") * orders).over(W.partitionBy("part", letter))
    begun = F.filter(F.array(*[F.lit(o) for o in ORDERS]), lambda o: o.startswith(F.col("prefix")))
    return found.withColumn("shapley", shapley).select(
        "part", F.explode(begun).alias("filter_order"), F.length("prefix").alias("step"), "kept", "removed", "redundant",
        "unique_fails", "good_lost", "toxic_lost", "shapley")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters, 600 rows for each part."""
    return audit(docs, labels)
