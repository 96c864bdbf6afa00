"""Mixing sources to target weights by Pfair scheduling.

The documents of a source form blocks of ``block_rows``. A source of weight w
out of W asks for a share w / W of the slots: its j-th block (from 0) is
released at slot floor(j * W / w) and due by ceil((j + 1) * W / w). Every slot
goes to the released block that is due first (ties: the source of larger
weight, then by name). All blocks meet their dates, so after any number of slots a
source is less than one block away from its share.

With whole-number weights the schedule repeats after W slots, where every
source is at its share exactly, so it is worked out for one period and laid out
again and again. A source that runs out leaves: in the period in which it does,
its share is what it has left, and afterwards the others share its slots in
their proportion. That gives at most two kinds of period for each source. The
schedule's size depends on the weights alone. Sources that are not named are
streams of their own with the weight ``each``, so the bound holds for them too
and the period grows with their number; or, where there are very many, one pool
with ``pool_weight`` (``each=None``), inside which rows keep the digest's order.
No row is left out and none is repeated.

Within a source rows are in the order of the MD5 digest of ``doc_id``, which
mixes them and deals them evenly to numbering ranges: a source with a third of
all rows is numbered by many tasks. Rows of one source with the same id follow
each other, in any order.

Edge cases. NULL sources are the source '' (with any empty ones). Rows without
id, rows that repeat and empty texts take places like all others. An empty table gives an empty
result; an empty weight table gives all sources the same weight. Weights are at least 1. The added
columns are ``mix_source, mix_slot, mix_position``, under other names (``_1``,
...) where the table has them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from shelfmark.functions.base import let
from shelfmark.llm.common import fresh, small, stored

BLOCK_ROWS, POOL, POOL_WEIGHT, EACH = 32, "(other)", 1, 1
# Rows that one numbering range should have.
_RANGE_ROWS = 1_000


def _first_due(had: Column, quotas: Column, length: Column, t: Column) -> Column:
    """Place of the source that gets slot ``t``: of the released blocks the one due first."""
    dates = F.transform(quotas, lambda q, i: F.struct(
        F.when(
            (had[i] < q["quota"]) & (F.floor(had[i] * length / q["quota"]) <= t),
            F.ceil((had[i] + 1) * length / q["quota"]),
        ).alias("due"),
        i.alias("place"),
    ))
    return F.array_min(F.filter(dates, lambda x: x["due"].isNotNull()))["place"]


def schedule(periods: DataFrame) -> DataFrame:
    """Slots of each kind of period: ``kind, name, j, offset``; ``j`` counts the source's blocks.

    ``periods`` has ``kind, length`` and ``quotas``, structs of ``quota, name``
    in order of precedence. A fold over the slots keeps the blocks each source
    has had.
    """

    def slot(state: Column, t: Column) -> Column:
        chosen = _first_due(state["had"], F.col("quotas"), F.col("length"), t)
        return let(chosen, lambda c: F.struct(
            F.transform(state["had"], lambda n, i: F.when(i == c, n + 1).otherwise(n)).alias("had"),
            F.concat(state["order"], F.array(c)).alias("order"),
        ))

    start = F.struct(
        F.transform("quotas", lambda _: F.lit(0).cast("long")).alias("had"), F.array().cast("array<int>").alias("order"))
    slots = F.sequence(F.lit(0).cast("long"), F.col("length") - 1)
    ordered = periods.withColumn("order", F.aggregate(slots, start, slot)["order"])
    return (
        ordered.select("kind", "quotas", F.posexplode("order").alias("offset", "place"))
        .select("kind", F.col("quotas")[F.col("place")]["name"].alias("name"), "offset")
        .withColumn("j", F.row_number().over(W.partitionBy("kind", "name").orderBy("offset")) - 1)
    )


def period_kinds(counts: DataFrame) -> DataFrame:
    """``kind, times, length, quotas``: runs of equal periods, from ``name, weight, blocks``.

    A source with B blocks and weight w fills its share in the periods before
    B div w and has B mod w blocks for that one. ``kind`` is the first period.
    """
    every = F.collect_list(F.struct(
        "name", "weight", F.expr("blocks div weight").alias("full"),
        (F.col("blocks") % F.col("weight")).alias("rest")))
    changes = F.array_sort(F.array_distinct(F.flatten(F.transform(
        "every", lambda s: F.array(F.lit(0).cast("long"), s["full"], s["full"] + 1)))))
    runs = (
        counts.agg(every.alias("every")).withColumn("changes", changes)
        .select("every", "changes", F.posexplode("changes").alias("i", "kind"))
        .filter(F.col("i") + 1 < F.size("changes"))
        .withColumn("times", F.col("changes")[F.col("i") + 1] - F.col("kind"))
    )

    def quota(s: Column) -> Column:
        share = F.when(F.col("kind") < s["full"], s["weight"]).when(F.col("kind") == s["full"], s["rest"]).otherwise(0)
        return F.struct((-share.cast("long")).alias("minus"), s["name"].alias("name"))

    ranked = F.sort_array(F.filter(F.transform("every", quota), lambda q: q["minus"] < 0))
    quotas = F.transform(ranked, lambda q: F.struct((-q["minus"]).alias("quota"), q["name"].alias("name")))
    length = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q["quota"])
    return runs.select("kind", "times", quotas.alias("quotas")).withColumn("length", length).filter("length > 0")


def _numbered(docs: DataFrame, pool: Column, columns: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(documents with pool and ``row`` number in it, ``name, rows`` of the pools).

    Numbers are counted within ranges of the digest; ranges are as many as the
    rows ask for, and the rows of the ranges before are added.
    """
    name, span, row = columns["mix_source"], columns["range"], columns["row"]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    digits = max(0, math.ceil(math.log(max(docs.count() / _RANGE_ROWS, 1), 16)))
    rows = docs.withColumn(name, pool).withColumn(span, F.substring(digest, 1, digits))
    ranges = stored(
        rows.groupBy(F.col(name).alias("of"), F.col(span).alias("range")).agg(F.count(F.lit(1)).alias("rows")))
    earlier = W.partitionBy("of").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = ranges.select("of", "range", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    before = before.toDF(*[columns[c] for c in ("of", "from", "before")])
    inside = F.row_number().over(W.partitionBy(name, span).orderBy(digest, "doc_id")) - 1
    rows = rows.withColumn(row, inside).join(
        small(stored(before)), (F.col(name) == F.col(columns["of"])) & (F.col(span) == F.col(columns["from"])))
    rows = rows.withColumn(row, (F.col(row) + F.col(columns["before"])).cast("long"))
    rows = rows.drop(span, columns["of"], columns["from"], columns["before"])
    return rows, ranges.groupBy(F.col("of").alias("name")).agg(F.sum("rows").alias("rows"))


def mix(docs: DataFrame, weights: dict[str, int], source: str = "source", block_rows: int = BLOCK_ROWS,
        each: int | None = EACH, pool_weight: int = POOL_WEIGHT) -> DataFrame:
    """Documents with ``mix_source``, ``mix_slot`` (place of the block) and ``mix_position`` (of the row), from 0."""
    added = ("mix_source", "mix_slot", "mix_position")
    columns = {c: fresh(docs, c if c in added else f"_mix_{c}") for c in (*added, "range", "row", "of", "from", "before")}
    name, row = columns["mix_source"], columns["row"]
    given = F.coalesce(F.col(source).cast("string"), F.lit(""))
    if each is not None:
        pool = given
    else:
        pool = F.when(given.isin(*weights), given).otherwise(F.lit(POOL)) if weights else F.lit(POOL)
    rows, totals = _numbered(docs, pool, columns)

    target = F.lit(pool_weight if each is None else each)
    if weights:
        target = F.coalesce(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair])[F.col("name")], target)
    counts = stored(totals.withColumn("weight", target.cast("long")).withColumn("blocks", F.ceil(F.col("rows") / block_rows)))
    kinds = stored(period_kinds(counts))
    slots = stored(schedule(kinds))

    # For each run of equal periods its first slot, and the blocks each source has had before.
    by_kind = W.orderBy("kind").rowsBetween(W.unboundedPreceding, -1)
    by_name = W.partitionBy("name").orderBy("kind").rowsBetween(W.unboundedPreceding, -1)
    runs = (
        kinds.withColumn("start", F.coalesce(F.sum(F.col("length") * F.col("times")).over(by_kind), F.lit(0)))
        .select("kind", "times", "length", "start", F.explode("quotas").alias("q"))
        .select("kind", "times", "length", "start", F.col("q.name").alias("name"), F.col("q.quota").alias("quota"))
        .withColumn("had", F.coalesce(F.sum(F.col("quota") * F.col("times")).over(by_name), F.lit(0)))
    )
    # One row per run, source and block of a period: its size depends on the weights alone.
    plan = stored(runs.join(slots, ["kind", "name"]).select(
        F.col("name").alias("_name"), "j", "quota", "length", "had",
        (F.col("had") + F.col("quota") * F.col("times")).alias("end"), (F.col("start") + F.col("offset")).alias("first")))

    def placed(frame: DataFrame, of: str, block: Column, out: str) -> DataFrame:
        on = (F.col(of) == F.col("_name")) & (block >= F.col("had")) & (block < F.col("end")) & (
            (block - F.col("had")) % F.col("quota") == F.col("j"))
        slot = F.col("first") + F.floor((block - F.col("had")) / F.col("quota")) * F.col("length")
        kept = [F.col(f"`{c}`") for c in frame.columns]
        return frame.join(small(plan), on).select(*kept, slot.cast("long").alias(out))

    # The last block of a source may be short: rows after it move up. At most one row per source.
    last = placed(counts.withColumn("last", F.col("blocks") - 1), "name", F.col("last"), "slot")
    short = last.select("slot", (F.col("blocks") * block_rows - F.col("rows")).alias("missing")).filter("missing > 0").collect()
    slot = columns["mix_slot"]
    rows = placed(rows, name, F.floor(F.col(row) / block_rows), slot)
    position = F.col(slot) * block_rows + F.col(row) % block_rows
    if short:
        gaps = F.array(*[F.struct(F.lit(s["slot"]).alias("slot"), F.lit(s["missing"]).alias("missing")) for s in short])
        position = position - F.aggregate(
            gaps, F.lit(0).cast("long"), lambda n, s: n + F.when(F.col(slot) > s["slot"], s["missing"]).otherwise(0))
    return rows.withColumn(columns["mix_position"], position.cast("long")).drop(row)


def report(docs: DataFrame, weights: dict[str, int]) -> DataFrame:
    """Place of every document, without its text."""
    return mix(docs, weights).select("doc_id", "mix_source", "mix_slot", "mix_position")
