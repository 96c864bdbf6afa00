"""Connected components of a large edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``a, b`` edges; ``root`` is the component's smallest node.

    Alternates two steps until nothing changes: every node ties its larger
    neighbours, then its smaller ones, to its smallest neighbour. No
    neighbourhood is collected, and the number of rounds grows with the
    logarithm of the component, whatever its shape.
    """
    current = stored(_ordered(edges.select(F.col("a"), F.col("b"))).distinct())
    mark = None
    while True:
        count, checksum = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first()
        if (count, checksum) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        mark = (count, checksum)
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _ordered(
            both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        ).distinct()
        large = stored(large)
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        current = stored(_ordered(small.union(least)).distinct())


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller node, without loops."""
    return edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
