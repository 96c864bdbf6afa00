"""Index of the page keys seen so far, for batches that are small beside it.

Keys are dealt to slots by hash. A slot has a Bloom filter, sized by the number
of keys, and its own folder; inside, files are bucketed by key. A batch asks the
filters first: keys without all their bits are new, and nothing of the history
is read for them. The others are looked up in the folders of their slots alone,
by a join that reads the buckets in place: only the batch is moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bits per key and hash functions: 1 key in 100 that is new is looked up for nothing.
BITS_PER_KEY, HASHES = 10, 4
LEAST_SLOTS, KEYS_PER_SLOT, BUCKETS = 16, 500_000, 8


class KeyIndex:
    """Keys below ``path``; written once by ``build``, then only read."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.table = "shelfmark_keys_" + "".join(c if c.isalnum() else "_" for c in self.path.rsplit("/", 1)[-1])

    @staticmethod
    def _slot(slots: Column) -> Column:
        return F.pmod(F.xxhash64("key"), slots).cast("int")

    @staticmethod
    def _places(words: Column) -> Column:
        """Bit places of a key in a filter of ``words`` 64-bit numbers."""
        return F.array(*[F.pmod(F.xxhash64("key", F.lit(i)), words * 64) for i in range(HASHES)])

    def build(self, keys: DataFrame) -> None:
        """Write the distinct keys (column ``key``) and the filters; rows without key are left out."""
        distinct = keys.filter(F.col("key").isNotNull()).select("key").distinct()
        count = distinct.count()
        slots = max(LEAST_SLOTS, math.ceil(count / KEYS_PER_SLOT))
        words = max(1, math.ceil(count * BITS_PER_KEY / slots / 64))
        dealt = distinct.withColumn("slot", self._slot(F.lit(slots)))
        (dealt.repartition(BUCKETS, "key").write.format("parquet").partitionBy("slot").bucketBy(BUCKETS, "key").sortBy("key")
         .option("path", f"{self.path}/keys").saveAsTable(self.table))
        # Only the files are kept; a reader describes the table for itself.
        self.spark.sql(f"DROP TABLE {self.table}")
        stored = self._history().select("key", "slot")
        places = stored.select("slot", F.explode(self._places(F.lit(words))).alias("place"))
        bits = places.groupBy("slot", F.shiftright("place", 6).alias("at")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits"))
        every = self.spark.range(slots * words).select(
            F.expr(f"cast(id div {words} AS int)").alias("slot"), F.pmod("id", F.lit(words)).alias("at"), F.lit(0).cast("long").alias("bits"))
        dense = bits.unionByName(every).groupBy("slot", "at").agg(F.bit_or("bits").alias("bits"))
        filters = dense.groupBy("slot").agg(F.sort_array(F.collect_list(F.struct("at", "bits")))["bits"].alias("bits"))
        filters.withColumns({"slots": F.lit(slots), "words": F.lit(words)}).write.parquet(f"{self.path}/filters")

    def _history(self) -> DataFrame:
        """The keys as a bucketed table; the session's catalogue is told where they lie."""
        if not self.spark.catalog.tableExists(self.table):
            self.spark.sql(
                f"CREATE TABLE {self.table} (key STRING, slot INT) USING parquet PARTITIONED BY (slot) "
                f"CLUSTERED BY (key) SORTED BY (key) INTO {BUCKETS} BUCKETS LOCATION '{self.path}/keys'")
            self.spark.catalog.recoverPartitions(self.table)
        return self.spark.table(self.table)

    def candidates(self, keys: DataFrame) -> DataFrame:
        """``key, slot`` of the distinct keys that the filters do not rule out."""
        filters = self.spark.read.parquet(f"{self.path}/filters")
        sizes = filters.select("slots", "words").first()
        if sizes is None:
            return keys.select("key", F.lit(0).alias("slot")).limit(0)
        asked = keys.filter(F.col("key").isNotNull()).select("key").distinct().withColumn("slot", self._slot(F.lit(sizes["slots"])))
        found = asked.join(filters.select("slot", "bits"), "slot")
        hit = F.lit(True)
        for i in range(HASHES):
            place = F.pmod(F.xxhash64("key", F.lit(i)), F.lit(sizes["words"]) * 64)
            hit = hit & (F.getbit(F.get("bits", F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1)
        return found.filter(hit).select("key", "slot")

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The distinct ``keys`` that the index does not hold."""
        return keys.select("key").distinct().join(self.seen(keys), "key", "left_anti")

    def seen(self, keys: DataFrame) -> DataFrame:
        """Those of ``keys`` that the index holds. Slots are collected, at most their number."""
        maybe = self.candidates(keys)
        slots = sorted(r[0] for r in maybe.select("slot").distinct().collect())
        history = self._history().filter(F.col("slot").isin(slots)).select("key")
        return maybe.select("key").join(history, "key", "left_semi")
