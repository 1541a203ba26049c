"""Which keys a store has already, over all of its days: a Parquet index dealt by hash, with Bloom filters that tell which parts need reading.

A part is the keys of one bucket (a prefix of their hash) that came on one day. Its filter is a row of bits, kept as bitmaps of 32,768 bits in Spark's own bitmap
aggregates, so filters of batches merge by a bitwise or. A lookup reads the bitmaps that its keys fall into, and then only the parts which those can't exclude; the
exact join to them decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets, bitmaps of a part's filter and bits that each key sets in one of them. The defaults suit two million keys a day; with many more, filters exclude less and results stay right.
BUCKETS, SLOTS, PROBES = 4, 128, 7
BITMAP = 32768
KEYS = "key string, batch_id string, bucket int, part date"
FILTERS = "slot int, bits binary, bucket int, part date"


def _bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _positions(key: Column) -> Column:
    """The key's bits in its bitmap."""
    return F.array(*(F.pmod(F.xxhash64(key, F.lit(i + 1)), F.lit(BITMAP)) for i in range(PROBES)))


class KeyIndex:
    """One writer at a time. ``path`` gets two tables, keys and filters, partitioned by bucket and day of writing."""

    def __init__(self, spark: SparkSession, path: str, slots: int = SLOTS) -> None:
        self.spark, self.path, self.slots = spark, path, slots
        for name, schema in (("keys", KEYS), ("filters", FILTERS)):
            spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket", "part").parquet(f"{path}/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def parts_that_may_have(self, keys: DataFrame) -> list[tuple[int, object]]:
        """(bucket, part) of the parts whose filters don't exclude every one of ``keys`` (key); at most buckets times days."""
        probes = keys.select(_bucket(F.col("key")).alias("bucket"), self._slot().alias("slot"), _positions(F.col("key")).alias("at"))
        octet = lambda p: F.conv(F.hex(F.substring(F.col("bits"), (p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        set_ = lambda p: F.call_function("shiftright", octet(p), (p % 8).cast("int")).bitwiseAND(1) == 1
        met = probes.join(self._table("filters", FILTERS), ["bucket", "slot"]).filter(F.forall("at", set_))
        return [(r.bucket, r.part) for r in met.select("bucket", "part").distinct().collect()]

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(0)), F.lit(self.slots)).cast("int")

    def known(self, keys: DataFrame, batch_id: str) -> DataFrame:
        """Those of ``keys`` (key, distinct) that another batch has put into the index."""
        by_part: dict[object, list[int]] = {}
        for bucket, part in self.parts_that_may_have(keys):
            by_part.setdefault(part, []).append(bucket)
        where = F.lit(False)
        for part, buckets in by_part.items():
            where = where | ((F.col("part") == F.lit(part)) & F.col("bucket").isin(buckets))
        stored = self._table("keys", KEYS).filter(where).filter(F.col("batch_id") != batch_id)
        # a table's bytes don't tell how many keys they hold, so neither side is to be broadcast
        return keys.withColumn("bucket", _bucket(F.col("key"))).join(stored.select("key", "bucket").hint("merge"), ["bucket", "key"], "left_semi").select("key")

    def has_batch(self, batch_id: str) -> bool:
        """Whether the index has keys of the batch; a file holds those of one batch, so others are left out by their footers."""
        return not self._table("keys", KEYS).filter(F.col("batch_id") == batch_id).select("bucket").isEmpty()

    def add(self, keys: DataFrame, batch_id: str, part: str | None = None) -> None:
        """Adds ``keys`` (key) of a batch; adding them again changes nothing that a lookup sees. Filters go first, so that no stored key is without one."""
        day = F.lit(part).cast("date") if part else F.current_date()
        named = keys.select("key", F.lit(batch_id).alias("batch_id"), _bucket(F.col("key")).alias("bucket"), day.alias("part"))
        probed = named.select("bucket", "part", self._slot().alias("slot"), F.explode(_positions(F.col("key"))).alias("position"))
        bitmaps = probed.groupBy("bucket", "part", "slot").agg(F.bitmap_construct_agg("position").alias("bits"))
        bitmaps.hint("rebalance", "bucket").write.mode("append").partitionBy("bucket", "part").parquet(f"{self.path}/filters")
        named.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key").write.mode("append").partitionBy("bucket", "part").parquet(f"{self.path}/keys")

    def merge_filters(self) -> None:
        """One bitmap for each slot of a part, in the place of those of its batches."""
        filters = self._table("filters", FILTERS)
        merged = filters.groupBy("bucket", "part", "slot").agg(F.bitmap_or_agg("bits").alias("bits")).select("slot", "bits", "bucket", "part").persist()
        merged.count()  # read in full before its files are replaced
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "part").parquet(f"{self.path}/filters")
        merged.unpersist()
