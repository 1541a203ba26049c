"""Exact percentiles of groups of any size, by selection: no task holds a group, and the driver only counts.

A first pass takes each group's number of values, least and largest one. Each wanted rank then has a range of values that holds it. A round counts the values
of the range in ``BINS`` bins of equal width, partial counts before the shuffle, and takes the bin that holds the rank, from its least to its largest
value, as the next range. A range of one value is the answer. Two to four rounds are common; as each one parts the least value from the largest, they end.
Groups and ranges are settled, so the plan of a round doesn't hold those of the rounds before it.
Where every group is counted and found small, a single aggregation gives the same.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settling import discard, settled

#: Bins of a range; ranges that are broadcast at most, and the tasks over which a group is dealt where there are more.
BINS, BROADCAST_RANGES, SALTS = 1024, 200_000, 32
#: If no group has more values than these, one aggregation holds each of them.
FEW = 100_000


def _same(a: str, b: str, columns: list[str]) -> Column:
    return F.expr(" AND ".join(["true", *(f"{a}.{c} <=> {b}.{c}" for c in columns)]))


def _within(values: DataFrame, ranges: DataFrame, key: list[str], n_ranges: int) -> DataFrame:
    """``values`` that lie in a range of their group, with it."""
    inside = F.col("v._v").between(F.col("r._lo"), F.col("r._hi"))
    if n_ranges <= BROADCAST_RANGES:
        met = values.alias("v").join(F.broadcast(ranges.alias("r")), _same("v", "r", key) & inside)
    else:  # a group with very many values goes to several tasks
        salted = values.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(SALTS)).cast("int"))
        spread = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = salted.alias("v").join(spread.alias("r"), _same("v", "r", [*key, "_salt"]) & inside)
    return met.select(*(F.col(f"v.{c}") for c in key), "r._lo", "r._hi", "v._v", "v._n")


def percentiles(rows: DataFrame, by: list[str], value: str, at: tuple[float, ...] = (0.5, 0.95), weight: str | None = None, bins: int = BINS) -> DataFrame:
    """The columns ``by``, n (values present) and percentiles (array in the order of ``at``, interpolated) of every group of ``rows``.

    weight: how many times a row's value counts (1); rows with a null value or without a positive weight don't. A group without values gets n 0 and null. ``rows`` is read
    once for each round, so it should be a table or a cheap projection of one.
    """
    key = [f"_k{i}" for i in range(len(by))]
    every = rows.select(*(F.col(c).alias(k) for c, k in zip(by, key)), F.col(value).cast("double").alias("_v"), (F.col(weight).cast("bigint") if weight else F.lit(1).cast("bigint")).alias("_n"))
    counts = (F.col("_v").isNotNull()) & (F.col("_n") > 0)
    values = every.filter(counts)
    sums = every.groupBy(*key).agg(F.coalesce(F.sum(F.when(counts, F.col("_n"))), F.lit(0)).alias("_total"), F.min(F.when(counts, F.col("_v"))).alias("_lo"), F.max(F.when(counts, F.col("_v"))).alias("_hi")).persist(StorageLevel.MEMORY_AND_DISK)
    named = [F.col(k).alias(c) for k, c in zip(key, by)]
    if (sums.agg(F.max("_total")).first()[0] or 0) <= FEW:
        sums.unpersist()
        held = every.groupBy(*key).agg(F.coalesce(F.sum(F.when(counts, F.col("_n"))), F.lit(0)).alias("n"), F.percentile(F.when(counts, F.col("_v")), F.array(*map(F.lit, map(float, at))), F.when(counts, F.col("_n")).otherwise(0)).alias("percentiles"))
        return held.select(*named, "n", "percentiles")
    held, sums = sums, settled(sums)
    held.unpersist()
    place = lambda p: F.lit(float(p)) * (F.col("_total") - 1)
    ranks = F.array_distinct(F.array(*(f(place(p)).cast("bigint") for p in at for f in (F.floor, F.ceil))))
    wanted = settled(sums.filter("_total > 0").select(*key, F.explode(ranks).alias("_rank"), F.lit(0).cast("bigint").alias("_before"), "_lo", "_hi"))
    while n_ranges := wanted.filter("_lo < _hi").count():
        open_ = wanted.filter("_lo < _hi").select(*key, "_lo", "_hi").distinct()
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)  # halves, as the width may pass the largest number
        bin_ = F.when(F.col("_v") == F.col("_hi"), bins - 1).otherwise(F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 2))).cast("int")
        counted = _within(values, open_, key, n_ranges).groupBy(*key, "_lo", "_hi", bin_.alias("_bin")).agg(F.sum("_n").alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        upto = Window.partitionBy(*key, "_lo", "_hi").orderBy("_bin")
        placed = counted.withColumn("_upto", F.sum("_in").over(upto))
        holds = (F.col("w._rank") >= F.col("w._before") + F.col("b._upto") - F.col("b._in")) & (F.col("w._rank") < F.col("w._before") + F.col("b._upto"))
        nearer = wanted.alias("w").join(placed.alias("b"), _same("w", "b", [*key, "_lo", "_hi"]) & holds)
        found = nearer.select(*(F.col(f"w.{c}") for c in key), "w._rank", (F.col("w._before") + F.col("b._upto") - F.col("b._in")).alias("_before"), F.col("b._least").alias("_lo"), F.col("b._most").alias("_hi"))
        last, wanted = wanted, settled(found.unionByName(wanted.filter("NOT _lo < _hi")))
        discard(last)
    at_rank = wanted.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_lo"))).alias("_at"))  # two ranks for each percentile

    def interpolated(p: float) -> Column:
        low, high = F.col("_at")[F.floor(place(p)).cast("bigint")], F.col("_at")[F.ceil(place(p)).cast("bigint")]
        part = place(p) - F.floor(place(p))
        return F.when(low == high, low).otherwise(low * (1 - part) + high * part)

    met = sums.alias("s").join(at_rank.alias("a"), _same("s", "a", key), "left").select(*(F.col(f"s.{c}") for c in key), "_total", "_at")
    out = met.select(*named, F.col("_total").alias("n"), F.when(F.col("_at").isNotNull(), F.array(*(interpolated(p) for p in at))).alias("percentiles"))
    out._reads = (sums, wanted)
    return out
