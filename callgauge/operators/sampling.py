"""Seeded samples of task sets: the first of each stratum by a hash, so they don't depend on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_rank(key: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), key)


def stratified_sample(rows: DataFrame, stratum: str, key: str, n: int = 5, seed: int = 42, order: Column | None = None) -> DataFrame:
    """``n`` rows of each stratum with their rank (from 0); ``order`` replaces the seeded hash."""
    by = Window.partitionBy(stratum).orderBy(seeded_rank(F.col(key), seed) if order is None else order, key)
    first = rows.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)  # a top-k of each group before the shuffle
    return first.withColumn("rank", F.col("rank") - 1)


def refusal_split(rows: DataFrame, key: str, n_safe: int = 5, n_unsafe: int = 1, seed: int = 42, order: Column | None = None) -> DataFrame:
    """Prompts to answer and to refuse, by the prefix of their type; task ids count within each."""
    unsafe = F.coalesce(F.startswith("type", F.lit("contrast_")), F.lit(False))
    ranked = stratified_sample(rows.withColumn("should_refuse", unsafe), "should_refuse", key, max(n_safe, n_unsafe), seed, order)
    kept = ranked.filter(F.when(F.col("should_refuse"), F.col("rank") < n_unsafe).otherwise(F.col("rank") < n_safe))
    name = F.concat(F.when(F.col("should_refuse"), "xstest_unsafe_").otherwise("xstest_safe_"), F.col("rank").cast("string"))
    return kept.withColumn("task_id", name).drop("rank")
