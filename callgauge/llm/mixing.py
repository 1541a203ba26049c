"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate: its target share of the output's code points over its
share of the input's. A document's number of copies is the inverse of the Poisson distribution
function with that mean at a uniform number hashed from the seed and doc_id, so it is the same
in every run and independent of partitions. Copies are then shuffled globally by a hash.

The distribution function is stated from 14 deviations below the mean to 14 above, so its length grows with the root of
the rate; its terms are closed forms, summed up once for each source.

Behaviour: rows of equal doc_id get equal counts for equal rates; a null doc_id is hashed by
its text; a null source is a source of its own; a null text has no code points; a source without a
target, or with the target zero, gets no copies, unless no targets are given, which means equal ones for
all sources; a source with only empty texts has the rate 1; an empty table gives an empty result; other columns pass
through, whatever their names, and those named like an added column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_join, settled

#: Distributions of up to so many steps in all are broadcast; more are joined by source, with large sources dealt over several tasks.
BROADCAST_STEPS = 1_000_000
#: Deviations from the mean, and steps besides, that a distribution covers on either side.
SPREAD, BESIDES = 14, 30


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(2**52))


def source_rates(docs: DataFrame, targets: dict[str | None, float] | None = None, total_chars: float | None = None) -> DataFrame:
    """(source, n_docs, rate): the documents of a source and the mean number of copies of each, settled.

    targets: weights by source, in any unit; total_chars: code points wanted in all (the input's).
    """
    sizes = settled(docs.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("chars")))
    if targets is None:
        weighted = sizes.withColumn("weight", F.lit(1.0))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in targets.items()], "name string, weight double")
        weighted = sizes.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "n_docs", "chars", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sums = weighted.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    total = total_chars if total_chars is not None else sums.chars or 0.0
    rate = F.when(F.col("chars") > 0, F.col("weight") * F.lit(total) / (F.lit(sums.weight or 1.0) * F.col("chars"))).otherwise(F.lit(1.0))
    return settled(weighted.select("source", "n_docs", rate.alias("rate")))


def log_factorial(k: Column) -> Column:
    """ln k!, from the factorial up to 20 and from Stirling's series beyond."""
    x = F.greatest(k, F.lit(1)).cast("double")
    series = (x + 0.5) * F.ln(x) - x + 0.918938533204672742 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0))) - 1 / (1680 * F.pow(x, F.lit(7.0)))
    return F.when(k <= 20, F.ln(F.factorial(F.least(k, F.lit(20)).cast("int")).cast("double"))).otherwise(series)


def _steps(rate: Column) -> tuple[Column, Column]:
    """The first and last number of copies that the distribution states."""
    wide = SPREAD * F.sqrt(rate) + BESIDES
    return F.greatest(F.lit(0), F.floor(rate - wide)).cast("bigint"), F.ceil(rate + wide).cast("bigint")


def poisson_distributions(rates: DataFrame) -> DataFrame:
    """(source, n_docs, low, cdf): the distribution function at low, low + 1, ... of each source with a rate above 0."""
    low, high = _steps(F.col("rate"))
    terms = rates.filter("rate > 0").select("source", "n_docs", "rate", low.alias("low"), F.explode(F.sequence(low, high)).alias("k"))
    p = F.exp(-F.col("rate") + F.col("k") * F.ln("rate") - log_factorial(F.col("k")))
    summed = terms.withColumn("c", F.sum(p).over(Window.partitionBy("source").orderBy("k")))
    return summed.groupBy("source", "n_docs", "low").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s.c).alias("cdf"))


def replicate(docs: DataFrame, targets: dict[str | None, float] | None = None, seed: int = 17, total_chars: float | None = None) -> DataFrame:
    """All columns of ``docs`` and n_copies, copy (from 0) and shuffle_key, a row for each copy, globally shuffled."""
    added = ("n_copies", "copy", "shuffle_key")
    of_source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("none"))  # null is a source too
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))
    rows = docs.select(F.struct(*(c for c in docs.columns if c.lower() not in added)).alias("row"), of_source.alias("of"), key.alias("key"))
    rates = source_rates(docs, targets, total_chars)
    low, high = _steps(F.col("rate"))
    sums = rates.agg(F.sum(high - low + 1).alias("steps"), F.sum("n_docs").alias("docs")).first()
    distributions = poisson_distributions(rates).select(of_source.alias("of"), "n_docs", "low", "cdf")
    if (sums.steps or 0) <= BROADCAST_STEPS:
        met = rows.join(F.broadcast(distributions), "of")
    else:
        met = hot_join(rows, settled(distributions), ["of"], "n_docs", sums.docs, by=["key"])
    drawn = met.select("row", "key", "low", "cdf", uniform(seed, F.col("key")).alias("u"))
    counted = drawn.select("row", "key", (F.col("low") + F.size(F.filter("cdf", lambda c: c <= F.col("u")))).alias("n_copies")).filter("n_copies > 0")
    copies = counted.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_copies") - 1)))
    placed = copies.withColumn("shuffle_key", F.md5(F.concat(F.lit(f"{seed}/"), "key", F.lit("/"), F.col("copy").cast("string")).cast("binary")))
    return placed.select("row.*", *added).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
