"""Rates and the metric series: one aggregation over the call log, partial before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json_checks import is_strict_json

RUN = ("eval_run_id", "provider", "model_id")


def rate_of(task_type: str, wanted: Column | None = None) -> Column:
    """Mean score of the calls of a type, nulls aside; null if there are none."""
    of_type = F.col("eval_task_type") == task_type
    return F.avg(F.when(of_type & wanted if wanted is not None else of_type, F.col("eval_score")))


def subset_filter(subset: str) -> Column:
    """safe, unsafe or all refusal tasks; a task of unknown kind counts in all only."""
    if subset == "all":
        return F.lit(True)
    if subset not in ("safe", "unsafe"):
        raise ValueError(f"subset must be safe, unsafe or all, not {subset!r}")
    return F.col("should_refuse").eqNullSafe(F.lit(subset == "unsafe"))


def with_task_flags(calls: DataFrame, refusal_tasks: DataFrame) -> DataFrame:
    """Calls and should_refuse of their task (null if unknown); of repeated task ids the one stated last counts, in order of files, partitions and rows."""
    stated = refusal_tasks.select("task_id", "should_refuse", F.monotonically_increasing_id().alias("_place"))
    flags = stated.groupBy("task_id").agg(F.max_by("should_refuse", "_place").alias("should_refuse"))
    return calls.join(flags.withColumnRenamed("task_id", "eval_task_id"), "eval_task_id", "left")


def strict_rate() -> Column:
    """Share of the ok format calls whose whole text is one JSON value."""
    return F.avg(F.when((F.col("eval_task_type") == "format") & (F.col("outcome") == "ok"), is_strict_json(F.col("response_text")).cast("double")))


def latency_percentiles(ok_only: bool = False) -> Column:
    """Exact 50th and 95th percentiles of the latencies present, interpolated; of ok calls if ``ok_only``."""
    value = F.when(F.col("outcome") == "ok", F.col("latency_ms")) if ok_only else F.col("latency_ms")
    return F.percentile(value, F.array(F.lit(0.5), F.lit(0.95)))


def metric_points(calls: DataFrame, refusal_tasks: DataFrame, latency_ok_only: bool = False, runs: DataFrame | None = None) -> DataFrame:
    """A row for each run, provider and model, in one aggregation.

    runs: the runs to report; those without calls get nulls and n_calls 0.
    """
    flagged = with_task_flags(calls.filter("eval_run_id IS NOT NULL"), refusal_tasks)
    points = flagged.groupBy(*RUN).agg(
        F.max("timestamp").alias("timestamp"),
        rate_of("accuracy").alias("accuracy"),
        rate_of("format").alias("format_adherence"),
        rate_of("refusal", subset_filter("safe")).alias("refusal_rate"),
        latency_percentiles(latency_ok_only).alias("_p"),
        F.count("*").cast("int").alias("n_calls"),
    )
    points = points.withColumns({"latency_p50_ms": F.get("_p", F.lit(0)), "latency_p95_ms": F.get("_p", F.lit(1))}).drop("_p")
    if runs is not None:
        points = runs.select(*RUN).join(points, list(RUN), "left").fillna(0, ["n_calls"])
    return points.withColumnRenamed("eval_run_id", "run_id")


def run_states(calls: DataFrame, refusal_tasks: DataFrame) -> DataFrame:
    """Sums and counts of the calls of each run, provider and model: what of a batch its runs' points need, and adds up with other batches'."""
    flagged = with_task_flags(calls.filter("eval_run_id IS NOT NULL"), refusal_tasks)
    sums = []
    for name, wanted in (("accuracy", F.lit(True)), ("format", F.lit(True)), ("refusal", subset_filter("safe"))):
        score = F.when((F.col("eval_task_type") == name) & wanted, F.col("eval_score"))
        sums += [F.coalesce(F.sum(score), F.lit(0.0)).alias(f"{name}_sum"), F.count(score).alias(f"{name}_n")]
    found = flagged.groupBy(*RUN).agg(F.max("timestamp").alias("last_at"), *sums, F.count("*").alias("n_calls"))
    return found.withColumnRenamed("eval_run_id", "run_id")


def run_latencies(calls: DataFrame, ok_only: bool = False) -> DataFrame:
    """How often each latency came in each run, provider and model."""
    timed = calls.filter("eval_run_id IS NOT NULL AND latency_ms IS NOT NULL")
    timed = timed.filter("outcome = 'ok'") if ok_only else timed
    return timed.groupBy(*RUN, "latency_ms").agg(F.count("*").alias("n")).withColumnRenamed("eval_run_id", "run_id")


def points_of_states(states: DataFrame, latencies: DataFrame) -> DataFrame:
    """The points that ``metric_points`` gives for all calls behind the ``states`` and ``latencies`` of any number of batches."""
    from .selection import percentiles

    key = ["run_id", *RUN[1:]]
    rate = lambda name: F.try_divide(F.sum(f"{name}_sum"), F.sum(f"{name}_n").cast("double"))
    points = states.groupBy(*key).agg(F.max("last_at").alias("timestamp"), rate("accuracy").alias("accuracy"), rate("format").alias("format_adherence"), rate("refusal").alias("refusal_rate"), F.sum("n_calls").cast("int").alias("n_calls"))
    found = percentiles(latencies, key, "latency_ms", weight="n")
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"l.{c}")) for c in key]
    met = points.alias("s").join(found.alias("l"), same, "left").select("s.*", "percentiles")
    p = F.col("percentiles")
    out = met.select(*key, "timestamp", "accuracy", "format_adherence", "refusal_rate", F.get(p, F.lit(0)).alias("latency_p50_ms"), F.get(p, F.lit(1)).alias("latency_p95_ms"), "n_calls")
    out._reads = getattr(found, "_reads", ())
    return out


def rolling_rate(calls: DataFrame, seconds: int = 60) -> DataFrame:
    """Calls of the same provider in the ``seconds`` up to each call, for holding against a cap; null for a call without a time.

    Time is cut into stretches of ``seconds``. Each call goes to its own stretch and to the next one, where it may still count, so what meets in one
    group is two stretches of a provider, however long its history.
    """
    from pyspark.sql import Window

    at = F.col("timestamp").cast("timestamp_ntz").cast("timestamp").cast("double")
    stretch = F.floor(at / F.lit(float(seconds))).cast("bigint")
    dealt = calls.withColumn("_own", stretch).withColumn("_stretch", F.explode_outer(F.when(F.col("_own").isNotNull(), F.array(F.col("_own"), F.col("_own") + 1))))
    seen = Window.partitionBy("provider", "_stretch").orderBy(at).rangeBetween(-seconds, 0)
    counted = dealt.withColumn("calls_in_window", F.when(F.col("timestamp").isNotNull(), F.count("*").over(seen)))
    return counted.filter(F.col("_stretch").eqNullSafe(F.col("_own"))).drop("_own", "_stretch")


#: Different p-values that one task ranks at a time.
RANGE = 100_000


def bh_adjust(tests: DataFrame, family: list[str], p: str = "p_value_raw", rows: int = RANGE) -> DataFrame:
    """Extension: ``p_value_corrected`` by Benjamini and Hochberg within each family of tests; 1 where there is no p-value.

    Equal values of a family count as one row. They are ranked within ranges of about ``rows`` of them; only the ranges'
    sums and minima are carried along a family, so none has to fit one task.
    """
    from pyspark.ml.feature import Bucketizer
    from pyspark.sql import Window

    key = [f"_f{i}" for i in range(len(family))]
    named = [F.col(c).alias(k) for c, k in zip(family, key)]
    values = tests.filter(F.col(p).isNotNull()).groupBy(*named, F.col(p).alias("_p")).agg(F.count("*").alias("_n")).withColumn("_x", F.col("_p").cast("double"))
    finite = values.filter(~F.isnan("_x"))
    n = -(-finite.count() // rows)
    bounds = finite.agg(F.percentile_approx("_x", [i / n for i in range(1, n)], max(10_000, 20 * n))).first()[0] if n > 1 else []
    splits = [float("-inf"), *sorted({b for b in bounds if abs(b) != float("inf")}), float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="_x", outputCol="_range", handleInvalid="keep").transform(values) if len(splits) > 2 else values.withColumn("_range", F.lit(0.0))

    same = lambda a, b, on: F.expr(" AND ".join(["true", *(f"{a}.{c} <=> {b}.{c}" for c in on)]))
    whole, part = Window.partitionBy(*key), Window.partitionBy(*key, "_range")
    sums = ranged.groupBy(*key, "_range").agg(F.sum("_n").alias("_s"))
    sums = sums.withColumns({"_m": F.sum("_s").over(whole), "_before": F.sum("_s").over(whole.orderBy("_range")) - F.col("_s")})
    rank = F.col("_before") + F.sum("_n").over(part.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranged.alias("a").join(sums.alias("b"), same("a", "b", [*key, "_range"])).select("a.*", "_m", "_before").drop("_x").withColumn("_q", F.col("_p") * F.col("_m") / rank)
    lows = ranked.groupBy(*key, "_range").agg(F.min("_q").alias("_low"))
    lows = lows.withColumn("_after", F.min("_low").over(whole.orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)))
    least = F.min("_q").over(part.orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, 0))
    corrected = ranked.alias("a").join(lows.alias("b"), same("a", "b", [*key, "_range"])).select("a.*", "_after").select(*key, "_p", F.least(F.lit(1.0), least, "_after").alias("_c"))

    met = [F.col(f"t.`{c}`").eqNullSafe(F.col(f"c.{k}")) for c, k in zip([*family, p], [*key, "_p"])]
    together = met[-1]
    for m in met[:-1]:
        together = together & m
    return tests.alias("t").join(corrected.alias("c"), together, "left").select("t.*", F.coalesce("_c", F.lit(1.0)).alias("p_value_corrected"))


def baseline_shift(points: DataFrame, metric: str, split: str) -> DataFrame:
    """Extension: means before and from a point in time, their difference in standard deviations of the former."""
    before = F.col("timestamp") < F.lit(split).cast("timestamp")
    rows = points.groupBy("provider", "model_id").agg(F.avg(F.when(before, F.col(metric))).alias("pre_mean"), F.avg(F.when(~before, F.col(metric))).alias("post_mean"), F.stddev_samp(F.when(before, F.col(metric))).alias("_sd"))
    return rows.withColumn("z_score", F.try_divide(F.col("post_mean") - F.col("pre_mean"), F.col("_sd"))).drop("_sd")
