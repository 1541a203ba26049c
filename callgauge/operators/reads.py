"""Reads over the stored tables; filters reach the scan, and a limit with an order is a top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def metric_series(points: DataFrame, provider: str, model_id: str, metric_name: str | None = None) -> DataFrame:
    """A model's points in order of time; ``metric_name`` narrows the columns to one metric."""
    found = points.filter((F.col("provider") == provider) & (F.col("model_id") == model_id)).orderBy("timestamp", "run_id")
    return found if metric_name is None else found.select("run_id", "timestamp", "provider", "model_id", metric_name)


def logs_for_run(calls: DataFrame, eval_run_id: str) -> DataFrame:
    return calls.filter(F.col("eval_run_id") == eval_run_id)


def exemplars(calls: DataFrame, provider: str, model_id: str, start, end, limit: int = 5) -> DataFrame:
    """The first ``limit`` calls of a model from ``start`` to ``end``, both included."""
    within = F.col("timestamp").between(F.lit(start), F.lit(end))
    return calls.filter((F.col("provider") == provider) & (F.col("model_id") == model_id) & within).orderBy("timestamp", "log_id").limit(limit)


def open_events(events: DataFrame) -> DataFrame:
    """Significant events that nobody has reviewed, newest first."""
    return events.filter(F.col("significant") & ~F.col("reviewed")).orderBy(F.desc("detected_at"), "id")


def inspect_calls(calls: DataFrame, integration_path: str | None = None, provider: str | None = None, outcome: str | None = None, limit: int = 10) -> DataFrame:
    """The newest calls under the filters given; a negative limit means all."""
    for name, value in (("integration_path", integration_path), ("provider", provider), ("outcome", outcome)):
        if value is not None:
            calls = calls.filter(F.col(name) == value)
    ordered = calls.orderBy(F.desc("timestamp"), "log_id")
    return ordered if limit < 0 else ordered.limit(limit)


def deduplicated(calls: DataFrame) -> DataFrame:
    """One row for each log_id: the earliest."""
    first = calls.groupBy("log_id").agg(F.min_by(F.struct(*(c for c in calls.columns if c != "log_id")), F.struct(*(c for c in calls.columns if c != "log_id"))).alias("_row"))
    return first.select("log_id", "_row.*").select(*calls.columns)
