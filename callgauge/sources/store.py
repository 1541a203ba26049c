"""The tables of a monitoring store: Parquet folders under one path, appended to and read lazily."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..operators.metrics import RUN, points_of_states, run_latencies, run_states
from ..settling import discard, settled
from .key_index import KeyIndex

TABLES = {"log_rows": schemas.CALL_LOG, "metric_series": schemas.METRIC_SERIES, "changepoint_events": schemas.CHANGEPOINT_EVENTS, "run_state": schemas.RUN_STATE, "run_latencies": schemas.RUN_LATENCIES}
#: Columns that a table has in its files besides: what it is partitioned by, and which writing of a run's points counts.
INNER = {"log_rows": {"log_date": "date"}, "metric_series": {"version": "bigint", "replaces": "boolean", "month": "date"}}
PARTITIONS = {"log_rows": ["log_date"], "metric_series": ["month"]}


def row_key() -> Column:
    """What a call is known by: its log_id, or else a digest of the whole row."""
    columns = [c.split()[0] for c in schemas.CALL_LOG.split(", ")]
    digest = F.sha2(F.to_json(F.struct(*columns)), 256)
    return F.coalesce(F.concat(F.lit("id:"), "log_id"), F.concat(F.lit("row:"), digest))


class CallStore:
    """Tables are made if missing; one writer at a time.

    The call log is partitioned by day, so time ranges prune files, and each log_id is in it once, whatever its days: an index of keys tells what
    is stored. The metric series is partitioned by month; points are appended with a version, and reading takes the last writing of each run, provider and model. States of runs
    are appended by batch, and reading takes the last attempt of each batch, so a batch that comes again changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.batches = f"{self.path}/batches"  # settled tables of the batch at hand
        for name, schema in TABLES.items():
            more = "".join(f", {c} {t}" for c, t in INNER.get(name, {}).items())
            spark.createDataFrame([], schema + more).write.mode("ignore").partitionBy(*PARTITIONS.get(name, [])).parquet(f"{self.path}/{name}")
        self.keys = KeyIndex(spark, f"{self.path}/log_keys")

    def _files(self, name: str) -> DataFrame:
        more = "".join(f", {c} {t}" for c, t in INNER.get(name, {}).items())
        return self.spark.read.schema(TABLES[name] + more).parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        found = self._files(name)
        if name == "metric_series":
            last = F.max(F.when(F.col("replaces"), F.col("version"))).over(Window.partitionBy("run_id", *RUN[1:]))
            found = found.withColumn("_last", last).filter("_last IS NULL OR version >= _last")
        elif name in ("run_state", "run_latencies"):
            last = self._files(name).groupBy("batch_id").agg(F.max("attempt").alias("attempt"))
            found = found.join(last, ["batch_id", "attempt"], "left_semi")
        return found.select(*(c.split()[0] for c in TABLES[name].split(", ")))

    def calls(self, start=None, end=None) -> DataFrame:
        """The call log; ``start`` and ``end`` (both included) prune the days read."""
        found = self._files("log_rows")
        if start is not None:
            found = found.filter((F.col("log_date") >= F.to_date(F.lit(start))) & (F.col("timestamp") >= F.lit(start)))
        if end is not None:
            found = found.filter((F.col("log_date") <= F.to_date(F.lit(end))) & (F.col("timestamp") <= F.lit(end)))
        return found.drop("log_date")

    def batch_id(self, calls: DataFrame) -> str:
        """A name that the same calls always get, in any order."""
        columns = [c.split()[0] for c in schemas.CALL_LOG.split(", ")]
        row = calls.select(F.to_json(F.struct(*columns)).alias("key")).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64("key", F.lit(1)).cast("decimal(38,0)")).alias("s")).first()
        return f"calls:{row.n}:{row.x}:{row.s}"

    def write_calls(self, calls: DataFrame, batch_id: str | None = None) -> DataFrame:
        """Appends the calls whose log_id no other batch has stored, one of each, and returns these calls: a settled table, to be discarded.

        A call without a log_id counts as stored if an equal row is. The index goes first; a batch that was cut off after it and comes again under its ``batch_id`` finds its own keys no
        hindrance, and appends what is missing on its days. No other batch reads stored calls.
        """
        batch_id = batch_id or self.batch_id(calls)
        names = [c.split()[0] for c in schemas.CALL_LOG.split(", ")]
        again = self.keys.has_batch(batch_id)
        keyed = calls.select(*names).withColumns({"key": row_key(), "log_date": F.to_date("timestamp")})
        made = [settled(keyed, self.batches)]
        try:
            new = made[0]
            if not new.groupBy("key").count().filter("count > 1").isEmpty():  # whole rows are shuffled only then
                made.append(new := settled(new.dropDuplicates(["key"]), self.batches))
            fresh = new
            made.append(known := settled(self.keys.known(new.select("key"), batch_id), self.batches))
            if not known.isEmpty():
                made.append(fresh := settled(new.join(known.hint("merge"), "key", "left_anti"), self.batches))
            self.keys.add(fresh.select("key"), batch_id)
            missing = fresh
            if again:
                days = [r.log_date for r in fresh.select("log_date").distinct().collect()]  # days of one batch
                stored = self._files("log_rows").filter(F.col("log_date").isin([d for d in days if d]) | F.col("log_date").isNull())
                missing = fresh.join(stored.select(row_key().alias("key")).hint("merge"), "key", "left_anti")
            # a day's rows go to as many tasks, and so files, as their bytes ask for
            missing.select(*names, "log_date").hint("rebalance", "log_date").write.mode("append").partitionBy("log_date").parquet(f"{self.path}/log_rows")
            made.remove(fresh)
            out = fresh.select(*names)
            out._settled_at = fresh._settled_at
            return out
        finally:
            discard(*made)

    def write_states(self, calls: DataFrame, refusal_tasks: DataFrame, batch_id: str) -> DataFrame:
        """Adds what ``calls``, those that a batch brought, say about their runs, and returns these runs (run_id, provider, model_id): a settled table, to be discarded."""
        attempt = F.lit(time.time_ns()).alias("attempt")
        for name, rows in (("run_state", run_states(calls, refusal_tasks)), ("run_latencies", run_latencies(calls))):
            columns = [c.split() for c in TABLES[name].split(", ")]
            made = rows.withColumns({"batch_id": F.lit(batch_id), "attempt": attempt}).select(*(F.col(c).cast(t) for c, t in columns))
            made.sortWithinPartitions("run_id").write.mode("append").parquet(f"{self.path}/{name}")
        return settled(calls.filter("eval_run_id IS NOT NULL").select(F.col("eval_run_id").alias("run_id"), *RUN[1:]).distinct(), self.batches)

    def points_of_runs(self, runs: DataFrame | None = None) -> DataFrame:
        """Points of whole runs (all, if none are given) out of the stored states; no call is read."""
        states, latencies = self.table("run_state"), self.table("run_latencies")
        if runs is not None:
            same = lambda a: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("run_id", *RUN[1:])]
            wanted = runs.alias("r")
            states = states.alias("s").join(wanted, same("s"), "left_semi")
            latencies = latencies.alias("l").join(wanted, same("l"), "left_semi")
        return points_of_states(states, latencies)

    def write_points(self, points: DataFrame) -> None:
        """Appends points."""
        self._append("metric_series", points)

    def replace_points(self, points: DataFrame) -> DataFrame:
        """Writes points in the place of all stored ones of the same run, provider and model, so writing them again changes nothing, and returns them as stored."""
        return self._append("metric_series", points, replaces=True)

    def write_events(self, events: DataFrame) -> DataFrame:
        """Appends change-point events and returns them with their ids."""
        return self._append("changepoint_events", events)

    def _append(self, name: str, rows: DataFrame, replaces: bool = False) -> DataFrame:
        """Ids go on from the largest stored; they are unique and grow, with gaps between partitions."""
        files = self._files(name)
        last = files.agg(F.max("id")).first()[0]
        columns = [c.split() for c in TABLES[name].split(", ")]
        ready = rows.withColumn("id", F.lit((last or 0) + 1) + F.monotonically_increasing_id())
        ready = ready.select(*(F.col(n).cast(t) if n in ready.columns else F.lit(False if t == "boolean" else None).cast(t).alias(n) for n, t in columns))
        if name == "metric_series":
            ready = ready.withColumns({"version": F.lit(time.time_ns()), "replaces": F.lit(replaces), "month": F.trunc("timestamp", "month")})
        ready.write.mode("append").partitionBy(*PARTITIONS.get(name, [])).parquet(f"{self.path}/{name}")
        return self.table(name).filter(F.col("id") > (last or 0))
