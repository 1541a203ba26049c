"""Plans stay short, and nothing stays cached, however many rounds and batches there are."""

import datetime as dt

from pyspark.sql import functions as F

from callgauge.functions import json_checks
from callgauge.operators import normalize, selection
from callgauge.sources.store import CallStore
from callgauge.streaming import capture


def cached(spark):
    return spark.sparkContext._jsc.sc().getPersistentRDDs().size()


def plan(df):
    return df._jdf.queryExecution().toString()


def test_rounds_do_not_hold_the_plans_of_earlier_rounds(spark, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 0)
    before, rows = cached(spark), spark.range(3000).selectExpr("id % 3 AS k", "cast(id * 7 % 1009 AS double) AS v")
    lengths = []
    for bins in (1024, 4):  # two rounds, and some ten
        found = selection.percentiles(rows, ["k"], "v", bins=bins)
        assert found.count() == 3 and "InMemoryRelation" not in plan(found)
        lengths.append(len(plan(found)))
    assert cached(spark) == before and max(lengths) < 1.1 * min(lengths)


def test_batches_leave_nothing_cached_or_settled(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(selection, "FEW", 0)
    store, flags, before = CallStore(spark, str(tmp_path)), spark.createDataFrame([], "task_id string, should_refuse boolean"), cached(spark)
    for k in (0, 1, 1):
        calls = spark.range(100 * k, 100 * k + 100).select(
            F.col("id").cast("string").alias("log_id"), F.lit(dt.datetime(2024, 1, 1 + k)).alias("timestamp"), F.lit("p").alias("provider"), F.lit("m").alias("model_id"),
            F.lit("r").alias("eval_run_id"), F.lit("accuracy").alias("eval_task_type"), F.lit(1.0).alias("eval_score"), F.col("id").cast("double").alias("latency_ms"))
        found = capture.run_once(normalize.with_defaults(calls), flags, store, f"batch {k}")
        assert [(r.n_calls, r.latency_p50_ms) for r in found.collect()] == [(100 + 100 * k, 49.5 + 50 * k)]
        assert "InMemoryRelation" not in plan(found)
    assert cached(spark) == before and not list((tmp_path / "batches").iterdir())


def test_only_a_batch_that_comes_again_reads_stored_calls(spark, tmp_path, monkeypatch):
    store, read = CallStore(spark, str(tmp_path)), []
    files = store._files
    monkeypatch.setattr(store, "_files", lambda name: read.append(name) or files(name))
    of = lambda *ids: normalize.with_defaults(spark.createDataFrame([(i, dt.datetime(2024, 1, 1)) for i in ids], "log_id string, timestamp timestamp"))
    stored = lambda: sorted(r.log_id for r in files("log_rows").collect())
    for batch_id, ids in (("one", "aab"), ("two", "bcdd")):
        store.write_calls(of(*ids), batch_id)
        assert "log_rows" not in read
    assert stored() == ["a", "b", "c", "d"]
    store.write_calls(of(*"bcde"), "two")
    assert "log_rows" in read and stored() == ["a", "b", "c", "d", "e"]


def test_a_text_is_parsed_once_and_only_if_it_may_be_json(spark):
    texts = {"The answer is B.": None, "": None, "[1": None, " [1] ": "[1]", '{"a":1}': '{"a":1}', "-1": "-1", "null": "null", "1 2": None, "1,2": None, "],[": None, '1,"~end~"': None, '\u00a0"x"\n': '"x"'}
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.to_json(json_checks.strict_value(F.col("t"))).alias("value"))
    assert {r.t: r.value for r in found.collect()} == texts
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1


def test_a_batch_of_one_provider_keeps_the_points_of_the_run_s_others(spark, tmp_path):
    store, flags = CallStore(spark, str(tmp_path)), spark.createDataFrame([], "task_id string, should_refuse boolean")
    for i, provider in enumerate("pqp"):
        calls = spark.createDataFrame([(str(i), dt.datetime(2024, 1, 1), provider, "m", "r")], "log_id string, timestamp timestamp, provider string, model_id string, eval_run_id string")
        capture.run_once(normalize.with_defaults(calls), flags, store, f"batch {i}")
    assert sorted((r.provider, r.n_calls) for r in store.table("metric_series").collect()) == [("p", 2), ("q", 1)]
