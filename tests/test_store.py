import datetime as dt

import pytest
from pyspark.sql import functions as F

from callgauge.operators import metrics, normalize
from callgauge.sources.key_index import KeyIndex
from callgauge.sources.store import CallStore
from callgauge.streaming import capture

AT = dt.datetime(2024, 1, 1, 12)
CALL = "log_id string, timestamp timestamp, provider string, model_id string, eval_run_id string, eval_task_type string, eval_score double, latency_ms double"


def calls(spark, *rows):
    """(log_id, day of January, score, latency) of one run."""
    return normalize.with_defaults(spark.createDataFrame([(i, AT.replace(day=day), "p", "m", "r", "accuracy", score, ms) for i, day, score, ms in rows], CALL))


def no_flags(spark):
    return spark.createDataFrame([], "task_id string, should_refuse boolean")


def points(store):
    return [(r.run_id, r.n_calls, round(r.accuracy, 3), r.latency_p50_ms, round(r.latency_p95_ms, 6)) for r in store.table("metric_series").collect()]


def test_points_of_a_run_over_many_days(spark, tmp_path):
    store, flags = CallStore(spark, str(tmp_path)), no_flags(spark)
    batches = [calls(spark, ("a", 1, 1.0, 10.0)), calls(spark, ("b", 31, 1.0, 30.0)), calls(spark, ("c", 11, 0.0, 20.0))]
    for batch in batches:
        capture.run_once(batch, flags, store)
    assert points(store) == [("r", 3, 0.667, 20.0, 29.0)]
    capture.run_once(batches[0], flags, store)  # again, under the same name
    capture.run_once(batches[1].unionByName(calls(spark, ("d", 5, 0.0, 40.0))), flags, store)  # one call again, one new
    assert points(store) == [("r", 4, 0.5, 25.0, 38.5)]
    assert store.calls().count() == 4
    whole = metrics.metric_points(store.calls(), flags)
    assert sorted(map(tuple, store.points_of_runs().select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_points_read_no_stored_call(spark, tmp_path):
    store = CallStore(spark, str(tmp_path))
    capture.run_once(calls(spark, ("a", 1, 1.0, 10.0)), no_flags(spark), store)
    assert all("log_rows" not in f for f in store.points_of_runs().inputFiles())


def test_a_batch_cut_off_anywhere_comes_again(spark, tmp_path):
    flags, batch = no_flags(spark), calls(spark, ("a", 1, 1.0, 10.0), ("b", 2, 0.0, 20.0))
    for k, broken in enumerate(("write_states", "replace_points", "points_of_runs")):
        store = CallStore(spark, str(tmp_path / str(k)))
        setattr(store, broken, lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            capture.run_once(batch, flags, store, "one")
        delattr(store, broken)
        capture.run_once(batch, flags, store, "one")
        assert points(store) == [("r", 2, 0.5, 15.0, 19.5)] and store.calls().count() == 2
    store = CallStore(spark, str(tmp_path / "calls"))
    store.keys.add(spark.createDataFrame([("id:a",), ("id:b",)], "key string"), "one")  # keys are there, calls are not
    store.write_calls(batch, "one")
    assert store.calls().count() == 2


def test_a_log_id_is_stored_once_over_all_days(spark, tmp_path):
    store = CallStore(spark, str(tmp_path))
    of = lambda i, at: normalize.with_defaults(spark.createDataFrame([(i, at)], "log_id string, timestamp timestamp"))
    for i, at in (("x", dt.datetime(2024, 1, 1, 23, 59, 59)), ("x", dt.datetime(2024, 1, 2, 0, 0, 1)), ("x", None), ("y", None), ("y", AT), (None, AT), (None, AT), (None, AT.replace(day=3))):
        store.write_calls(of(i, at))
    assert sorted((str(r.log_id), str(r.timestamp)[:10]) for r in store.calls().collect()) == [("None", "2024-01-01"), ("None", "2024-01-03"), ("x", "2024-01-01"), ("y", "None")]


def test_only_parts_that_filters_cannot_exclude_are_read(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path))
    for day in range(1, 5):
        index.add(spark.range(300 * day, 300 * day + 300).select(F.col("id").cast("string").alias("key")), f"b{day}", f"2024-01-0{day}")
    keys = lambda *ids: spark.createDataFrame([(str(i),) for i in ids], "key string")
    parts = index.parts_that_may_have(keys(301, 302, 99_999))
    assert 1 <= len(parts) <= 2 and {str(p) for _, p in parts} == {"2024-01-01"}
    assert sorted(r.key for r in index.known(keys(301, 302, 700, 99_999), "b2").collect()) == ["301", "302"]
    assert sorted(r.key for r in index.known(keys(301, 700), "other").collect()) == ["301", "700"]
    plan = index.known(keys(301, 302), "other")._jdf.queryExecution().executedPlan().toString()
    pruned = [p.split("]")[0] for p in plan.split("PartitionFilters: [")[1:] if "2024-01-01" in p.split("]")[0]]
    assert pruned and all("2024-01-03" not in p and "bucket" in p for p in pruned)
    assert index.known(keys(99_999), "other").count() == 0
    several = [index.parts_that_may_have(keys(i)) for i in (310, 650, 1400)]
    index.merge_filters()
    assert several == [index.parts_that_may_have(keys(i)) for i in (310, 650, 1400)]


def test_an_exchange_without_an_id_keeps_its_name(spark, tmp_path):
    from callgauge import schemas

    rows = [(None, AT, "api.groq.com", '{"model":"m","prompt":"%d"}' % i, '{"choices":[{"text":"t"}]}', 200, None, None, 1.0) for i in range(3)]
    spark.createDataFrame(rows, schemas.RAW_EXCHANGES).write.parquet(str(tmp_path / "in"))
    store = CallStore(spark, str(tmp_path / "store"))
    for name in ("a", "b"):  # the same exchanges once more
        capture.capture(capture.read_exchanges(spark, str(tmp_path / "in"), "parquet"), store, str(tmp_path / name), trigger={"availableNow": True}).awaitTermination()
    assert store.calls().count() == 3 and store.calls().select("log_id").distinct().count() == 3


def test_many_runs_share_files(spark, tmp_path):
    store = CallStore(spark, str(tmp_path))
    found = spark.range(300).select(F.concat(F.lit("r"), "id").alias("run_id"), F.lit(AT).alias("timestamp"), F.lit("p").alias("provider"), F.lit("m").alias("model_id"), F.lit(1).alias("n_calls"))
    store.replace_points(found.coalesce(1))
    store.replace_points(found.filter("run_id = 'r7'").withColumn("n_calls", F.lit(2)).coalesce(1))
    store.write_points(found.filter("run_id = 'r8'").withColumn("n_calls", F.lit(3)).coalesce(1))
    series = store.table("metric_series")
    assert series.count() == 301 and series.filter("run_id = 'r7'").first().n_calls == 2 and series.filter("run_id = 'r8'").agg(F.sum("n_calls")).first()[0] == 4
    assert len([p for p in (tmp_path / "metric_series").iterdir() if p.name.startswith("month=")]) == 1
