import datetime as dt
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from callgauge import schemas
from callgauge.functions import exchanges
from callgauge.operators import metrics, normalize, reads, sampling
from callgauge.sources import tasks
from callgauge.sources.providers import providers
from callgauge.sources.sqlite_source import read_sqlite
from callgauge.sources.store import CallStore
from callgauge.streaming import capture

AT = dt.datetime(2024, 1, 1, 12)
OK = '{"model":"m-7","choices":[{"message":{"role":"assistant","content":"hi"}}],"usage":{"prompt_tokens":5,"completion_tokens":3,"total_tokens":8}}'
ASK = '{"model":"m-7","messages":[{"role":"user","content":"q"}],"temperature":0.2}'


def raw(spark, *rows):
    return spark.createDataFrame([(str(i), AT, *r) for i, r in enumerate(rows)], schemas.RAW_EXCHANGES)


def test_normalization(spark):
    calls, bad = normalize.normalize_exchanges(
        raw(
            spark,
            ("api.groq.com", ASK, OK, 200, None, None, 12.0),
            ("api.groq.com", ASK, '{"error":{"message":"broken"}}', 500, None, None, 1.0),
            ("api.openai.com", ASK, '{"error":{"message":"slow down"}}', 429, None, None, 1.0),
            ("openrouter.ai", ASK, None, None, "timeout", "read timed out", 30.0),
            ("example.com", ASK, OK, 200, None, None, 1.0),
            ("api.groq.com", "[1]", OK, 200, None, None, 1.0),
            ("api.groq.com", None, '["x"]', 500, None, None, None),
        ),
        integration_path="proxy",
    )
    rows = {r.log_id: r for r in calls.collect()}
    assert set(rows) == {"0", "1", "2", "3", "6"} and [r.log_id for r in bad.collect()] == ["5"]
    first = rows["0"]
    assert (first.provider, first.model_id, first.outcome, first.response_text, first.prompt_tokens, first.completion_tokens, first.request_params_json, first.integration_path) == ("groq", "m-7", "ok", "hi", 5, 3, '{"temperature":0.2}', "proxy")
    assert (rows["1"].outcome, rows["1"].error_message) == ("error", "broken")
    assert rows["2"].outcome == "rate_limited"
    assert (rows["3"].outcome, rows["3"].error_message, rows["3"].response_text) == ("timeout", "read timed out", None)
    assert (rows["6"].model_id, rows["6"].error_message, rows["6"].prompt) == ("unknown", None, "")


def test_percentiles_and_rates(spark):
    rows = [("r", "p", "m", AT, "accuracy", "c", "ok", s, v, "") for s, v in ((1.0, 1.0), (None, 2.0), (0.0, 4.0))]
    calls = spark.createDataFrame(rows, "eval_run_id string, provider string, model_id string, timestamp timestamp, eval_task_type string, eval_task_id string, outcome string, eval_score double, latency_ms double, response_text string")
    tasks = spark.createDataFrame([("t", True), ("t", False)], "task_id string, should_refuse boolean")
    runs = spark.createDataFrame([("r", "p", "m"), ("none", "p", "m")], "eval_run_id string, provider string, model_id string")
    found = {r.run_id: r for r in metrics.metric_points(calls, tasks, runs=runs).collect()}
    assert (found["r"].accuracy, found["r"].latency_p50_ms, round(found["r"].latency_p95_ms, 6), found["r"].n_calls, found["r"].refusal_rate) == (0.5, 2.0, 3.8, 3, None)
    assert (found["none"].n_calls, found["none"].accuracy) == (0, None)
    with pytest.raises(ValueError):
        metrics.subset_filter("some")


def test_store_and_stream(spark, tmp_path):
    store = CallStore(spark, str(tmp_path / "store"))
    exchange = raw(spark, ("api.groq.com", ASK, OK, 200, None, None, 12.0), ("api.groq.com", ASK, OK, 200, None, None, 13.0))
    exchange.unionByName(exchange).withColumn("timestamp", F.col("timestamp").cast("string")).write.json(str(tmp_path / "in"))
    stream = capture.read_exchanges(spark, str(tmp_path / "in"))
    for name in ("a", "b"):  # the second one finds all of it stored
        capture.capture(stream, store, str(tmp_path / name), trigger={"availableNow": True}).awaitTermination()
    assert store.calls().count() == 2 and store.calls(AT, AT).count() == 2
    failed = []
    broken = CallStore(spark, str(tmp_path / "other"))
    broken.write_calls = lambda _: 1 / 0
    capture.capture(stream, broken, str(tmp_path / "c"), on_error=failed.append, trigger={"availableNow": True}).awaitTermination()
    assert isinstance(failed[0], ZeroDivisionError)
    events = spark.createDataFrame([("p", "m", True), ("p", "n", True)], "provider string, model_id string, significant boolean")
    assert store.write_events(events).select("id").distinct().count() == 2
    assert store.write_events(events.limit(1)).count() == 1
    assert reads.open_events(store.table("changepoint_events")).count() == 3
    graded = store.calls().withColumn("eval_run_id", F.lit("r"))
    graded.write.parquet(str(tmp_path / "graded"))
    flags = spark.createDataFrame([], "task_id string, should_refuse boolean")
    arrived = spark.readStream.schema(graded.schema).parquet(str(tmp_path / "graded"))
    capture.run_forever(arrived, flags, CallStore(spark, str(tmp_path / "runs")), str(tmp_path / "d"), 0).awaitTermination()
    assert [r.n_calls for r in CallStore(spark, str(tmp_path / "runs")).table("metric_series").collect()] == [2]


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "calls.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE log_rows (" + ", ".join(c.split()[0] for c in schemas.CALL_LOG.split(", ")) + ")")
        db.execute("INSERT INTO log_rows (log_id, timestamp, provider, latency_ms) VALUES ('x', '2024-01-01 12:00:00.000000', 'groq', 3)")
    row = read_sqlite(spark, path).first()
    assert (row.log_id, row.provider, row.latency_ms, row.timestamp) == ("x", "groq", 3.0, AT)


def test_sampling_is_repeatable(spark):
    rows = spark.range(300).withColumn("s", F.col("id") % 4)
    once, again = (sorted(map(tuple, sampling.stratified_sample(r, "s", "id").collect())) for r in (rows, rows.repartition(5)))
    assert once == again and len(once) == 20


def test_command_line(spark, tmp_path, capsys):
    from callgauge import cli

    CallStore(spark, str(tmp_path / "s")).write_calls(normalize.with_defaults(spark.createDataFrame([("1", "groq", "p " * 90)], "log_id string, provider string, prompt string")))
    assert cli.main(["--store", str(tmp_path / "s"), "inspect", "--provider", "groq"]) == 0
    assert "[...]" in capsys.readouterr().out


@pytest.mark.parametrize("rows", [7, 100_000])
def test_families_are_corrected_in_ranges(spark, rows):
    rng = random.Random(5)
    tests = [(i, rng.choice(["a", "a", "a", "b", None]), rng.choice([None, rng.random() ** 3, round(rng.random(), 1)])) for i in range(400)]
    expected = {}
    for family in ("a", "b", None):
        order = sorted((p, i) for i, f, p in tests if f == family and p is not None)
        low = 1.0
        for rank in range(len(order), 0, -1):
            low = min(low, order[rank - 1][0] * len(order) / rank)
            expected[order[rank - 1][1]] = low
    frame = spark.createDataFrame(tests, "id int, provider string, p_value_raw double")
    found = metrics.bh_adjust(frame, ["provider"], rows=rows)
    assert {r.id: r.p_value_corrected for r in found.collect()} == {i: expected.get(i, 1.0) for i, _, _ in tests}
    one = metrics.bh_adjust(frame.filter("provider = 'a'"), [], rows=rows)
    assert {r.id: r.p_value_corrected for r in one.collect()} == {i: expected.get(i, 1.0) for i, f, _ in tests if f == "a"}


def test_frozen_sets_read_back(spark, tmp_path):
    rows = [(f"t{i}", "s", f"which\n{i}?", ["a", "b"], i % 2) for i in range(5)] + [("none", None, None, None, None)]
    frozen = spark.createDataFrame(rows, schemas.CHOICE_TASKS)
    path = str(tmp_path / "choices")
    assert tasks.freeze(frozen.repartition(3), path).count() == 6
    assert tasks.freeze(frozen.limit(1), path).count() == 6
    assert sorted(map(tuple, tasks.choice_tasks(spark, path).collect())) == sorted(rows, key=lambda r: r[0])
    (tmp_path / "list.json").write_text('[\n {"task_id": "a", "prompt": "p", "type": "safe", "should_refuse": false},\n {"task_id": "b"}\n]')
    assert [r.task_id for r in tasks.refusal_tasks(spark, str(tmp_path / "list.json")).collect()] == ["a", "b"]
    assert tasks.freeze(frozen.limit(0), str(tmp_path / "empty")).count() == 0
    assert tasks.format_tasks(spark).count() == 6
    frozen.write.parquet(str(tmp_path / "data"))
    assert tasks.dataset(spark, str(tmp_path / "data")).count() == 6


def test_windows_of_several_days(spark):
    rows = [("p", AT + dt.timedelta(days=i)) for i in range(3)] + [("p", None), ("q", AT), (None, AT), (None, AT)]
    calls = spark.createDataFrame(rows, "provider string, timestamp timestamp")
    found = sorted((tuple(r) for r in metrics.rolling_rate(calls, 3 * 86400).collect()), key=str)
    assert [r[2] for r in found if r[0] == "p" and r[1]] == [1, 2, 3] and ("p", None, None) in found
    assert [r[2] for r in found if r[0] == "q"] == [1] and [r[2] for r in found if r[0] is None] == [2, 2] and len(found) == 7


def test_truth_goes_by_type(spark):
    cases = [('"0"', "0"), ('"false"', "false"), ('"[]"', "[]"), ('"{}"', "{}"), ('""', ""), ("0", ""), ("0.0", ""), ("false", ""), ("null", ""), ("[]", ""), ("{}", ""), ("7", "7"), ("true", "true"), ('"x"', "x")]
    bodies = spark.createDataFrame([(f'{{"prompt":{value}}}', expected) for value, expected in cases] + [("{}", "")], "body string, expected string")
    for r in bodies.select("body", "expected", exchanges.prompt_of(exchanges.parsed(F.col("body")), F.col("body")).alias("found")).collect():
        assert r.found == r.expected, r.body


def test_last_flag_stated_counts(spark):
    calls = spark.createDataFrame([("t",), ("u",)], "eval_task_id string")
    flags = spark.createDataFrame([("t", i % 3 == 0) for i in range(40)] + [("u", None)], "task_id string, should_refuse boolean").coalesce(4)
    for _ in range(3):
        assert {r.eval_task_id: r.should_refuse for r in metrics.with_task_flags(calls, flags).collect()} == {"t": True, "u": None}


def test_runs_over_several_batches_give_one_point(spark, tmp_path):
    store = CallStore(spark, str(tmp_path / "store"))
    of = lambda ids, at=AT: normalize.with_defaults(spark.createDataFrame([(str(i), at, "p", "m", "r", "accuracy", float(i % 2)) for i in ids], "log_id string, timestamp timestamp, provider string, model_id string, eval_run_id string, eval_task_type string, eval_score double"))
    flags = spark.createDataFrame([], "task_id string, should_refuse boolean")
    for ids, at in (([1, 2], AT), ([3, 5], AT + dt.timedelta(days=1)), ([3, 5], AT + dt.timedelta(days=1))):
        capture.run_once(of(ids, at), flags, store)
    assert [(r.run_id, r.n_calls, r.accuracy) for r in store.table("metric_series").collect()] == [("r", 4, 0.75)]
    store.write_points(store.table("metric_series").withColumn("run_id", F.lit("s")))
    assert store.table("metric_series").count() == 2


def test_only_the_days_of_a_batch_are_read(spark, tmp_path):
    store = CallStore(spark, str(tmp_path / "store"))
    of = lambda i, at: normalize.with_defaults(spark.createDataFrame([(i, at)], "log_id string, timestamp timestamp"))
    for i, at in (("a", AT), ("b", AT + dt.timedelta(days=1)), ("b", AT + dt.timedelta(days=1)), (None, AT), ("n", None), ("n", None)):
        store.write_calls(of(i, at))
    assert sorted(str(r.log_id) for r in store.calls().collect()) == ["None", "a", "b", "n"]
    plan = store.calls(AT, AT)._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_streams_tell_of_what_they_cannot_read(spark, tmp_path, caplog):
    raw(spark, ("api.groq.com", ASK, OK, 200, None, None, 1.0), ("api.groq.com", "[1]", OK, 200, None, None, 1.0)).write.parquet(str(tmp_path / "in"))
    refused = []
    stream = capture.read_exchanges(spark, str(tmp_path / "in"), "parquet")
    store = CallStore(spark, str(tmp_path / "store"))
    with caplog.at_level("INFO"):
        capture.capture(stream, store, str(tmp_path / "a"), on_quarantine=lambda bad: refused.extend(bad.collect()), trigger={"availableNow": True}).awaitTermination()
        capture.capture(stream, store, str(tmp_path / "b"), trigger={"availableNow": True}).awaitTermination()
    assert [r.request_body for r in refused] == ["[1]"] and store.calls().count() == 1
    assert "2 exchanges" in caplog.text and "1 exchanges can't be read" in caplog.text


def test_windowed_latency_in_batches(spark):
    calls = spark.createDataFrame([("p", AT + dt.timedelta(minutes=i), float(i)) for i in range(10)], "provider string, timestamp timestamp, latency_ms double")
    assert sorted((r.n_calls, tuple(r.percentiles)) for r in capture.windowed_latency(calls).collect()) == [(5, (2.0, 3.8)), (5, (7.0, 8.8))]


def test_providers(spark):
    assert {r.provider: (r.max_calls, r.period_seconds) for r in providers(spark).collect()} == {"groq": (25, 60.0), "openrouter": (18, 60.0)}


def test_command_line_runs_an_evaluation(spark, tmp_path):
    import json

    from callgauge import cli

    (tmp_path / "flags.json").write_text(json.dumps([{"task_id": "t", "prompt": "p", "type": "safe", "should_refuse": False}]))
    rows = [(str(i), AT, p, "m", "r", "refusal", "t", 1.0) for i, p in enumerate(("groq", "groq", "openrouter"))]
    normalize.with_defaults(spark.createDataFrame(rows, "log_id string, timestamp timestamp, provider string, model_id string, eval_run_id string, eval_task_type string, eval_task_id string, eval_score double")).write.parquet(str(tmp_path / "calls"))
    assert cli.main(["--store", str(tmp_path / "s"), "run", "--provider", "groq", "--model", "m", "--calls", str(tmp_path / "calls"), "--refusal-tasks", str(tmp_path / "flags.json")]) == 0
    assert [(r.provider, r.n_calls, r.refusal_rate) for r in CallStore(spark, str(tmp_path / "s")).table("metric_series").collect()] == [("groq", 2, 1.0)]


def test_all_events_are_corrected(spark, tmp_path):
    from callgauge.plans import catalogue
    from tests.oracle import SF

    events = spark.read.parquet(f"{SF}/events.parquet")
    folder = str(tmp_path)
    for name in ("events", "documents"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{folder}/{name}.parquet")
    events.withColumn("event_id", F.col("event_id") + 5000).write.mode("append").parquet(f"{folder}/events.parquet")
    found = catalogue.queries()["bh_adjust"](spark, folder)
    assert found.count() == 2 * events.count() and found.filter("id >= 3000").count() > 0
