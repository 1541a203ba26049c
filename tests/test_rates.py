"""Windows counted while a stream runs."""

import datetime as dt
import random

import pytest

from callgauge.operators import metrics
from callgauge.streaming import rates

pytest.importorskip("google.protobuf")
AT = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
KIND = "log_id string, provider string, timestamp timestamp"


@pytest.fixture
def streamed(spark, tmp_path):
    """Runs ``make`` over all files so far; returns what has been reported up to now."""
    before = spark.conf.get(rates.STATE_STORE[0], None)
    spark.conf.set(*rates.STATE_STORE)

    def run(make, rows):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        calls = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        query = make(calls).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).format("parquet").start(str(tmp_path / "out"))
        query.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    yield run
    spark.conf.set(rates.STATE_STORE[0], before) if before else spark.conf.unset(rates.STATE_STORE[0])


def test_equal_to_the_batch_after_restarts(spark, streamed):
    rng = random.Random(5)
    rows = [(f"c{i}", rng.choice(["groq", "openrouter", None]), AT + dt.timedelta(microseconds=rng.randrange(400_000_000))) for i in range(600)]
    rows += [("t1", "groq", AT), ("t2", "groq", AT), ("t3", "groq", AT + dt.timedelta(seconds=60)), ("none", "groq", None)]
    rng.shuffle(rows)
    make = lambda calls: rates.calls_in_window(calls, 60, "100 days")
    assert streamed(make, rows[:200]) == []
    streamed(make, rows[200:])
    end = ("end", "end", dt.datetime(2027, 1, 1, tzinfo=dt.timezone.utc))
    found = streamed(make, [end])
    wanted = metrics.rolling_rate(spark.createDataFrame([r for r in rows if r[2]], KIND), 60).collect()
    assert sorted((r.log_id, r.provider or "", r.timestamp, r.calls_in_window) for r in found) == sorted((r.log_id, r.provider or "", r.timestamp, r.calls_in_window) for r in wanted)


def test_late_calls_and_caps(spark, streamed):
    caps = spark.createDataFrame([("groq", 2), ("openrouter", 9)], "provider string, max_calls int")
    make = lambda calls: rates.calls_over_caps(calls, caps, 60, "10 seconds")
    call = lambda name, s, p="groq": (name, p, AT + dt.timedelta(seconds=s))
    found = streamed(make, [call("a", 1), call("b", 2), call("c", 50), call("o", 3, "openrouter"), call("x", 200)])
    assert [(r.log_id, r.calls_in_window, r.max_calls) for r in found] == [("c", 3, 2)]
    found = streamed(make, [call("late", 20), call("in time", 195), call("y", 250), call("z", 1000)])
    assert {(r.log_id, r.calls_in_window) for r in found} == {("c", 3), ("y", 3)}
