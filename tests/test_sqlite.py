import datetime as dt
import sqlite3

import pytest
from pyspark.sql import functions as F

from callgauge import schemas
from callgauge.sources import sqlite_source
from callgauge.sources.sqlite_source import follow_sqlite, read_sqlite

NAMES = [c.split()[0] for c in schemas.CALL_LOG.split(", ")]
ROWS = [
    ("a", "2024-01-01 12:00:00.000000", "groq", 3.0, 7, "100%"),
    ("b", "2024-01-02T12:00:00.000000", "groq", None, None, "it's"),
    ("c", "2024-01-03 12:00:00.000000", None, 5.5, 9, None),
    ("d", None, "openai", 8.0, -1, "x_y"),
]


def made(path, rows=ROWS):
    with sqlite3.connect(path) as db:
        db.execute(f"CREATE TABLE IF NOT EXISTS log_rows ({', '.join(NAMES)})")
        db.executemany("INSERT INTO log_rows (log_id, timestamp, provider, latency_ms, prompt_tokens, prompt) VALUES (?, ?, ?, ?, ?, ?)", rows)
    return str(path)


def test_conditions_hold_as_in_spark(spark, tmp_path):
    path, at = made(tmp_path / "a.db"), dt.datetime(2024, 1, 2, 12)
    whole = read_sqlite(spark, path, rows_per_partition=2).persist()
    cases = [
        (("provider", "=", "groq"), F.col("provider") == "groq"), (("provider", "!=", "groq"), F.col("provider") != "groq"), (("prompt_tokens", ">", 0), F.col("prompt_tokens") > 0),
        (("latency_ms", "is null"), F.col("latency_ms").isNull()), (("latency_ms", "is not null"), F.col("latency_ms").isNotNull()), (("timestamp", ">=", at), F.col("timestamp") >= at), (("timestamp", "<", at), F.col("timestamp") < at),
        (("timestamp", "=", at), F.col("timestamp") == at), (("provider", "in", ["groq", "openai"]), F.col("provider").isin("groq", "openai")), (("provider", "not in", ["groq"]), ~F.col("provider").isin("groq")),
        (("prompt", "startswith", "it'"), F.col("prompt").startswith("it'")), (("prompt", "endswith", "%"), F.col("prompt").endswith("%")), (("prompt", "contains", "_"), F.col("prompt").contains("_")), (("prompt", "endswith", ""), F.col("prompt").endswith("")),
        (("log_id", "=", "x'; DROP TABLE log_rows; --"), F.lit(False)),
    ]
    for condition, in_spark in cases:
        found = read_sqlite(spark, path, columns=("log_id",), where=(condition, ("log_id", "is not null")))
        assert sorted(r.log_id for r in found.collect()) == sorted(r.log_id for r in whole.filter(in_spark).collect()), condition
    whole.unpersist()
    with pytest.raises(ValueError):
        sqlite_source.condition("a", "or 1 = 1 --", 1)


def test_a_frame_is_the_same_after_a_filter(spark, tmp_path):
    frame = read_sqlite(spark, made(tmp_path / "a.db"))
    assert [frame.filter("provider = 'groq'").count(), frame.count(), frame.filter("provider = 'groq' OR prompt_tokens = 9").count()] == [2, 4, 3]


def test_values_are_bound_and_columns_chosen(spark, tmp_path):
    frame = read_sqlite(spark, made(tmp_path / "a.db"), columns=("log_id", "prompt_tokens"), where=(("provider", "=", "groq"), ("timestamp", "<", dt.datetime(2024, 1, 2))))
    assert frame.columns == ["log_id", "prompt_tokens"] and frame.count() == 1
    table = sqlite_source._Table(frame.schema, {"path": "p", "where": '[["provider", "=", "groq"], ["timestamp", "<", "2024"]]'})
    text, bound = table.statement(sqlite_source.Rows("p", 1, 9))
    assert text == """SELECT "log_id", "prompt_tokens" FROM "log_rows" WHERE (rowid >= ? AND rowid < ?) AND ("provider" = ?) AND (replace("timestamp", 'T', ' ') < ?)"""
    assert bound == [1, 9, "groq", "2024"]


def test_odd_files(spark, tmp_path):
    empty = made(tmp_path / "empty.db", [])
    assert read_sqlite(spark, empty).count() == 0
    gaps = made(tmp_path / "gaps.db")
    with sqlite3.connect(gaps) as db:
        db.execute("DELETE FROM log_rows WHERE log_id IN ('a', 'c')")
    assert sorted(r.log_id for r in read_sqlite(spark, f"{gaps},{empty}", rows_per_partition=1).collect()) == ["b", "d"]


def test_a_growing_table_is_followed(spark, tmp_path):
    path = made(tmp_path / "log.db", ROWS[:2])
    other = made(tmp_path / "other.db", [])

    def run():
        stream = follow_sqlite(spark, f"{path},{other}", rows_per_partition=1, columns=("log_id", "latency_ms"))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).format("parquet").option("path", str(tmp_path / "out")).start().awaitTermination()
        return sorted(r.log_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["a", "b"]
    assert run() == ["a", "b"]
    made(path, ROWS[2:])
    made(other, [("e", None, None, None, None, None)])
    assert run() == ["a", "b", "c", "d", "e"]
