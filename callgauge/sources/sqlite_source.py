"""SQLite tables as a batch source and as a stream; needs only the standard library on the executors.

``spark.read.format("callgauge_sqlite")`` with ``path`` and ``table`` (log_rows) reads in ranges of rowid, in Arrow batches. ``columns`` are the only ones selected, and conditions of ``where`` become bound
parameters of the file's own query. They are options of the source, as Spark 4.1 tells a Python source no columns, and keeps the first query's filters for later queries of the same frame where
its own filter push-down is switched on, which loses rows; this source takes no part in that.
``spark.readStream`` with the same options follows a table that grows: offsets are rowids, so each row arrives once, after a restart too.
The file must be on a path that every executor sees; ``path`` may name several files, separated by commas. Times in the file are ISO texts in UTC, all with or all without fractions of a second.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..schemas import CALL_LOG

ROWS_PER_PARTITION = 200_000
#: Rows of one Arrow batch.
BATCH = 5_000
#: A condition: column, operator, and a value (a list for in and not in, none for is null and is not null).
Condition = tuple
_TEXT = {"startswith": "substr({0}, 1, length(?1)) = ?1", "endswith": "(?1 = '' OR substr({0}, -length(?1)) = ?1)", "contains": "instr({0}, ?1) > 0"}


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def opened(path: str) -> closing:
    return closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True))


def condition(column: str, operator: str, value=None, timed: bool = False) -> tuple[str, list]:
    """An SQL condition and its parameters; like Spark's, none but is null holds for a null. timed: the column holds times."""
    name = quoted(column)
    if operator in ("is null", "is not null"):
        return f"{name} {operator.upper()}", []
    name = f"replace({name}, 'T', ' ')" if timed else name
    if operator in ("in", "not in"):
        return f"{name} {operator.upper()} ({', '.join('?' * len(value))})", list(value)
    if operator in ("=", "!=", "<", "<=", ">", ">="):
        return f"{name} {operator} ?", [value]
    if operator in _TEXT:
        text = _TEXT[operator].format(name)
        return f"{name} IS NOT NULL AND {text.replace('?1', '?')}", [value] * text.count("?1")
    raise ValueError(f"no operator {operator!r}")


def _plain(value):
    """A value as JSON holds it; times as the files do."""
    if isinstance(value, datetime):
        return (value.astimezone(timezone.utc) if value.tzinfo else value).strftime("%Y-%m-%d %H:%M:%S.%f")
    return [_plain(v) for v in value] if isinstance(value, (list, tuple, set, frozenset)) else value


class Rows(InputPartition):
    """Rows of a file with ``low`` <= rowid < ``high``."""

    def __init__(self, path: str, low: int, high: int) -> None:
        self.path, self.low, self.high = path, low, high


class _Table:
    """What batch and stream share."""

    def __init__(self, schema: StructType, options) -> None:
        self.schema, self.paths, self.table = schema, options["path"].split(","), options.get("table", "log_rows")
        self.rows = int(options.get("rowsperpartition", options.get("rowsPerPartition", ROWS_PER_PARTITION)))
        kinds = dict(c.split() for c in CALL_LOG.split(", ")) | {f.name: f.dataType.typeName() for f in schema.fields}
        self.where = [condition(*c, timed=kinds.get(c[0]) == "timestamp") for c in json.loads(options.get("where", "[]"))]

    def ranges(self, path: str, low: int, high: int) -> list[Rows]:
        return [Rows(path, a, min(a + self.rows, high)) for a in range(low, high, self.rows)]

    def ends(self, path: str) -> tuple[int, int]:
        """The least and the largest rowid; 1 and 0 of an empty table."""
        with opened(path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        return (1, 0) if low is None else (low, high)

    def statement(self, rows: Rows) -> tuple[str, list]:
        columns = ", ".join(quoted(f.name) for f in self.schema.fields)
        parts = [("rowid >= ? AND rowid < ?", [rows.low, rows.high]), *self.where]
        return f"SELECT {columns} FROM {quoted(self.table)} WHERE " + " AND ".join(f"({c})" for c, _ in parts), [p for _, ps in parts for p in ps]

    def batches(self, rows: Rows) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(self.schema)

        def cell(v, kind):
            if v is None:
                return None
            if kind == "timestamp":
                found = datetime.fromisoformat(v)
                return found if found.tzinfo else found.replace(tzinfo=timezone.utc)
            return float(v) if kind in ("double", "float") else str(v) if kind == "string" else bool(v) if kind == "boolean" else v

        kinds = [f.dataType.typeName() for f in self.schema.fields]
        with opened(rows.path) as db:
            cursor = db.execute(*self.statement(rows))
            while some := cursor.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([cell(v, k) for v in c], f.type) for c, k, f in zip(zip(*some), kinds, schema)], schema=schema)


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options) -> None:
        self.of = _Table(schema, options)

    def partitions(self) -> list[InputPartition]:
        found = []
        for path in self.of.paths:
            low, high = self.of.ends(path)
            found += self.of.ranges(path, low, high + 1)
        return found or [Rows(self.of.paths[0], 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        yield from self.of.batches(partition)


class SqliteStream(DataSourceStreamReader):
    """Offsets are, for each file, the rowid up to which rows have been read. Rows must be appended with growing rowids, as SQLite does while none of the last ones is deleted."""

    def __init__(self, schema: StructType, options) -> None:
        self.of = _Table(schema, options)

    def initialOffset(self) -> dict:
        return {path: self.of.ends(path)[0] - 1 for path in self.of.paths}

    def latestOffset(self) -> dict:
        return {path: self.of.ends(path)[1] for path in self.of.paths}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [r for path, to in end.items() for r in self.of.ranges(path, start.get(path, 0) + 1, to + 1)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        yield from self.of.batches(partition)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "callgauge_sqlite"

    def schema(self) -> str:
        wanted = [c.strip() for c in self.options.get("columns", "").split(",") if c.strip()]
        kinds = dict(c.split() for c in CALL_LOG.split(", "))
        return ", ".join(f"{c} {kinds[c]}" for c in wanted or kinds)

    def reader(self, schema: StructType) -> SqliteReader:
        return SqliteReader(schema, self.options)

    def streamReader(self, schema: StructType) -> SqliteStream:
        return SqliteStream(schema, self.options)


def _set_up(spark: SparkSession, reader, path: str, table: str, schema: str | None, rows_per_partition: int, columns: tuple[str, ...], where: tuple[Condition, ...]):
    spark.dataSource.register(SqliteSource)
    conditions = json.dumps([[_plain(x) if i == 2 else x for i, x in enumerate(c)] for c in where])
    reader = reader.format("callgauge_sqlite").option("path", path).option("table", table).option("rowsPerPartition", rows_per_partition).option("where", conditions)
    if columns and not schema:
        reader = reader.option("columns", ",".join(columns))
    return (reader.schema(schema) if schema else reader).load()


def read_sqlite(spark: SparkSession, path: str, table: str = "log_rows", schema: str | None = None, rows_per_partition: int = ROWS_PER_PARTITION, columns: tuple[str, ...] = (), where: tuple[Condition, ...] = ()) -> DataFrame:
    """The table's rows that all conditions of ``where`` hold for, such as ("provider", "=", "groq"); ``columns`` are the only ones read, if they are given."""
    return _set_up(spark, spark.read, path, table, schema, rows_per_partition, columns, where)


def follow_sqlite(spark: SparkSession, path: str, table: str = "log_rows", schema: str | None = None, rows_per_partition: int = ROWS_PER_PARTITION, columns: tuple[str, ...] = (), where: tuple[Condition, ...] = ()) -> DataFrame:
    """A stream of the table's rows, from its beginning on."""
    return _set_up(spark, spark.readStream, path, table, schema, rows_per_partition, columns, where)


def write_sqlite(calls: DataFrame, folder: str, table: str = "log_rows") -> list[str]:
    """Writes ``calls`` as one SQLite file for each of their partitions into ``folder``, which every executor sees, and returns the files' paths.

    Each task fills a file of its own and renames it at its end, so a task that runs again puts the same in its place.
    """
    import os

    names = calls.columns
    times = [f.name for f in calls.schema.fields if f.dataType.typeName() == "timestamp"]
    texts = calls.withColumns({c: calls[c].cast("timestamp_ntz").cast("string") for c in times}) if times else calls

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(folder, exist_ok=True)
        path = f"{folder}/part-{task.partitionId():05d}.db"
        at = f"{path}.{task.taskAttemptId()}"
        with closing(sqlite3.connect(at)) as db, db:
            db.execute(f"CREATE TABLE {quoted(table)} ({', '.join(map(quoted, names))})")
            for batch in batches:
                db.executemany(f"INSERT INTO {quoted(table)} VALUES ({', '.join('?' * len(names))})", zip(*(c.to_pylist() for c in batch.columns)))
        os.replace(at, path)
        yield pa.RecordBatch.from_pydict({"path": [path]})

    return sorted(r.path for r in texts.mapInArrow(fill, "path string").collect())  # one for each partition
