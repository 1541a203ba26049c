"""Task sets: the format tasks written out, frozen sets in JSON files, and the sink that freezes them once."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas

_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}


def _object(**properties) -> dict:
    return {"type": "object", "properties": properties, "required": list(properties)}


#: Fixed: the format tasks' ids and the shapes their answers must have. The prompts are our own words.
FORMAT_TASKS = [
    {"task_id": "format_flat_object", "prompt": "Reply with nothing but a JSON object about a person, with name, age (a whole number) and occupation.", "schema": _object(name=_TEXT, age=_WHOLE, occupation=_TEXT)},
    {"task_id": "format_array_of_strings", "prompt": "Reply with nothing but a JSON array of the names of three colours.", "schema": {"type": "array", "items": _TEXT, "minItems": 3, "maxItems": 3}},
    {"task_id": "format_nested_object", "prompt": "Reply with nothing but a JSON object about a book: title, author, and publication with year (a whole number) and publisher.", "schema": _object(title=_TEXT, author=_TEXT, publication=_object(year=_WHOLE, publisher=_TEXT))},
    {"task_id": "format_enum_field", "prompt": "Reply with nothing but a JSON object whose key status is active, inactive or pending.", "schema": _object(status={"type": "string", "enum": ["active", "inactive", "pending"]})},
    {"task_id": "format_array_of_objects", "prompt": "Reply with nothing but a JSON array of three fruits, each an object of name and color.", "schema": {"type": "array", "items": _object(name=_TEXT, color=_TEXT), "minItems": 3, "maxItems": 3}},
    {"task_id": "format_boolean_nullable", "prompt": "Reply with nothing but a JSON object about an open task: title, completed (a boolean) and due_date (a string or null).", "schema": _object(title=_TEXT, completed={"type": "boolean"}, due_date={"type": ["string", "null"]})},
]


def format_tasks(spark: SparkSession) -> DataFrame:
    rows = [(t["task_id"], t["prompt"], json.dumps(t["schema"])) for t in FORMAT_TASKS]
    return spark.createDataFrame(rows, schemas.FORMAT_TASKS)


def choice_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A frozen multiple-choice set."""
    return spark.read.schema(schemas.CHOICE_TASKS).json(path, multiLine=True)


def refusal_tasks(spark: SparkSession, path: str) -> DataFrame:
    """A frozen set of prompts to answer or refuse."""
    return spark.read.schema(schemas.REFUSAL_TASKS).json(path, multiLine=True)


def dataset(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None) -> DataFrame:
    """A file of any source that Spark reads, to sample task sets from."""
    reader = spark.read.format(kind)
    return (reader.schema(schema) if schema else reader).load(path)


def freeze(tasks: DataFrame, path: str) -> DataFrame:
    """The task set as first written to ``path``, one JSON array; a later call reads what is there and writes nothing.

    ``choice_tasks`` and ``refusal_tasks`` read what was frozen. A task set is a few dozen rows, which meet in one.
    """
    whole = tasks.agg(F.to_json(F.array_sort(F.collect_list(F.struct("*")))).alias("value"))
    whole.coalesce(1).write.mode("ignore").text(path)
    return tasks.sparkSession.read.schema(tasks.schema).json(path, multiLine=True)
