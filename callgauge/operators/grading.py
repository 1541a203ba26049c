"""Tasks meet targets and responses; responses get their scores."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers, json_checks


def assign_tasks(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """Every task for every (provider, model_id, eval_run_id) to evaluate: all pairs are the result."""
    return tasks.crossJoin(targets)


def grade_accuracy(calls: DataFrame, tasks: DataFrame) -> DataFrame:
    """Calls of multiple-choice tasks with eval_score; tasks: task_id, correct_index."""
    keyed = tasks.select(F.col("task_id").alias("eval_task_id"), "correct_index")
    score = answers.accuracy_score(F.col("outcome"), F.col("response_text"), F.col("correct_index"))
    return calls.drop("eval_score").join(keyed, "eval_task_id").withColumn("eval_score", score).drop("correct_index")


def grade_format(calls: DataFrame, tasks: list[dict]) -> DataFrame:
    """Calls of format tasks with eval_score; each task's schema (a dict or JSON) is compiled into the expression."""
    read = calls.withColumn("_value", json_checks.extract_json(F.col("response_text")))
    return read.withColumn("eval_score", answers.if_ok(F.col("outcome"), _format_passed(F.col("_value"), tasks))).drop("_value")


def _format_passed(value: Column, tasks: list[dict]) -> Column:
    passed = F.when(F.lit(False), F.lit(False))
    for task in tasks:
        schema = json.loads(task["schema"]) if isinstance(task["schema"], str) else task["schema"]
        passed = passed.when(F.col("eval_task_id") == task["task_id"], json_checks.format_passed(value, schema))
    return passed


def grade_refusals(calls: DataFrame) -> DataFrame:
    return calls.withColumn("eval_score", answers.refusal_score(F.col("outcome"), F.col("response_text")))


def grade_calls(calls: DataFrame, choice_tasks: DataFrame, format_tasks: list[dict]) -> DataFrame:
    """Calls of all three types with eval_score, in one pass; null where the task or its type is unknown."""
    keyed = choice_tasks.select(F.col("task_id").alias("eval_task_id"), "correct_index")
    met = calls.drop("eval_score").join(keyed, "eval_task_id", "left")
    of_format = F.when(F.col("eval_task_type") == "format", F.col("response_text"))
    read = met.withColumn("_value", json_checks.extract_json(of_format))
    choice = F.when(F.col("correct_index").isNotNull(), answers.accuracy_score(F.col("outcome"), F.col("response_text"), F.col("correct_index")))
    score = F.when(F.col("eval_task_type") == "accuracy", choice).when(F.col("eval_task_type") == "format", answers.if_ok(F.col("outcome"), _format_passed(F.col("_value"), format_tasks)))
    score = score.when(F.col("eval_task_type") == "refusal", answers.refusal_score(F.col("outcome"), F.col("response_text")))
    return read.withColumn("eval_score", score).drop("_value", "correct_index")


def union_batches(*batches: DataFrame) -> DataFrame:
    """The batches' rows together, repeats included."""
    first, *rest = batches
    for batch in rest:
        first = first.unionByName(batch)
    return first
