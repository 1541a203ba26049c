"""Command line: show the newest calls, or evaluate graded calls into metric points."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .functions.exchanges import shortened, shown_parameters
from .operators.reads import inspect_calls
from .sources.store import CallStore
from .sources.tasks import refusal_tasks
from .streaming.capture import run_forever


def display_line() -> Column:
    """A call as lines of text; empty fields are left out."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    plain = [line(n, F.coalesce(F.col(n).cast("string"), F.lit("-"))) for n in ("log_id", "timestamp", "integration_path", "provider", "model_id", "outcome", "latency_ms")]
    texts = [line(n, F.when(F.col(n) != "", shortened(F.col(n)))) for n in ("prompt", "response_text")]
    rest = [line("request_params", shown_parameters(F.col("request_params_json"))), line("error_message", F.col("error_message")), line("eval_run_id", F.concat_ws(" ", "eval_run_id", "eval_task_type", F.col("eval_score").cast("string")))]
    return F.concat_ws("\n", *plain, *texts, *rest)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="callgauge", description=__doc__)
    parser.add_argument("--store", required=True)
    commands = parser.add_subparsers(dest="command", required=True)
    show = commands.add_parser("inspect")
    for name in ("--integration-path", "--provider", "--outcome"):
        show.add_argument(name)
    show.add_argument("--limit", type=int, default=10)
    run = commands.add_parser("run")
    run.add_argument("--provider", choices=["groq", "openrouter"], required=True)
    run.add_argument("--model", required=True)
    run.add_argument("--calls", required=True, help="folder of graded calls (Parquet)")
    run.add_argument("--refusal-tasks", required=True)
    run.add_argument("--interval-seconds", type=int, default=0)
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.variant.allowDuplicateKeys", "true").getOrCreate()
    try:
        store = CallStore(spark, given.store)
        if given.command == "inspect":
            found = inspect_calls(store.calls(), given.integration_path, given.provider, given.outcome, given.limit)
            found.select(display_line().alias("call")).show(max(given.limit, 20), truncate=False)
            return 0
        calls = spark.readStream.schema(store.calls().schema).parquet(given.calls).filter((F.col("provider") == given.provider) & (F.col("model_id") == given.model))
        run_forever(calls, refusal_tasks(spark, given.refusal_tasks), store, f"{given.store}/checkpoint", given.interval_seconds).awaitTermination()
        return 0
    except AnalysisException as error:
        print(error, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
