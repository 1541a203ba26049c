"""Raw exchanges to the call log: one scan, one filter on the host before any parsing, one projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exchanges as X
from ..schemas import CALL_LOG


def normalize_exchanges(raw: DataFrame, hosts: Iterable[str] | None = None, integration_path: str = "wrapper", exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(calls, quarantine) of raw exchanges whose host is allowed.

    raw: see ``schemas.RAW_EXCHANGES``. Requests that are JSON but no object go to the quarantine with a
    reason; a response that is no object only loses its fields.
    """
    read = raw.filter(X.host_allowed(F.col("host"), hosts, exact)).withColumns({"request": X.parsed(F.col("request_body")), "response": X.parsed(F.col("response_body"))})
    usable = F.col("request").isNull() | X.is_object(F.col("request"))
    quarantine = read.filter(~usable).select("log_id", "timestamp", "host", "request_body", F.lit("request body is not an object").alias("reason"))
    response = F.when(X.is_object(F.col("response")), F.col("response"))
    failed = F.col("exception_kind").isNotNull()
    outcome = F.when(F.col("exception_kind") == "timeout", "timeout").when(failed, "error").otherwise(X.outcome_of_status(F.col("status")))
    error = F.when(failed, F.col("exception_message")).when(outcome != "ok", X.error_message(response, F.lit(None).cast("string")))
    calls = read.filter(usable).select(
        F.coalesce("log_id", F.uuid()).alias("log_id"),
        "timestamp",
        F.lit(integration_path).alias("integration_path"),
        X.normal_provider(X.provider_of(F.col("host"))).alias("provider"),
        X.model_id(F.col("request"), response).alias("model_id"),
        X.prompt_of(F.col("request"), F.col("request_body")).alias("prompt"),
        F.when(~failed, X.response_text(response)).alias("response_text"),
        X.request_parameters(F.col("request")).alias("request_params_json"),
        outcome.alias("outcome"),
        error.alias("error_message"),
        F.col("latency_ms").cast("double").alias("latency_ms"),
        X.token_count(response, "prompt_tokens").alias("prompt_tokens"),
        X.token_count(response, "completion_tokens").alias("completion_tokens"),
        F.lit(None).cast("string").alias("eval_run_id"),
        F.lit(None).cast("string").alias("eval_task_type"),
        F.lit(None).cast("string").alias("eval_task_id"),
        F.lit(None).cast("double").alias("eval_score"),
    )
    return calls, quarantine


def with_defaults(calls: DataFrame) -> DataFrame:
    """The columns of the call log that ``calls`` lacks, at their defaults."""
    given = {"log_id": F.uuid(), "timestamp": F.current_timestamp(), "outcome": F.lit("ok"), "request_params_json": F.lit("{}")}
    out = []
    for column in CALL_LOG.split(", "):
        name, kind = column.split()
        out.append(F.col(name) if name in calls.columns else given.get(name, F.lit(None)).cast(kind).alias(name))
    return calls.select(*out)
