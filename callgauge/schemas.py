"""Schemas of the tables, as Spark DDL, and the values of the enumerated columns."""

from __future__ import annotations

CALL_LOG = (
    "log_id string, timestamp timestamp, integration_path string, provider string, model_id string, prompt string, response_text string, "
    "request_params_json string, outcome string, error_message string, latency_ms double, prompt_tokens bigint, completion_tokens bigint, "
    "eval_run_id string, eval_task_type string, eval_task_id string, eval_score double"
)
METRIC_SERIES = "id bigint, run_id string, timestamp timestamp, provider string, model_id string, accuracy double, format_adherence double, refusal_rate double, latency_p50_ms double, latency_p95_ms double, n_calls int"
CHANGEPOINT_EVENTS = (
    "id bigint, detected_at timestamp, provider string, model_id string, metric_name string, detector string, changepoint_timestamp timestamp, pre_mean double, "
    "post_mean double, p_value_raw double, p_value_corrected double, significant boolean, drift_type string, remediation string, reviewed boolean"
)
#: What is kept of a batch's graded calls: sums and counts of each run, and how often each latency came.
RUN_STATE = (
    "batch_id string, attempt bigint, run_id string, provider string, model_id string, last_at timestamp, accuracy_sum double, accuracy_n bigint, "
    "format_sum double, format_n bigint, refusal_sum double, refusal_n bigint, n_calls bigint"
)
RUN_LATENCIES = "batch_id string, attempt bigint, run_id string, provider string, model_id string, latency_ms double, n bigint"
RAW_EXCHANGES = "log_id string, timestamp timestamp, host string, request_body string, response_body string, status int, exception_kind string, exception_message string, latency_ms double"
CHOICE_TASKS = "task_id string, subject string, question string, choices array<string>, correct_index int"
REFUSAL_TASKS = "task_id string, prompt string, type string, should_refuse boolean"
FORMAT_TASKS = "task_id string, prompt string, schema string"

INTEGRATION_PATHS = ("wrapper", "proxy", "eval_suite")
OUTCOMES = ("ok", "error", "timeout", "rate_limited")
TASK_TYPES = ("accuracy", "format", "refusal")
