"""Queries over the monitoring tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import answers, exchanges, json_checks
from ..operators import grading, metrics, normalize, reads, sampling, selection
from ..schemas import RAW_EXCHANGES
from ..sources import tasks as task_sets
from ..sources.sqlite_source import follow_sqlite, read_sqlite, write_sqlite
from ..sources.store import CallStore
from ..streaming import capture, rates
from . import views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query under its function's name; ``sql`` may use call_log, exchanges, graded and refusal_tasks."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = _with_views(sql)
        return f

    return keep


def _strict(text: str) -> str:
    return f"coalesce({text} <> '' AND json_valid({text}), false)"


def _recovered(text: str) -> str:
    candidates = [f"trim({text})", f"nullif(regexp_extract({text}, '```(?:json)?\\s*(.*?)\\s*```', 1, 's'), '')", f"nullif(regexp_extract({text}, '\\{{.*\\}}', 0, 's'), '')", f"nullif(regexp_extract({text}, '\\[.*\\]', 0, 's'), '')"]
    return "coalesce(" + ", ".join(f"CASE WHEN {_strict(c)} THEN {c} END" for c in candidates) + ")"


_LETTER = r"list_filter(list_transform(regexp_split_to_array(translate(response_text, '.,', '  '), '\s+'), lambda t: upper(trim(t, '()[]:'))), lambda t: t IN ('A', 'B', 'C', 'D'))[1]"
_REFUSAL = "coalesce(regexp_matches(response_text, '" + "|".join(answers.REFUSALS).replace("'", "''") + "', 'i'), false)"
_TYPE = lambda path, *names: "coalesce(json_type(v, '" + path + "') IN (" + ", ".join(f"'{n}'" for n in names) + "), false)"
_STR, _INT = ("VARCHAR",), ("BIGINT", "UBIGINT")
_VALID = {
    "format_flat_object": f"{_TYPE('$.name', *_STR)} AND {_TYPE('$.age', *_INT)} AND {_TYPE('$.occupation', *_STR)}",
    "format_array_of_strings": f"coalesce(json_array_length(v) = 3, false) AND {_TYPE('$[0]', *_STR)} AND {_TYPE('$[1]', *_STR)} AND {_TYPE('$[2]', *_STR)}",
    "format_nested_object": f"{_TYPE('$.title', *_STR)} AND {_TYPE('$.author', *_STR)} AND {_TYPE('$.publication.year', *_INT)} AND {_TYPE('$.publication.publisher', *_STR)}",
    "format_enum_field": "coalesce(json_extract_string(v, '$.status') IN ('active', 'inactive', 'pending'), false)",
    "format_array_of_objects": "coalesce(json_array_length(v) = 3, false) AND " + " AND ".join(f"{_TYPE(f'$[{i}].{k}', *_STR)}" for i in range(3) for k in ("name", "color")),
    "format_boolean_nullable": f"{_TYPE('$.title', *_STR)} AND {_TYPE('$.completed', 'BOOLEAN')} AND {_TYPE('$.due_date', 'VARCHAR', 'NULL')}",
}
_GRADED = (
    "SELECT *, CASE WHEN outcome = 'ok' THEN CASE WHEN CASE"
    + f" WHEN eval_task_type = 'accuracy' THEN coalesce({_LETTER} = substr('ABCD', CAST(slot % 4 + 1 AS BIGINT), 1), false)"
    + "".join(f" WHEN eval_task_id = '{k}' THEN {v}" for k, v in _VALID.items())
    + f" ELSE {_REFUSAL} END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS eval_score FROM (SELECT *, {_recovered('response_text')} AS v FROM call_log)"
)


def _with_views(sql: str) -> str:
    parts = {"call_log": views.duck(views.CALL_LOG), "exchanges": views.duck(views.EXCHANGES), "refusal_tasks": views.REFUSAL_TASKS, "graded": _GRADED}
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in parts.items()) + " " + sql


def _choice_tasks(spark: SparkSession) -> DataFrame:
    return spark.range(20).select(F.concat(F.lit("choice_"), F.col("id").cast("string")).alias("task_id"), (F.col("id") % 4).cast("int").alias("correct_index"))


def graded_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The call log with its scores, in one pass."""
    return grading.grade_calls(views.call_log(spark, sf_dir), _choice_tasks(spark), task_sets.FORMAT_TASKS)


@query("SELECT log_id, eval_task_type, eval_score FROM graded UNION ALL SELECT log_id, eval_task_type, eval_score FROM graded WHERE eval_task_type = 'refusal'")
def batches_together(spark, sf_dir):
    """The three kinds of task graded apart and brought together, repeats included."""
    calls = views.call_log(spark, sf_dir)
    of = lambda kind: calls.filter(F.col("eval_task_type") == kind)
    refusals = grading.grade_refusals(of("refusal"))
    parts = grading.grade_accuracy(of("accuracy"), _choice_tasks(spark)), grading.grade_format(of("format"), task_sets.FORMAT_TASKS), refusals, refusals
    return grading.union_batches(*(p.select("log_id", "eval_task_type", "eval_score") for p in parts))


# Normalization


@query("SELECT log_id, host FROM exchanges WHERE host IN ('api.groq.com', 'openrouter.ai', 'api.openai.com', 'api.anthropic.com')")
def host_allowlist(spark, sf_dir):
    return views.exchanges(spark, sf_dir).filter(exchanges.host_allowed(F.col("host"))).select("log_id", "host")


@query("SELECT log_id, provider FROM call_log")
def provider_classify(spark, sf_dir):
    return views.call_log(spark, sf_dir).select("log_id", exchanges.normal_provider(exchanges.provider_of(F.col("host"))).alias("provider"))


@query("SELECT log_id, CASE WHEN status = 200 THEN 'ok' WHEN status = 429 THEN 'rate_limited' ELSE 'error' END AS outcome FROM exchanges WHERE status IS NOT NULL")
def outcome_from_status(spark, sf_dir):
    return views.exchanges(spark, sf_dir).filter("status IS NOT NULL").select("log_id", exchanges.outcome_of_status(F.col("status")).alias("outcome"))


def _bodies(spark, sf_dir):
    return views.exchanges(spark, sf_dir).select("log_id", "event_id", "request_body", exchanges.parsed(F.col("request_body")).alias("request"), exchanges.parsed(F.col("response_body")).alias("response"))


_REQ, _RESP = ("CASE WHEN json_valid({0}_body) AND json_type({0}_body) = 'OBJECT' THEN {0}_body END".format(x) for x in ("request", "response"))


@query(f"SELECT log_id, coalesce(json_extract_string({_REQ}, '$.model'), json_extract_string({_RESP}, '$.model'), 'unknown') AS model_id FROM exchanges")
def model_id_coalesce(spark, sf_dir):
    return _bodies(spark, sf_dir).select("log_id", exchanges.model_id(F.col("request"), F.col("response")).alias("model_id"))


_DUMPED = "list_aggregate(list_transform(regexp_extract_all({0}, '\"(?:[^\"\\\\]|\\\\.)*\"|[,:]|[^\",:]+'), lambda t: CASE WHEN t IN (',', ':') THEN t || ' ' ELSE t END), 'string_agg', '')"


@query(f"SELECT log_id, coalesce({_DUMPED.format(f"CAST(json_extract({_REQ}, '$.messages') AS VARCHAR)")}, json_extract_string({_REQ}, '$.prompt'), '') AS prompt FROM exchanges")
def request_prompt(spark, sf_dir):
    return _bodies(spark, sf_dir).select("log_id", exchanges.prompt_of(F.col("request"), F.col("request_body")).alias("prompt"))


_CHARACTER = r"""CASE WHEN c = '"' THEN '\"' WHEN c = '\' THEN '\\' WHEN c = chr(8) THEN '\b' WHEN c = chr(9) THEN '\t' WHEN c = chr(10) THEN '\n' WHEN c = chr(12) THEN '\f' WHEN c = chr(13) THEN '\r'
WHEN unicode(c) BETWEEN 32 AND 126 THEN c WHEN unicode(c) < 65536 THEN printf('\u%04x', unicode(c)) ELSE printf('\u%04x\u%04x', 55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024) END"""


@query(f"""SELECT doc_id, left('[{{"role": "user", "n_chars": ' || n_chars || ', "content": "' || coalesce(list_aggregate(list_transform(string_split(text, ''), lambda c: {_CHARACTER}), 'string_agg', ''), '') || '"}}]', {exchanges.TEXT_CAP}) AS prompt FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL""")
def prompt_dumps(spark, sf_dir):
    said = F.array(F.struct(F.lit("user").alias("role"), "n_chars", F.col("text").alias("content")))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text IS NOT NULL AND n_chars IS NOT NULL")
    bodies = docs.select("doc_id", F.to_json(F.struct(F.lit("m").alias("model"), said.alias("messages"))).alias("body"))
    return bodies.select("doc_id", exchanges.prompt_of(exchanges.parsed(F.col("body")), F.col("body")).alias("prompt"))


@query(f"SELECT log_id, CAST(json_extract({_REQ}, '$.temperature') AS BIGINT) AS temperature, CAST(json_extract({_REQ}, '$.max_tokens') AS BIGINT) AS max_tokens, false AS has_content FROM exchanges")
def request_params(spark, sf_dir):
    found = _bodies(spark, sf_dir).select("log_id", exchanges.request_parameters(F.col("request")).alias("p"))
    number = lambda k: F.get_json_object("p", f"$.{k}").cast("bigint").alias(k)
    content = F.coalesce(F.get_json_object("p", "$.model"), F.get_json_object("p", "$.messages"), F.get_json_object("p", "$.prompt")).isNotNull()
    return found.select("log_id", number("temperature"), number("max_tokens"), content.alias("has_content"))


@query(f"""SELECT log_id, CASE WHEN json_exists({_RESP}, '$.choices[0].message') THEN CASE WHEN json_exists({_RESP}, '$.choices[0].message.content') THEN json_extract_string({_RESP}, '$.choices[0].message.content') ELSE '' END
ELSE json_extract_string({_RESP}, '$.choices[0].text') END AS response_text FROM exchanges""")
def response_text(spark, sf_dir):
    return _bodies(spark, sf_dir).select("log_id", exchanges.response_text(F.col("response")).alias("response_text"))


@query(f"SELECT log_id, CAST(json_extract({_RESP}, '$.usage.prompt_tokens') AS BIGINT) AS prompt_tokens, CAST(json_extract({_RESP}, '$.usage.completion_tokens') AS BIGINT) AS completion_tokens FROM exchanges")
def token_counts(spark, sf_dir):
    return _bodies(spark, sf_dir).select("log_id", *(exchanges.token_count(F.col("response"), n).alias(n) for n in ("prompt_tokens", "completion_tokens")))


@query(f"SELECT log_id, coalesce(json_extract_string({_RESP}, '$.error.message'), json_extract_string({_RESP}, '$.error'), 'none') AS error_message FROM exchanges WHERE status <> 200")
def error_message(spark, sf_dir):
    failed = views.exchanges(spark, sf_dir).filter("status <> 200").select("log_id", exchanges.parsed(F.col("response_body")).alias("response"))
    return failed.select("log_id", exchanges.error_message(F.col("response"), F.lit("none")).alias("error_message"))


@query(f"""SELECT log_id, timestamp, 'proxy' AS integration_path,
CASE WHEN host LIKE '%groq%' THEN 'groq' WHEN host LIKE '%openrouter%' THEN 'openrouter' WHEN host LIKE '%openai%' THEN 'openai' ELSE 'anthropic' END AS provider,
CASE WHEN status IS NULL THEN 'timeout' WHEN status = 200 THEN 'ok' WHEN status = 429 THEN 'rate_limited' ELSE 'error' END AS outcome,
CASE WHEN status IS NULL THEN exception_message WHEN status <> 200 THEN coalesce(json_extract_string({_RESP}, '$.error.message'), json_extract_string({_RESP}, '$.error')) END AS error_message,
latency_ms, CAST(json_extract({_RESP}, '$.usage.prompt_tokens') AS BIGINT) AS prompt_tokens FROM exchanges WHERE host <> 'example.com' AND event_id % 29 <> 0""")
def normalize_calls(spark, sf_dir):
    calls, _ = normalize.normalize_exchanges(views.exchanges(spark, sf_dir), integration_path="proxy")
    return calls.select("log_id", "timestamp", "integration_path", "provider", "outcome", "error_message", "latency_ms", "prompt_tokens")


@query("SELECT log_id, request_body, 'request body is not an object' AS reason FROM exchanges WHERE host <> 'example.com' AND event_id % 29 = 0")
def quarantined_calls(spark, sf_dir):
    return normalize.normalize_exchanges(views.exchanges(spark, sf_dir))[1].select("log_id", "request_body", "reason")


@query("SELECT log_id, CASE WHEN status IS NULL THEN 'timeout' WHEN status = 429 THEN 'rate_limited' WHEN status = 200 AND event_id % 7 <> 2 THEN 'ok' ELSE 'error' END AS outcome, CASE WHEN status IS NULL THEN exception_message WHEN status = 429 THEN 'HTTP 429: ' || response_body WHEN status <> 200 OR event_id % 7 = 2 THEN 'failed' END AS error_message FROM exchanges")
def direct_calls(spark, sf_dir):
    raw = views.exchanges(spark, sf_dir)
    readable = exchanges.is_object(exchanges.parsed(F.col("response_body")))
    met = raw.withColumn("outcome", exchanges.direct_outcome(F.col("status"), F.col("exception_kind"), readable))
    message = F.coalesce("exception_message", F.lit("failed"))
    return met.select("log_id", "outcome", exchanges.direct_error(F.col("outcome"), F.col("response_body"), message).alias("error_message"))


@query("""SELECT log_id, '{"model":"' || model_id || '","messages":[{"role":"user","content":"q' || log_id || '"}],"temperature":0}' AS payload FROM call_log""")
def chat_payload(spark, sf_dir):
    prompt = F.concat(F.lit("q"), F.col("log_id"))
    return views.call_log(spark, sf_dir).select("log_id", exchanges.chat_payload(F.col("model_id"), prompt, {"temperature": 0}).alias("payload"))


# Grading


@query(f"""SELECT p_partkey, p_type || chr(10) || chr(10) || 'A. ' || p_brand || chr(10) || 'B. ' || p_type || chr(10) || 'C. ' || CAST(p_size AS VARCHAR) || chr(10) || chr(10) || '{answers.INSTRUCTION}' AS prompt FROM part""")
def mmlu_prompt(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", answers.choice_prompt(F.col("p_type"), F.array("p_brand", "p_type", F.col("p_size").cast("string"))).alias("prompt"))


@query(f"SELECT log_id, {_LETTER} AS letter FROM call_log")
def answer_letter(spark, sf_dir):
    return views.call_log(spark, sf_dir).select("log_id", answers.answer_letter(F.col("response_text")).alias("letter"))


@query("SELECT log_id, eval_score FROM graded WHERE eval_task_type = 'accuracy'")
def accuracy_score(spark, sf_dir):
    return grading.grade_accuracy(views.call_log(spark, sf_dir), _choice_tasks(spark)).select("log_id", "eval_score")


@query(f"SELECT log_id, {_strict('response_text')} AS strict FROM call_log")
def strict_json(spark, sf_dir):
    return views.call_log(spark, sf_dir).select("log_id", json_checks.is_strict_json(F.col("response_text")).alias("strict"))


@query(f"SELECT log_id, coalesce(json_type({_recovered('response_text')}), 'none') AS kind FROM call_log")
def extract_json(spark, sf_dir):
    value = json_checks.extract_json(F.col("response_text"))
    found = views.call_log(spark, sf_dir).select("log_id", F.schema_of_variant(value).alias("k"))
    return found.select("log_id", F.when(F.col("k").startswith("OBJECT"), "OBJECT").when(F.col("k").startswith("ARRAY"), "ARRAY").when(F.col("k").isNull(), "none").otherwise(F.col("k")).alias("kind"))


def _schema_query(task: dict) -> None:
    def run(spark, sf_dir):
        calls = views.call_log(spark, sf_dir).withColumn("value", json_checks.extract_json(F.col("response_text")))
        return calls.select("log_id", json_checks.format_passed(F.col("value"), task["schema"]).alias("valid"))

    run.__name__ = task["task_id"].replace("format_", "schema_")
    query(f"SELECT log_id, {_VALID[task['task_id']]} AS valid FROM (SELECT log_id, {_recovered('response_text')} AS v FROM call_log)")(run)


for _task in task_sets.FORMAT_TASKS:
    _schema_query(_task)


@query("SELECT log_id, eval_score FROM graded WHERE eval_task_type = 'format'")
def format_score(spark, sf_dir):
    calls = views.call_log(spark, sf_dir).filter("eval_task_type = 'format'")
    return grading.grade_format(calls, task_sets.FORMAT_TASKS).select("log_id", "eval_score")


@query(f"SELECT log_id, {_REFUSAL} AS refused FROM call_log")
def is_refusal(spark, sf_dir):
    return views.call_log(spark, sf_dir).select("log_id", answers.is_refusal(F.col("response_text")).alias("refused"))


@query("SELECT log_id, eval_score FROM graded WHERE eval_task_type = 'refusal'")
def refusal_score(spark, sf_dir):
    return grading.grade_refusals(views.call_log(spark, sf_dir).filter("eval_task_type = 'refusal'")).select("log_id", "eval_score")


# Rates and points

_RUN = "eval_run_id, provider, model_id"


def _rate(spark, sf_dir, value):
    return graded_calls(spark, sf_dir).groupBy("eval_run_id", "provider").agg(F.round(value, 9).alias("rate"))


@query("SELECT eval_run_id, provider, round(avg(eval_score) FILTER (WHERE eval_task_type = 'accuracy'), 9) AS rate FROM graded GROUP BY ALL")
def accuracy_rate(spark, sf_dir):
    return _rate(spark, sf_dir, metrics.rate_of("accuracy"))


@query("SELECT eval_run_id, provider, round(avg(eval_score) FILTER (WHERE eval_task_type = 'format'), 9) AS rate FROM graded GROUP BY ALL")
def format_rate(spark, sf_dir):
    return _rate(spark, sf_dir, metrics.rate_of("format"))


@query(f"SELECT eval_run_id, provider, round(avg(CAST({_strict('response_text')} AS DOUBLE)) FILTER (WHERE eval_task_type = 'format' AND outcome = 'ok'), 9) AS rate FROM call_log GROUP BY ALL")
def strict_rate(spark, sf_dir):
    return views.call_log(spark, sf_dir).groupBy("eval_run_id", "provider").agg(F.round(metrics.strict_rate(), 9).alias("rate"))


def _refusal_query(subset: str, condition: str) -> None:
    def run(spark, sf_dir):
        flagged = metrics.with_task_flags(graded_calls(spark, sf_dir), views.refusal_tasks(spark))
        return flagged.groupBy("eval_run_id", "provider").agg(F.round(metrics.rate_of("refusal", metrics.subset_filter(subset)), 9).alias("rate"))

    run.__name__ = f"refusal_rate_{subset}"
    query(f"SELECT eval_run_id, provider, round(avg(eval_score) FILTER (WHERE eval_task_type = 'refusal' AND {condition}), 9) AS rate FROM graded LEFT JOIN refusal_tasks ON eval_task_id = task_id GROUP BY ALL")(run)


for _subset, _condition in (("safe", "should_refuse IS NOT DISTINCT FROM false"), ("unsafe", "should_refuse IS NOT DISTINCT FROM true"), ("all", "true")):
    _refusal_query(_subset, _condition)


@query("SELECT provider, round(quantile_cont(latency_ms, 0.5), 6) AS p50, round(quantile_cont(latency_ms, 0.95), 6) AS p95 FROM call_log GROUP BY provider")
def latency_percentiles(spark, sf_dir):
    found = selection.percentiles(views.call_log(spark, sf_dir), ["provider"], "latency_ms")
    p = F.col("percentiles")
    return found.select("provider", F.round(F.get(p, F.lit(0)), 6).alias("p50"), F.round(F.get(p, F.lit(1)), 6).alias("p95"))


_POINTS = f"""SELECT eval_run_id AS run_id, provider, model_id, max(timestamp) AS timestamp, round(avg(eval_score) FILTER (WHERE eval_task_type = 'accuracy'), 9) AS accuracy,
round(avg(eval_score) FILTER (WHERE eval_task_type = 'format'), 9) AS format_adherence, round(avg(eval_score) FILTER (WHERE eval_task_type = 'refusal' AND should_refuse IS NOT DISTINCT FROM false), 9) AS refusal_rate,
round(quantile_cont(latency_ms, 0.5), 6) AS latency_p50_ms, round(quantile_cont(latency_ms, 0.95), 6) AS latency_p95_ms, CAST(count(*) AS INTEGER) AS n_calls
FROM graded LEFT JOIN refusal_tasks ON eval_task_id = task_id GROUP BY {_RUN}"""


def _rounded(points: DataFrame) -> DataFrame:
    return points.select("run_id", "provider", "model_id", "timestamp", *(F.round(c, 9).alias(c) for c in ("accuracy", "format_adherence", "refusal_rate")), *(F.round(c, 6).alias(c) for c in ("latency_p50_ms", "latency_p95_ms")), "n_calls")


@query(_POINTS)
def metric_points(spark, sf_dir):
    return _rounded(metrics.metric_points(graded_calls(spark, sf_dir), views.refusal_tasks(spark)))


# Reads


@query(f"SELECT run_id, timestamp, n_calls, accuracy FROM ({_POINTS}) WHERE provider = 'groq' AND model_id = 'm1' ORDER BY timestamp, run_id")
def metric_series(spark, sf_dir):
    return reads.metric_series(metric_points(spark, sf_dir), "groq", "m1").select("run_id", "timestamp", "n_calls", "accuracy")


@query("SELECT log_id, timestamp, provider, outcome, latency_ms FROM call_log WHERE eval_run_id = 'run_2024-01-07'")
def logs_for_run(spark, sf_dir):
    return reads.logs_for_run(views.call_log(spark, sf_dir), "run_2024-01-07").select("log_id", "timestamp", "provider", "outcome", "latency_ms")


@query("SELECT log_id, timestamp, response_text FROM call_log WHERE provider = 'openai' AND model_id = 'm2' AND timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00' ORDER BY timestamp, log_id LIMIT 5")
def exemplars(spark, sf_dir):
    from datetime import datetime

    start, end = (F.lit(datetime(2024, 1, d)).cast("timestamp_ntz") for d in (5, 9))
    return reads.exemplars(views.call_log(spark, sf_dir), "openai", "m2", start, end).select("log_id", "timestamp", "response_text")


_EVENTS = "SELECT event_id AS id, timestamp AS detected_at, provider, latency_ms / 1000 AS p_value_raw, coalesce(latency_ms < 20, false) AS significant, user_id % 2 = 0 AS reviewed FROM {call_log}"


def _events(spark, sf_dir):
    calls = views.call_log(spark, sf_dir)
    return calls.select(F.col("event_id").alias("id"), F.col("timestamp").alias("detected_at"), "provider", (F.col("latency_ms") / 1000).alias("p_value_raw"), F.coalesce(F.col("latency_ms") < 20, F.lit(False)).alias("significant"), (F.col("user_id") % 2 == 0).alias("reviewed"))


@query(f"SELECT * FROM ({_EVENTS.replace('{call_log}', 'call_log')}) WHERE significant AND NOT reviewed ORDER BY detected_at DESC, id")
def open_events(spark, sf_dir):
    return reads.open_events(_events(spark, sf_dir))


@query("SELECT log_id, timestamp, latency_ms FROM call_log WHERE provider = 'groq' AND outcome = 'error' ORDER BY timestamp DESC, log_id LIMIT 10")
def inspect_recent(spark, sf_dir):
    return reads.inspect_calls(views.call_log(spark, sf_dir), provider="groq", outcome="error").select("log_id", "timestamp", "latency_ms")


@query("SELECT log_id, provider, outcome FROM call_log WHERE outcome = 'ok' UNION ALL SELECT log_id, provider, outcome FROM call_log WHERE outcome = 'error' UNION ALL SELECT log_id, provider, outcome FROM call_log WHERE outcome = 'error'")
def union_batches(spark, sf_dir):
    calls = views.call_log(spark, sf_dir).select("log_id", "provider", "outcome")
    failed = calls.filter("outcome = 'error'")
    return grading.union_batches(calls.filter("outcome = 'ok'"), failed, failed)


@query("SELECT task_id, should_refuse, t.provider, t.model_id FROM refusal_tasks CROSS JOIN (SELECT DISTINCT provider, model_id FROM call_log) t")
def task_cross_targets(spark, sf_dir):
    return grading.assign_tasks(views.refusal_tasks(spark), views.call_log(spark, sf_dir).select("provider", "model_id").distinct())


@query("SELECT log_id, timestamp, provider FROM call_log")
def dedupe_log(spark, sf_dir):
    calls = views.call_log(spark, sf_dir).select("log_id", "timestamp", "provider")
    return reads.deduplicated(calls.unionByName(calls))


# Sampling and rates

_MIX = "(doc_id * 2654435761) % 1000003"


@query(f"SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {_MIX}, doc_id) - 1 AS rank FROM documents) WHERE rank < 5")
def stratified_sample(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    return sampling.stratified_sample(docs, "lang", "doc_id", order=F.expr(_MIX)).select("lang", "doc_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"""SELECT doc_id, type, should_refuse, CASE WHEN should_refuse THEN 'xstest_unsafe_' ELSE 'xstest_safe_' END || CAST(rank AS VARCHAR) AS task_id FROM (
SELECT *, row_number() OVER (PARTITION BY should_refuse ORDER BY {_MIX}, doc_id) - 1 AS rank FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'contrast_' || lang ELSE lang END AS type, doc_id % 5 = 0 AS should_refuse FROM documents))
WHERE rank < CASE WHEN should_refuse THEN 1 ELSE 5 END""")
def xstest_split(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("contrast_"), "lang")).otherwise(F.col("lang")).alias("type"))
    return sampling.refusal_split(docs, "doc_id", order=F.expr(_MIX)).select("doc_id", "type", "should_refuse", "task_id")


@query("SELECT log_id, provider, count(*) OVER (PARTITION BY provider ORDER BY timestamp RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS calls_in_window FROM call_log")
def rolling_rate(spark, sf_dir):
    return metrics.rolling_rate(views.call_log(spark, sf_dir).select("log_id", "provider", "timestamp")).select("log_id", "provider", "calls_in_window")


@query(f"""SELECT id, provider, round(least(1.0, min(p_value_raw * m / r) OVER (PARTITION BY provider ORDER BY r DESC ROWS UNBOUNDED PRECEDING)), 9) AS p_value_corrected FROM (
SELECT *, count(p_value_raw) OVER (PARTITION BY provider) AS m, row_number() OVER (PARTITION BY provider ORDER BY p_value_raw NULLS LAST, id) AS r FROM ({_EVENTS.replace('{call_log}', 'call_log')}))""")
def bh_adjust(spark, sf_dir):
    tests = _events(spark, sf_dir).select("id", "provider", "p_value_raw")
    return metrics.bh_adjust(tests, ["provider"]).select("id", "provider", F.round("p_value_corrected", 9).alias("p_value_corrected"))


# Streams and stores


def _scratch(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; a temporary one in local mode only."""
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='callgauge-')}/{uuid.uuid4().hex}"


@query("SELECT log_id, timestamp, 'proxy' AS integration_path, provider, outcome, latency_ms FROM call_log WHERE host <> 'example.com' AND event_id % 29 <> 0")
def captured_calls(spark, sf_dir):
    """Exchanges that went through the capturing stream, all of them twice, into a store."""
    where = _scratch(spark)
    raw = views.exchanges(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    columns = [c.split() for c in RAW_EXCHANGES.split(", ")]
    raw = raw.select(*(F.col(n).cast(t) for n, t in columns))
    raw.unionByName(raw).write.parquet(f"{where}/in")
    store = CallStore(spark, f"{where}/store")
    capture.capture(capture.read_exchanges(spark, f"{where}/in", "parquet"), store, f"{where}/checkpoint", integration_path="proxy", late="60 days", trigger={"availableNow": True}).awaitTermination()
    return store.calls().select("log_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "integration_path", "provider", "outcome", "latency_ms")


@query("""SELECT log_id, provider, calls_in_window FROM (SELECT *, count(*) OVER (PARTITION BY provider ORDER BY timestamp RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS calls_in_window,
max(timestamp) OVER () - INTERVAL 10 MINUTES AS watermark FROM call_log) WHERE (floor(epoch(timestamp) / 60) + 1) * 60 <= epoch(watermark)""")
def streamed_rates(spark, sf_dir):
    """Calls in the minute up to each call, counted by the stream; the stretches that its watermark has passed."""
    where, (setting, rocks) = _scratch(spark), rates.STATE_STORE
    calls = views.call_log(spark, sf_dir).select("log_id", "provider", F.col("timestamp").cast("timestamp").alias("timestamp"))
    calls.write.parquet(f"{where}/in")
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, rocks)
    try:
        found = rates.calls_in_window(spark.readStream.schema(calls.schema).parquet(f"{where}/in"), 60, "10 minutes")
        found.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).format("parquet").start(f"{where}/out").awaitTermination()
    finally:
        spark.conf.set(setting, before) if before else spark.conf.unset(setting)
    return spark.read.schema(found.schema).parquet(f"{where}/out").select("log_id", "provider", "calls_in_window")


@query(_POINTS)
def run_once_points(spark, sf_dir):
    """Points of graded calls that came in two batches of the evaluating stream, the runs divided between them."""
    where = _scratch(spark)
    graded = normalize.with_defaults(graded_calls(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    half, store = F.pmod(F.xxhash64("log_id"), F.lit(2)), CallStore(spark, f"{where}/store")
    for k in (0, 1):  # the second run of the stream finds the files of the first read
        graded.filter(half == k).write.mode("append").parquet(f"{where}/in")
        arrived = spark.readStream.schema(graded.schema).parquet(f"{where}/in")
        capture.run_forever(arrived, views.refusal_tasks(spark), store, f"{where}/checkpoint", 0).awaitTermination()
    points = store.table("metric_series").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return _rounded(points.drop("id"))


_MONTHS_RUN = "concat('run_', cast(extract(month FROM timestamp) AS STRING))"


@query(_POINTS.replace("FROM graded LEFT JOIN", f"FROM (SELECT * REPLACE ({_MONTHS_RUN.replace('STRING', 'VARCHAR')} AS eval_run_id) FROM graded) LEFT JOIN"))
def late_batches_points(spark, sf_dir):
    """Points of runs of a month whose calls come in two batches, of every other day each and out of order, one of them twice: out of the stored states, no call is read again."""
    store = CallStore(spark, _scratch(spark))
    graded = graded_calls(spark, sf_dir).withColumn("eval_run_id", F.expr(_MONTHS_RUN))
    graded = normalize.with_defaults(graded.withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    part = F.pmod(F.dayofmonth("timestamp"), F.lit(2))
    for k in (1, 0, 1):
        capture.run_once(graded.filter(part == k), views.refusal_tasks(spark), store, f"batch {k}")
    points = store.table("metric_series").withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    return _rounded(points.drop("id"))


@query("SELECT log_id, min(timestamp) AS timestamp FROM (SELECT log_id, timestamp FROM call_log UNION ALL SELECT log_id, timestamp + INTERVAL 1 DAY FROM call_log WHERE event_id % 3 = 0) GROUP BY log_id")
def keyed_calls(spark, sf_dir):
    """Calls that come in two batches, a third of them again a day later: each log_id is stored once over all days."""
    store = CallStore(spark, _scratch(spark))
    calls = views.call_log(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    again = calls.filter("event_id % 3 = 0").withColumn("timestamp", F.expr("timestamp + INTERVAL 1 DAY"))
    for batch in (calls, again):
        store.write_calls(normalize.with_defaults(batch))
    return store.calls().select("log_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query("SELECT log_id, timestamp, provider, model_id, outcome, latency_ms, eval_run_id, eval_task_type FROM call_log WHERE outcome <> 'timeout'")
def sqlite_scan(spark, sf_dir):
    """The call log out of SQLite files that tasks wrote, read in several ranges; the condition and the wanted columns are in the files' own queries."""
    folder = _scratch(spark).removeprefix("file:")
    calls = normalize.with_defaults(views.call_log(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    files = write_sqlite(calls, folder)
    wanted = ("log_id", "timestamp", "provider", "model_id", "outcome", "latency_ms", "eval_run_id", "eval_task_type")
    found = read_sqlite(spark, ",".join(files), rows_per_partition=500, columns=wanted, where=(("outcome", "!=", "timeout"),))
    return found.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


@query("SELECT provider, count(*) AS n, count(latency_ms) AS n_timed FROM call_log GROUP BY provider")
def followed_sqlite(spark, sf_dir):
    """The call log that a stream took out of SQLite files in two runs, with a restart between them."""
    where = _scratch(spark).removeprefix("file:")
    files = write_sqlite(normalize.with_defaults(views.call_log(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp"))), f"{where}/in")
    arrived = follow_sqlite(spark, ",".join(files), rows_per_partition=500, columns=("log_id", "provider", "latency_ms"))
    for _ in range(2):  # the second run finds all of it read
        arrived.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{where}/out").start().awaitTermination()
    read = spark.read.schema(arrived.schema).parquet(f"{where}/out")
    return read.groupBy("provider").agg(F.count("*").alias("n"), F.count("latency_ms").alias("n_timed"))


@query(_POINTS)
def stream_metric_points(spark, sf_dir):
    """The points of calls that went through a stream into a folder, one availableNow run."""
    graded, where = graded_calls(spark, sf_dir), _scratch(spark)
    graded.write.parquet(f"{where}/in")
    arrived = spark.readStream.schema(graded.schema).parquet(f"{where}/in")
    arrived.writeStream.option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).format("parquet").option("path", f"{where}/out").start().awaitTermination()
    return _rounded(metrics.metric_points(spark.read.schema(graded.schema).parquet(f"{where}/out"), views.refusal_tasks(spark)))


@query("SELECT log_id, provider, outcome FROM call_log WHERE timestamp BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-09 00:00:00'")
def stored_calls(spark, sf_dir):
    """Calls written to a store twice are there once, and a time range reads only its days."""
    store = CallStore(spark, _scratch(spark))
    calls = normalize.with_defaults(views.call_log(spark, sf_dir).withColumn("timestamp", F.col("timestamp").cast("timestamp")))
    for _ in range(2):
        store.write_calls(calls)
    return store.calls("2024-01-05 00:00:00", "2024-01-09 00:00:00").select("log_id", "provider", "outcome")


@query("SELECT * FROM refusal_tasks")
def freeze_once(spark, sf_dir):
    path, tasks = _scratch(spark), views.refusal_tasks(spark)
    task_sets.freeze(tasks, path)
    return task_sets.freeze(tasks.limit(1), path)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
