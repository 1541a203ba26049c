"""Relations derived from the test tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: A call log over ``events``; see FIXTURES.md.
CALL_LOG = """
SELECT cast(event_id AS STRING) AS log_id, ts AS timestamp, event_id, user_id, event_id % 32 AS slot, 'eval_suite' AS integration_path,
  CASE event_type WHEN 'click' THEN 'api.groq.com' WHEN 'view' THEN 'openrouter.ai' WHEN 'purchase' THEN 'api.openai.com' WHEN 'signup' THEN 'api.anthropic.com' ELSE 'example.com' END AS host,
  CASE event_type WHEN 'click' THEN 'groq' WHEN 'view' THEN 'openrouter' WHEN 'purchase' THEN 'openai' WHEN 'signup' THEN 'anthropic' ELSE 'example.com' END AS provider,
  concat('m', cast(user_id % 3 AS STRING)) AS model_id,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 19 = 0 THEN 429 WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS status,
  CASE WHEN event_id % 23 = 0 THEN 'timeout' WHEN event_id % 19 = 0 THEN 'rate_limited' WHEN event_id % 17 = 0 THEN 'error' ELSE 'ok' END AS outcome,
  CASE WHEN event_id % 31 = 0 THEN NULL ELSE value END AS latency_ms,
  concat('run_', cast(cast(ts AS DATE) AS STRING)) AS eval_run_id,
  CASE WHEN event_id % 32 < 20 THEN 'accuracy' WHEN event_id % 32 < 26 THEN 'format' ELSE 'refusal' END AS eval_task_type,
  CASE WHEN event_id % 32 < 20 THEN concat('choice_', cast(event_id % 32 AS STRING))
    WHEN event_id % 32 = 20 THEN 'format_flat_object' WHEN event_id % 32 = 21 THEN 'format_array_of_strings' WHEN event_id % 32 = 22 THEN 'format_nested_object'
    WHEN event_id % 32 = 23 THEN 'format_enum_field' WHEN event_id % 32 = 24 THEN 'format_array_of_objects' WHEN event_id % 32 = 25 THEN 'format_boolean_nullable'
    ELSE concat('refusal_', cast(event_id % 32 - 26 AS STRING)) END AS eval_task_id,
  CASE (event_id + user_id) % 16 WHEN 0 THEN 'A' WHEN 1 THEN 'The answer is B.' WHEN 2 THEN '(C)' WHEN 3 THEN 'I cannot help with that.' WHEN 4 THEN 'I''m unable to say'
    WHEN 5 THEN '{"name":"Ada","age":28,"occupation":"eng"}' WHEN 6 THEN concat('Sure:', chr(10), '```json', chr(10), '{"status":"active"}', chr(10), '```')
    WHEN 7 THEN '' WHEN 8 THEN NULL WHEN 9 THEN '["red","green","blue"]'
    WHEN 10 THEN '{"title":"t","author":"a","publication":{"year":1999,"publisher":"p"}}' WHEN 11 THEN 'list [{"name":"a","color":"b"},{"name":"c","color":"d"},{"name":"e","color":"f"}] end'
    WHEN 12 THEN '{"title":"t","completed":false,"due_date":null}' WHEN 13 THEN '{"name":"Ada","age":28.5,"occupation":"eng"} tail'
    WHEN 14 THEN '{"title":"t","completed":"false","due_date":null}' ELSE '[d]: as an AI, it cannot be' END AS response_text,
  props
FROM {events}
"""

#: Flags of the refusal slots: five safe ones and one unsafe.
REFUSAL_TASKS = "SELECT * FROM (VALUES ('refusal_0', false), ('refusal_1', false), ('refusal_2', false), ('refusal_3', false), ('refusal_4', false), ('refusal_5', true)) AS t(task_id, should_refuse)"

#: Raw exchanges over the call log.
EXCHANGES = """
SELECT log_id, timestamp, event_id, host, status, latency_ms, CASE WHEN status IS NULL THEN 'timeout' END AS exception_kind, CASE WHEN status IS NULL THEN 'read timed out' END AS exception_message,
  CASE WHEN event_id % 29 = 0 THEN '[1]' WHEN event_id % 13 = 0 THEN concat('{"prompt":"q', log_id, '","max_tokens":', cast(user_id AS STRING), '}')
    ELSE concat('{"model":"', model_id, '","messages":[{"role":"user"}],"temperature":', cast(event_id % 3 AS STRING), ',"stream":true}') END AS request_body,
  CASE WHEN status IS NULL THEN NULL
    WHEN status <> 200 THEN CASE event_id % 3 WHEN 0 THEN concat('{"error":{"message":"bad ', log_id, '"}}') WHEN 1 THEN '{"error":"plain"}' ELSE '[1,2]' END
    WHEN event_id % 7 = 0 THEN concat('{"choices":[{"text":"t', log_id, '"}]}') WHEN event_id % 7 = 1 THEN '{"model":"srv","choices":[{"message":{"role":"assistant"}}],"usage":{}}'
    WHEN event_id % 7 = 2 THEN 'not json' WHEN event_id % 7 = 3 THEN '{"choices":[{"message":{"content":null}}]}'
    ELSE concat('{"model":"srv","choices":[{"message":{"role":"assistant","content":"hi ', log_id, '"}}],"usage":{"prompt_tokens":', cast(event_id % 50 AS STRING), ',"completion_tokens":3}}') END AS response_body
FROM ({call_log}) c
"""


def duck(text: str) -> str:
    """A view's text for DuckDB."""
    return text.replace("{call_log}", CALL_LOG).replace("{events}", "events")


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_events(spark, sf_dir, CALL_LOG)


def exchanges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _over_events(spark, sf_dir, EXCHANGES.replace("{call_log}", CALL_LOG))


def refusal_tasks(spark: SparkSession) -> DataFrame:
    return spark.sql(REFUSAL_TASKS)


def _over_events(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # for the JSON checks
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.createOrReplaceTempView("callgauge_events")
    return spark.sql(text.replace("{events}", "callgauge_events"))
