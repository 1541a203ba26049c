import json
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from callgauge.functions import answers, exchanges, json_checks
from callgauge.sources.tasks import FORMAT_TASKS


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")
    return [r[0] for r in rows.withColumn("o", make(F.col("t"))).orderBy("i").select("o").collect()]


LETTERS = [("A", "A"), ("The answer is B.", "B"), ("(C)", "C"), ("a", "A"), ("It is a trick; B", "A"), ("", None), (None, None), ("**D**", None), ("Answer:B", None), ("[d]: because", "D"), ("B) x", "B"), ("A,B", "A"), ("x B", "B")]
REFUSALS = [("I can't do", True), ("I CANNOT", True), ("Im sorry but I", True), ("As an AI model it cannot", True), ("as an AI, I\ncannot", False), ("I’m sorry, but I", False), ("Hi cannot", False), ("I'm sorry but in", False), ("I will  not", False), ("éi cannot", False), ("i cannoté", False), ("İ cannot", True), ("ı cannot", True), ("", False), (None, False)]
STRICT = [('{"a":1}', True), ('{"a":1} tail', False), ('{"a":1}{"b":2}', False), ("null", True), ("1", True), ('"x"', True), ("[]", True), ("", False), (None, False), ("1,2", False), ("1],[2", False), ('{"a":1,"a":2}', True), ('{"a":1}//c', False), (' {"a":1}\n', True)]
RECOVERED = [('```json\n{"a":1}\n```', {"a": 1}), ('```JSON\n{"a":1}\n```', {"a": 1}), ('list [{"a":1}] end', {"a": 1}), ('list [{"a":1},{"b":2}] end', [{"a": 1}, {"b": 2}]), ("} {", None), ('pre {"a":1} mid {"b":2}', None), (None, None)]


@pytest.mark.parametrize("cases, make", [(LETTERS, answers.answer_letter), (REFUSALS, answers.is_refusal), (STRICT, json_checks.is_strict_json)])
def test_truth_tables(spark, cases, make):
    assert column(spark, [c for c, _ in cases], make) == [w for _, w in cases]


def test_recovery(spark):
    found = column(spark, [c for c, _ in RECOVERED], lambda t: F.to_json(json_checks.extract_json(t)))
    assert [json.loads(x) if x else None for x in found] == [w for _, w in RECOVERED]


def test_letters_against_python(spark):
    rng, parts = random.Random(4), ["A", "b", "(c)", "[D]:", ".", ",", " ", "\n", "x", "AB", " ", ":", "is"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) for _ in range(800)]

    def plain(text):
        tokens = [t.strip("()[]:").upper() for t in text.replace(".", " ").replace(",", " ").split()]
        return next((t for t in tokens if t in ("A", "B", "C", "D")), None)

    assert column(spark, texts, answers.answer_letter) == [plain(t) for t in texts]


def test_refusals_against_python(spark):
    rng, parts = random.Random(5), ["I", "i'm", "can't", "cannot", " ", " ", "as an AI", "not", "will", "unable to", "\n", "refuse to", "!"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(800)]
    plain = re.compile("|".join(answers.REFUSALS), re.I)
    assert column(spark, texts, answers.is_refusal) == [bool(plain.search(t)) for t in texts]


SCHEMA_CASES = [
    ("format_flat_object", '{"name":"n","age":%s,"occupation":"o"}', [("28", True), ("28.0", True), ("1e2", True), ("9" * 20, True), ("28.5", False), ('"28"', False), ("true", False), ("null", False), ("1e400", False)]),
    ("format_boolean_nullable", '{"title":"t",%s}', [('"completed":true,"due_date":null', True), ('"completed":true,"due_date":"d"', True), ('"completed":true', False), ('"completed":"false","due_date":null', False)]),
    ("format_array_of_objects", "%s", [('[{"name":"a","color":"b"},{"name":"a","color":"b"},{"name":"a","color":"b","x":1}]', True), ('[{"name":"a","color":"b"},{"name":"a"},{"name":"a","color":"b"}]', False), ("[]", False), ('["a","b","c"]', False), ('{"name":"a"}', False)]),
    ("format_enum_field", '{"status":%s}', [('"active"', True), ('"done"', False), ("null", False)]),
    ("format_array_of_strings", "%s", [('["a","b","c"]', True), ('["a","b"]', False), ('["a","b",1]', False)]),
    ("format_nested_object", '{"title":"t","author":"a","publication":%s}', [('{"year":1,"publisher":"p"}', True), ('{"year":1}', False), ("[]", False)]),
]


@pytest.mark.parametrize("task_id, frame, cases", SCHEMA_CASES)
def test_schemas(spark, task_id, frame, cases):
    schema = next(t["schema"] for t in FORMAT_TASKS if t["task_id"] == task_id)
    rows = spark.createDataFrame([(i, frame % c) for i, (c, _) in enumerate(cases)], "i int, t string").withColumn("v", json_checks.extract_json(F.col("t")))
    assert [r[0] for r in rows.orderBy("i").select(json_checks.format_passed(F.col("v"), schema)).collect()] == [w for _, w in cases]


def test_shortened(spark):
    texts = ["a  b\nc", "word " * 40, "x" * 200, "it is " * 19 + "longer than that", ""]
    assert column(spark, [*texts, None], exchanges.shortened) == [*(textwrap.shorten(t, 120) for t in texts), None]


def test_outcomes_and_providers(spark):
    assert column(spark, [200, 299, 429, 199, 301, 408, 500], exchanges.outcome_of_status, "int") == ["ok", "ok", "rate_limited", "error", "error", "error", "error"]
    assert column(spark, ["api.groq.com", "x.openai.com", "elsewhere"], exchanges.provider_of) == ["groq", "openai", "elsewhere"]
    assert column(spark, ["api.openai.com.example.net", "example.com", None], exchanges.host_allowed) == [True, False, False]
