"""Prompts as Python's ``json.dumps`` writes them."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from callgauge.functions import exchanges


def prompts(spark, bodies):
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, body string").repartition(4)
    found = rows.select("i", exchanges.prompt_of(exchanges.parsed(F.col("body")), F.col("body")).alias("p"))
    return [r.p for r in found.orderBy("i").collect()]


def drawn(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind == 0:
        return rng.choice([True, False, None])
    if kind == 1:
        return rng.choice([0, -1, 7, 10**9, -(2**63), 2**63, 10**25])
    if kind == 2:
        return rng.choice([rng.uniform(-9, 9) * 10.0 ** rng.randint(-12, 25), float(rng.randint(-(10**8), 10**8)), rng.random() * 10.0 ** rng.randint(-300, 300), 1e16, 1e-4, 9.999e15, 1e-5, 0.0, -0.0, 1e22])
    if kind < 6:
        return "".join(rng.choice(['"', "\\", "/", "\n", "\t", "\b", "\f", "\r", "\x00", "\x1f", "\x7f", "é", "日", "😀", " ", "\\u00e9", ",", ":", "a b", "[1.5E7]", "{", "}"]) for _ in range(rng.randrange(9)))
    if kind == 6:
        return [drawn(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"{rng.choice('zyxa,:é')}{i}": drawn(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("ascii_only", [True, False])
@pytest.mark.parametrize("separators", [None, (",", ":")])
def test_equal_to_python(spark, ascii_only, separators):
    rng = random.Random(7)
    wanted = [[{"role": "user", "content": drawn(rng)}, drawn(rng)] for _ in range(1500)]
    bodies = [json.dumps({"model": "m", "messages": m}, ensure_ascii=ascii_only, separators=separators) for m in wanted]
    for body, found, m in zip(bodies, prompts(spark, bodies), wanted):
        assert found == json.dumps(m)[:4000], body


def test_edges(spark):
    cases = {
        '{"messages":"hi \\"é\\" \\ud83d\\ude00"}': json.dumps('hi "é" 😀'),
        '{"messages":true}': "true",
        '{"messages":1.50}': "1.5",
        '{"messages":[{"t":"\\ud800x"}]}': '[{"t": "\\ud800x"}]',
        ' {"messages" : [ ] , "prompt" : "é"} ': "é",
        '{"messages":[1,': "",
        '{"messages":null}': "",
        '{"messages":["' + "é" * 3000 + '"]}': json.dumps(["é" * 3000])[:4000],
        '{"messages":["' + "a" * 5_000_000 + '"]}': '["' + "a" * 3998,
        '{"messages":[' + "1e7," * 3000 + "1]}": json.dumps([1e7] * 3000)[:4000],
        '{"messages":[' + "1e22," * 3000 + "1]}": json.dumps([1e22] * 3000)[:4000],
    }
    assert prompts(spark, list(cases)) == list(cases.values())


def test_numbers(spark):
    rng = random.Random(3)
    values = [v for v in (rng.choice([1, -1]) * rng.random() * 10.0 ** rng.randint(-307, 307) for _ in range(5000)) if math.isfinite(v)]
    values += [round(rng.uniform(-1e6, 1e6), rng.randint(0, 9)) for _ in range(5000)] + [float(10**i) for i in range(23)] + [10.0**-i for i in range(12)]
    assert prompts(spark, [f'{{"messages":[{v!r}]}}' for v in values]) == [json.dumps([v]) for v in values]
