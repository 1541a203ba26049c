import random

import numpy as np
import pytest

from callgauge.operators import selection


@pytest.mark.parametrize("how", [{}, {"bins": 16}, {"few": 1000}])
def test_percentiles_are_those_of_sorted_values(spark, monkeypatch, how):
    rng = random.Random(1)
    groups = {
        "even": [rng.random() for _ in range(500)],
        "outlier": [rng.gauss(0, 1) for _ in range(300)] + [1e300, -1e300, 1e300],
        "one": [7.0],
        "two": [1.0, 2.0],
        "same": [3.5] * 50,
        "steps": [float(rng.randrange(5)) for _ in range(400)],
        "near": [1.0 + i * 2**-52 for i in range(40)],
        None: [float(i) for i in range(100)],
        "none": [None] * 5,
    }
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    rng.shuffle(rows)
    at = (0.0, 0.5, 0.95, 1.0)
    monkeypatch.setattr(selection, "FEW", how.pop("few", 0))
    monkeypatch.setattr(selection, "BROADCAST_RANGES", 0 if how else 10**6)  # groups dealt over tasks, or ranges broadcast
    found = {r["of"]: r for r in selection.percentiles(spark.createDataFrame(rows, "of string, latency double"), ["of"], "latency", at, **how).collect()}
    assert set(found) == set(groups)
    for g, vs in groups.items():
        real = [v for v in vs if v is not None]
        assert found[g].n == len(real)
        assert (found[g].percentiles is None) if not real else np.allclose(found[g].percentiles, np.quantile(real, at), rtol=1e-12, atol=0), (g, found[g].percentiles)


def test_weights_and_no_groups(spark):
    rows = spark.createDataFrame([(1.0, 3), (2.0, 0), (4.0, 1), (9.0, None)], "v double, n int")
    r = selection.percentiles(rows, [], "v", (0.5, 0.95), weight="n").first()
    assert (r.n, round(r.percentiles[0], 9), round(r.percentiles[1], 9)) == (4, 1.0, 3.55)
    assert selection.percentiles(rows.limit(0), ["n"], "v").count() == 0


def test_no_group_meets_in_one_task(spark, monkeypatch):
    """Partial counts stand before every shuffle of the values, and no aggregate collects them."""
    monkeypatch.setattr(selection, "FEW", 1000)
    rows = spark.range(20_000).selectExpr("id % 2 AS k", "cast(id * 7 % 1009 AS double) AS v")
    plan = selection.percentiles(rows, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "collect_list(struct(_rank" in plan
