"""Exact quantiles against sorted values."""

import math

import numpy as np
import pytest

from riskstream.operators import quantiles as Q
from riskstream.operators.ab import latency_p95


def want(values, q):
    v = sorted(x for x in values if x is not None and math.isfinite(x))
    if not v:
        return None
    at = q * (len(v) - 1)
    lo = math.floor(at)
    return (1 - (at - lo)) * v[lo] + (at - lo) * v[min(lo + 1, len(v) - 1)]


@pytest.mark.parametrize("cells", [16, 1024])
def test_equals_sorting(spark, monkeypatch, cells):
    monkeypatch.setattr(Q, "CELLS", cells)
    rng = np.random.default_rng(3)
    groups = {"exp": rng.exponential(1, 300) ** 3, "int": rng.integers(0, 4, 200).astype(float), "one": [7.5], "same": [1.25] * 50,
              "wide": [-1.7e308, 1.7e308, 0.0, 5e-324, -5e-324], "two": [1.0, 2.0], None: [3.0, 1.0, float("nan"), None, float("inf")],
              "none": [None]}
    df = spark.createDataFrame([(g, float(x) if x is not None else None) for g, v in groups.items() for x in v], "g string, x double")
    for q in (0.5, 0.95) if cells == 16 else (0.0, 0.95, 1.0):
        got = {r.g: r.quantile for r in Q.quantiles(df, "x", q, ["g"]).collect()}
        assert set(got) == set(groups) - {"none"}
        for g, v in got.items():
            assert v == pytest.approx(want(groups[g], q), rel=1e-12), (g, q)


def test_no_groups_and_no_values(spark):
    df = spark.range(1001).selectExpr("cast(id as decimal(8,2)) / 10 as x")
    assert Q.quantile(df, "x", 0.95) == pytest.approx(95.0)
    assert Q.quantile(df.where("x < 0"), "x", 0.95) is None


def test_a_round_counts_cells_and_not_values(spark):
    df = spark.range(200_000).selectExpr("cast(id as double) as v", "0 as g", "1L as w")
    state = spark.createDataFrame([(0, 200_000, 100_000, 0.0, 0.0, 199_999.0, 0, 200_000, None)],
                                  "g int, n long, rank long, part double, lo double, hi double, before long, inside long, above double")
    r = Q._narrowed(df, state, ["g"]).first()
    assert r["inside"] <= 200_000 / Q.CELLS + 1 and r["lo"] <= 100_000 <= r["hi"]


def test_null_versions_keep_their_row(spark):
    m = spark.createDataFrame([("a", 1.0), ("a", 2.0), (None, 3.0), ("b", None)], "model_version string, latency_ms double")
    assert sorted((tuple(r) for r in latency_p95(m).collect()), key=repr) == sorted([("a", 1.95, 2), (None, 3.0, 1), ("b", None, 1)], key=repr)


def test_weights_count_as_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (2.0, 16), (9.0, 0)], "x double, n int")
    for q in (0.1, 0.5, 0.9, 0.97):
        assert Q.quantile(df, "x", q, "n") == pytest.approx(want([1.0] * 3 + [2.0] * 16 + [5.0], q))
