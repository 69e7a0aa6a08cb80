"""Probabilistic union, routing and the full scorer."""

import math
from functools import reduce

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskstream.config import REFERENCE
from riskstream.functions import prob_union
from riskstream.operators import scoring


def union_py(sevs):
    if not sevs:
        return 0
    p = reduce(lambda a, s: a * (1.0 - s / 100.0), sevs, 1.0)
    return min(round((1.0 - p) * 100), 100)


def spark_union(spark, rows):
    n = max(len(r) for r in rows) if rows else 0
    cols = [f"s{i}" for i in range(n)]
    df = spark.createDataFrame([tuple(list(r) + [None] * (n - len(r))) for r in rows], ", ".join(f"{c} int" for c in cols))
    return [r[0] for r in df.select(prob_union([F.col(c) for c in cols])).collect()]


def test_goldens(spark):
    assert spark_union(spark, [[60, 60], [95], [60, 50], [100, 10], [50, 50]]) == [84, 95, 80, 100, 75]


def test_route_cuts(spark):
    df = spark.createDataFrame([(80,), (79,), (30,), (29,), (0,)], "score int")
    got = [r[0] for r in df.select(scoring.route(F.col("score"), REFERENCE)).collect()]
    assert got == ["block", "review", "review", "allow", "allow"]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 100), min_size=1, max_size=5), min_size=1, max_size=20))
def test_union_matches_python_fold(spark, rows):
    assert spark_union(spark, rows) == [union_py(r) for r in rows]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 100), min_size=1, max_size=6), st.integers(0, 100))
def test_union_properties(sevs, extra):
    s = union_py(sevs)
    assert 0 <= s <= 100
    assert union_py(sevs + [extra]) >= s - 1  # monotone up to rounding of the fold
    assert union_py(sevs + [100]) == 100
    assert abs(union_py(list(reversed(sevs))) - s) <= 1


def test_score_alerts_full(spark, alerts):
    a = alerts([("USER", "1h", "User_1", 65, 55000.0, 0, 3_600_000), ("IP", "1h", "1.2.3.4", 10, 10.0, 0, 3_600_000)])
    bl = spark.createDataFrame([("1.2.3.4",)], "value string")
    rings = spark.createDataFrame([("User_1", "r1", "device", "Dev_1", 3, 0.3)],
                                  "user_id string, ring_id string, ring_type string, ring_resource string, "
                                  "ring_users bigint, ring_risk double")
    out = {r["dimension_key"]: r for r in scoring.score_alerts(a, REFERENCE, blacklist=bl, user_rings=rings).collect()}
    u = out["User_1"]
    assert [h["rule_id"] for h in u["triggered_rules"]] == ["velocity_alert", "high_window_amount", "fraud_ring"]
    assert u["score"] == union_py([95, 90, 30]) and u["routing"] == "block"
    assert u["reasons"][-1] == "Fraud ring: 3 members share device 'Dev_1'"
    ip = out["1.2.3.4"]
    assert ip["score"] == 100 and [h["rule_id"] for h in ip["triggered_rules"]] == ["blacklist"]


def test_no_hits_allow(spark, alerts):
    r = scoring.score_alerts(alerts([("USER", "1h", "u", 1, 1.0, 0, 1)]), REFERENCE).first()
    assert r["score"] == 0 and r["routing"] == "allow" and r["triggered_rules"] == []


def test_adhoc_single_transaction(spark, transactions):
    tx = transactions([{"amount": 60000.0}])
    a = scoring.adhoc_alerts(tx)
    r = scoring.score_alerts(a, REFERENCE).first()
    assert r["txn_count"] == 1 and r["window_end"] - r["window_start"] == 3_600_000 and r["score"] == 90
    assert not math.isnan(r["total_amount"])
