"""Dashboard parts on empty inputs and the histogram top-bucket modes."""

from riskstream.config import DAILY
from riskstream.operators import dashboard as D

RES = "transaction_id string, score decimal(5,4), is_fraud boolean, routed_to string, model_version string, " \
      "scored_at timestamp_ntz"


def _empty(spark, transactions):
    from conftest import TX_SCHEMA

    tx = spark.createDataFrame([], TX_SCHEMA)
    res = spark.createDataFrame([], RES)
    fb = spark.createDataFrame([], "feedback_id string, transaction_id string, verdict string, created_at timestamp_ntz")
    m = spark.createDataFrame([], "model_version string, latency_ms decimal(8,2)")
    return tx, res, fb, m


def test_empty_tables(spark, transactions):
    tx, res, fb, m = _empty(spark, transactions)
    k = D.kpis(tx, res, fb, m, DAILY).first()
    assert k["transactions_scanned"] == 0 and k["high_risk_rate_pct"] == 0 and k["avg_model_score"] == 0
    assert [r["count"] for r in D.score_histogram(res).orderBy("bucket").collect()] == [0] * 10
    assert {r["action"]: r["count"] for r in D.decision_mix(spark, res).collect()} == {"Allow": 0, "Block": 0, "Challenge": 0}
    assert D.minute_trend(tx, res).count() == 0 and D.recent_flagged(tx, res, DAILY).count() == 0
    snap = D.snapshot(spark, tx, res, fb, m, DAILY)
    assert snap.where("part = 'state'").first()["text"] is None


def test_histogram_top_bucket(spark):
    import datetime as dt
    from decimal import Decimal

    t = dt.datetime(2024, 1, 1)
    res = spark.createDataFrame([("a", Decimal("1.0000"), True, "fraud-alerts", "v1", t),
                                 ("b", Decimal("0.9500"), True, "fraud-alerts", "v1", t)], RES)
    clamp = {r["bucket"]: r["count"] for r in D.score_histogram(res).collect()}
    faithful = {r["bucket"]: r["count"] for r in D.score_histogram(res, faithful=True).collect()}
    assert clamp[9] == 2 and faithful[9] == 1 and sum(faithful.values()) == 1
    labels = [r["bucket_label"] for r in D.score_histogram(res).orderBy("bucket").collect()]
    assert labels[0] == "0.0-0.1" and labels[9] == "0.9-1.0"


def test_bucket_tier(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("0.7-0.8",), ("0.4-0.5",), ("0.1-0.2",), ("junk",)], "l string")
    assert [r[0] for r in df.select(D.bucket_tier(F.col("l"))).collect()] == ["high", "mid", "low", "low"]


def test_empty_tables_all_parts(spark, transactions):
    tx, res, fb, m = _empty(spark, transactions)
    exp = spark.createDataFrame([], "experiment_id string, status string")
    assert D.location_matrix(tx, res).count() == 0
    assert D.top_risky_merchants(tx, res, DAILY).count() == 0
    assert D.histogram_history(res).count() == 0 and D.channel_history(tx, res).count() == 0
    assert D.newest_flagged_history(tx, res, DAILY).count() == 0
    s = D.system_metrics(tx, res, fb.select("transaction_id"), exp).first()
    assert all(v == 0 for v in s.asDict().values())
    share = {r["action"]: r["pct"] for r in D.decision_share(D.decision_mix(spark, res)).collect()}
    assert share == {"Allow": 0.0, "Block": 0.0, "Challenge": 0.0}


def test_band_and_alarm_boundaries(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(24.0,), (23.99,), (14.0,), (13.99,)], "p double")
    assert [r[0] for r in df.select(D.risk_band(F.col("p"))).collect()] == ["high", "medium", "medium", "low"]
    mix = spark.createDataFrame([("Allow", 48), ("Block", 30), ("Challenge", 22)], "action string, count bigint")
    alarms = {r["action"]: r["alarm"] for r in D.decision_share(mix).collect()}
    assert alarms == {"Allow": None, "Block": "danger", "Challenge": "warn"}


def test_action_mapping_both_schemes(spark):
    df = spark.createDataFrame([("fraud-alerts",), ("block",), ("human-review",), ("review",),
                                ("approved-transactions",), ("allow",), (None,)], "r string")
    got = [r[0] for r in df.select(D.action_of("r")).collect()]
    assert got == ["Block", "Block", "Challenge", "Challenge", "Allow", "Allow", "Allow"]
