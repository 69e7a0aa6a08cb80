"""Constraint checks: rows of each rule against a plain count, nulls, and keys that break a rule often."""

from collections import Counter

from pyspark.sql import functions as F

from riskstream.operators import quality

EXPERIMENTS = "experiment_id string, status string, traffic_split double"


def _found(spark, tx, res, fb, ex):
    got = quality.constraint_violations(
        spark.createDataFrame(tx, "transaction_id string, user_id string, amount double, event_time timestamp_ntz"),
        spark.createDataFrame(res, "transaction_id string, routed_to string"),
        spark.createDataFrame(fb, "feedback_id string, transaction_id string, verdict string"),
        spark.createDataFrame(ex, EXPERIMENTS))
    return Counter((r["table_name"], r["rule"], r["key"]) for r in got.collect())


def test_each_rule(spark):
    import datetime as dt

    t = dt.datetime(2026, 1, 1)
    tx = [("a", "u", 1.0, t), ("a", None, 1.0, t), ("b", "u", None, t), ("c", "u", 1.0, None), (None, "u", 1.0, t)]
    res = [("a", "fraud-alerts"), ("a", "nowhere"), ("z", "human-review"), ("z", None), ("b", "human-review"), (None, "fraud-alerts")]
    fb = [("f1", "a", "true_positive"), ("f2", "z", "maybe"), ("f3", None, None), ("f4", "c", "false_negative")]
    ex = [("e1", "active", 0.7), ("e2", "active", 0.1), ("e3", "gone", -0.1)]
    assert _found(spark, tx, res, fb, ex) == Counter({
        ("transactions", "pk_duplicate", "a"): 1, ("transactions", "not_null", "a"): 1, ("transactions", "not_null", "b"): 1,
        ("transactions", "not_null", "c"): 1,
        ("fraud_results", "pk_duplicate", "a"): 1, ("fraud_results", "pk_duplicate", "z"): 1,
        ("fraud_results", "routed_to_enum", "a"): 1, ("fraud_results", "routed_to_enum", "z"): 1,
        ("fraud_results", "fk_transaction", "z"): 2, ("fraud_results", "fk_transaction", None): 1,
        ("analyst_feedback", "verdict_enum", "f2"): 1, ("analyst_feedback", "verdict_enum", "f3"): 1,
        ("analyst_feedback", "fk_transaction", "f2"): 1, ("analyst_feedback", "fk_transaction", "f3"): 1,
        ("ab_experiments", "split_range", "e1"): 1, ("ab_experiments", "split_range", "e3"): 1,
        ("ab_experiments", "status_enum", "e3"): 1, ("ab_experiments", "one_active", "e1"): 1})


def test_no_rows(spark):
    assert not _found(spark, [], [], [], [])


def test_a_key_that_breaks_a_rule_in_several_runs(spark, monkeypatch):
    monkeypatch.setattr(quality, "RUN", 7)
    rows = [("k", None, 1.0, None)] * 30 + [("one", None, 1.0, None)]
    found = _found(spark, rows, [("x", "fraud-alerts")] * 14, [], [])
    assert found == Counter({("transactions", "not_null", "k"): 30, ("transactions", "not_null", "one"): 1,
                             ("transactions", "pk_duplicate", "k"): 1, ("fraud_results", "fk_transaction", "x"): 14,
                             ("fraud_results", "pk_duplicate", "x"): 1})


def test_files_are_read_once(spark, workdir):
    tables = {}
    for name, schema in (("tx", "transaction_id string, user_id string, amount double, event_time timestamp_ntz"),
                         ("res", "transaction_id string, routed_to string"),
                         ("fb", "feedback_id string, transaction_id string, verdict string"), ("ex", EXPERIMENTS)):
        spark.createDataFrame([], schema).write.parquet(f"{workdir}/{name}")
        tables[name] = spark.read.schema(schema).parquet(f"{workdir}/{name}")
    df = quality.constraint_violations(*tables.values())
    plan = df._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "Scan parquet" in line]
    assert sum(f"{workdir}/res" in s for s in scans) == 1 and sum(f"{workdir}/fb" in s for s in scans) == 1
    assert not any(f"{workdir}/tx" in s for s in scans)  # reduced to keys and written before
    assert df.where(F.lit(True)).count() == 0
