"""The reference's rule behaviours (velocity 9, amount 5, blacklist 4) on DataFrames."""

import pytest
from pyspark.sql import functions as F

from riskstream.config import REFERENCE
from riskstream.operators import rules


def _hit(alerts, rule, row, blacklist=None):
    df = alerts([row])
    if isinstance(rule, rules.BlacklistRule):
        df = rules.flag_blacklisted(df, blacklist)
    return df.select(rule.hit().alias("h")).first()["h"]


def A(dim=None, n=None, total=None, key=None):
    return (dim, "1h", key, n, total, 0, 3_600_000)


@pytest.mark.parametrize("dim,n,sev,bucket", [
    ("USER", 65, 95, "vel_user"), ("USER", 47, 80, "vel_user"), ("USER", 30, 60, "vel_user"),
    ("IP", 62, 60, "vel_ip"), ("MERCHANT", 155, 60, "vel_merchant"),
])
def test_velocity_hits(alerts, dim, n, sev, bucket):
    h = _hit(alerts, rules.VelocityRule(REFERENCE), A(dim, n))
    assert h["severity"] == sev and h["bucket_id"] == bucket and h["rule_id"] == "velocity_alert"


@pytest.mark.parametrize("dim,n", [("USER", 10), ("IP", 59), ("UNKNOWN", 9999), (None, 100)])
def test_velocity_misses(alerts, dim, n):
    assert _hit(alerts, rules.VelocityRule(REFERENCE), A(dim, n)) is None


def test_velocity_lowercase_dimension_and_reason(alerts):
    h = _hit(alerts, rules.VelocityRule(REFERENCE), A("user", 47))
    assert h["severity"] == 80 and h["reason"] == "USER txn_count 47 >= 45 (sev 80)"


@pytest.mark.parametrize("total,sev", [(55000.0, 90), (25000.0, 70), (12000.0, 50)])
def test_amount_hits(alerts, total, sev):
    h = _hit(alerts, rules.AmountRule(REFERENCE), A(total=total))
    assert h["severity"] == sev and h["rule_id"] == "high_window_amount"


@pytest.mark.parametrize("total", [5000.0, None])
def test_amount_misses(alerts, total):
    assert _hit(alerts, rules.AmountRule(REFERENCE), A(total=total)) is None


def test_amount_reason_format(alerts):
    h = _hit(alerts, rules.AmountRule(REFERENCE), A(total=1234567.125))
    assert h["reason"] == "total_amount 1,234,567.12 >= 50,000 (sev 90)"


def test_blacklist_hit(spark, alerts):
    bl = spark.createDataFrame([("10.99.0.99",)], "value string")
    h = _hit(alerts, rules.BlacklistRule(REFERENCE), A(key="10.99.0.99"), bl)
    assert h["severity"] == 100 and h["rule_id"] == "blacklist"
    assert h["reason"] == "dimension_key '10.99.0.99' is blacklisted"


def test_blacklist_empty(spark, alerts):
    bl = spark.createDataFrame([], "value string")
    assert _hit(alerts, rules.BlacklistRule(REFERENCE), A(key="192.168.1.1"), bl) is None


def test_blacklist_added_then_removed(spark, alerts):
    from riskstream.operators.state import set_from_log

    ops = spark.createDataFrame([(1, "add", "bad-key"), (2, "remove", "bad-key")], "seq long, op string, value string")
    assert _hit(alerts, rules.BlacklistRule(REFERENCE), A(key="bad-key"), set_from_log(ops)) is None


def test_blacklist_null_key(spark, alerts):
    bl = spark.createDataFrame([("x",)], "value string")
    assert _hit(alerts, rules.BlacklistRule(REFERENCE), A(key=None), bl) is None


def test_tier_range_join_equals_when_chain(spark, alerts):
    import random

    rnd = random.Random(7)
    rows = [A(d, rnd.randint(0, 400)) for d in ["IP", "USER", "DEVICE", "MERCHANT"] for _ in range(50)]
    rows = [(r[0], r[1], f"k{i}", r[3], r[4], i, i + 1) for i, r in enumerate(rows)]
    w = alerts(rows)
    a = {(r["dimension_key"]): r["velocity_severity"]
         for r in rules.tier_range_join(w, rules.tier_table(spark, REFERENCE)).collect()}
    b = {r["dimension_key"]: r["s"] for r in w.select("dimension_key", rules.VelocityRule(REFERENCE).severity()
                                                      .alias("s")).collect()}
    assert a == b


def test_keys_are_quoted_as_python_does(spark):
    from riskstream.operators.rules import py_repr

    keys = ["plain", "it's", 'say "x"', "both ' and \"", "back\\slash", "tab\tline\n"]
    got = [r[0] for r in spark.createDataFrame([(k,) for k in keys], "k string").select(py_repr(F.col("k"))).collect()]
    assert got == [repr(k) for k in keys]


def test_amounts_print_as_python_does(spark):
    from riskstream.operators.render import py_float_str

    xs = [0.0, 1.0, 12345678.5, 1e7, 99999999999.25, 1e15, 1e16, 1.5e300, 0.0005, 0.00012345, 1e-5, -2.5e7, 123.456, -1e-7]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(py_float_str(F.col("x"))).collect()]
    assert got == [str(x) for x in xs]


def test_rule_names_in_a_plain_session(spark):
    from riskstream.operators.render import rule_score_map

    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        df = spark.createDataFrame([(["a: 1", "b", "a: 2", "c : d:e"],)], "reasons array<string>")
        assert df.select(rule_score_map(F.col("reasons"))).first()[0] == {"a": 1.0, "c": 1.0}
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
