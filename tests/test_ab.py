"""A/B assignment: default without an experiment, determinism, split ratio, stable bucket."""

from riskstream.config import REFERENCE
from riskstream.operators import ab
from riskstream.sources.fixtures import experiments

EXP = "experiment_id string, name string, control_model_version string, challenger_model_version string, " \
      "traffic_split double, status string, start_date string, end_date string"


def _exp(spark, status="active", split=0.3):
    return spark.createDataFrame([("exp-001", "t", "v1.0", "v2.0", split, status, "2026-01-01", None)], EXP)


def test_no_active_experiment_uses_default(spark):
    tx = spark.createDataFrame([("t1",)], "transaction_id string")
    r = ab.ab_assign(tx, _exp(spark, "completed"), ["v1.0"], REFERENCE).first()
    assert r["model_version"] == "v1.0" and r["arm"] == "default"


def test_deterministic(spark):
    tx = spark.createDataFrame([("deterministic-id-123",)] * 50, "transaction_id string")
    arms = {r["arm"] for r in ab.ab_assign(tx, _exp(spark), ["v1.0", "v2.0"], REFERENCE).collect()}
    assert len(arms) == 1


def test_split_ratio(spark):
    tx = spark.range(10000).selectExpr("concat('txn-split-', id) AS transaction_id")
    out = ab.ab_assign(tx, _exp(spark), ["v1.0", "v2.0"], REFERENCE)
    share = out.where("arm = 'challenger'").count() / 10000
    assert abs(share - 0.3) < 0.05


def test_bucket_value(spark):
    from pyspark.sql import functions as F

    from riskstream.functions import ab_bucket

    assert spark.createDataFrame([("txn-1",)], "k string").select(ab_bucket(F.col("k"))).first()[0] == 7085


def test_fallbacks(spark):
    tx = spark.range(200).selectExpr("concat('t', id) AS transaction_id")
    out = ab.ab_assign(tx, _exp(spark, split=0.5), ["v1.0"], REFERENCE)  # challenger unknown -> control
    assert {r["model_version"] for r in out.collect()} == {"v1.0"}
    out = ab.ab_assign(tx, _exp(spark, split=0.5), ["v9"], REFERENCE)  # both unknown -> default model
    assert {r["model_version"] for r in out.collect()} == {"v9"}


def test_config_experiments_have_one_active(spark):
    assert experiments(spark).where("status = 'active'").count() == 1


def test_experiment_lifecycle(spark):
    log = spark.createDataFrame([
        (1, "e1", "create", 0.3, None, "v1", "v2"),
        (2, "e2", "create", 0.2, None, "v1", "v3"),   # rejected: e1 is active
        (3, "e3", "create", 0.7, None, "v1", "v4"),   # rejected: split > 0.5
        (4, "e1", "split", 0.9, None, None, None),    # rejected: split > 0.5
        (5, "e1", "promote", None, None, None, None),  # active -> completed
        (6, "e1", "promote", None, None, None, None),  # rejected: not active
        (7, "e2", "create", 0.2, None, "v1", "v3"),   # accepted now
        (8, "e2", "status", None, "paused", None, None),
        (9, "e2", "status", None, "bogus", None, None),  # rejected status
    ], ab.EXPERIMENT_EVENT)
    st = {r["experiment_id"]: r for r in ab.experiment_state(log, REFERENCE).collect()}
    assert set(st) == {"e1", "e2"}
    assert st["e1"]["status"] == "completed" and st["e1"]["traffic_split"] == 0.3 and st["e1"]["rejected"] == 2
    assert st["e2"]["status"] == "paused" and st["e2"]["rejected"] == 1


def test_correctness_update(spark):
    m = spark.createDataFrame([("e", "v1", "t1", 1.0, None), ("e", "v2", "t1", 2.0, None), ("e", "v1", "t2", 3.0, True)],
                              "experiment_id string, model_version string, transaction_id string, latency_ms double, "
                              "was_correct boolean")
    c = spark.createDataFrame([("t1", False, 1), ("t1", True, 2)], "transaction_id string, was_correct boolean, seq int")
    out = {(r["model_version"], r["transaction_id"]): r["was_correct"] for r in ab.apply_correctness(m, c).collect()}
    assert out == {("v1", "t1"): True, ("v2", "t1"): True, ("v1", "t2"): True}


def test_score_by_version(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("t1", "v1.0"), ("t2", "v2.0"), ("t3", "v9")], "transaction_id string, model_version string")
    out = ab.score_by_version(df, {"v1.0": lambda d: d.withColumn("s", F.lit(1)),
                                   "v2.0": lambda d: d.withColumn("s", F.lit(2))})
    assert {r["transaction_id"]: r["s"] for r in out.collect()} == {"t1": 1, "t2": 2, "t3": 1}
