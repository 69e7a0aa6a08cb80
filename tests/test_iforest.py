"""Isolation forest: planted outliers are found, fits are deterministic, small inputs are refused."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.config import REFERENCE
from riskstream.operators import iforest


def _alerts(spark, n=600, outliers=6, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((f"a{i}", "USER", int(rng.integers(30, 40)), float(rng.normal(500, 50)), 0, 3_600_000))
    for j in range(outliers):
        rows.append((f"o{j}", "USER", 400 + j, 90000.0 + j, 0, 3_600_000))
    return spark.createDataFrame(rows, "k string, dimension string, txn_count bigint, total_amount double, "
                                       "window_start bigint, window_end bigint")


def test_planted_outliers(spark):
    cfg = REFERENCE.with_(n_trees=50)
    a = _alerts(spark)
    f = iforest.fit(a, cfg, "k")
    scores = {r["k"]: r["ml_score"] for r in f.scorer()(a).collect()}
    top = sorted(scores, key=scores.get, reverse=True)[:6]
    assert set(top) == {f"o{j}" for j in range(6)}
    assert all(0 < scores[k] <= 0.5 for k in top)
    flagged = sum(1 for v in scores.values() if v > 0)
    assert 0.05 * len(scores) <= flagged <= 0.15 * len(scores)  # contamination 0.1


def test_deterministic(spark):
    cfg = REFERENCE.with_(n_trees=20)
    a = _alerts(spark, n=300)
    n1 = iforest.fit_nodes(a, cfg, "k").orderBy("tree", "node").collect()
    n2 = iforest.fit_nodes(a, cfg, "k").orderBy("tree", "node").collect()
    assert n1 == n2 and len({r["tree"] for r in n1}) == 20


def test_refuses_small(spark):
    assert iforest.fit(_alerts(spark, n=10, outliers=0), REFERENCE, "k") is None


def test_retrain_policy():
    assert not iforest.should_retrain(49, 49, False, REFERENCE)
    assert iforest.should_retrain(50, 50, False, REFERENCE)
    assert not iforest.should_retrain(500, 99, True, REFERENCE)
    assert iforest.should_retrain(500, 100, True, REFERENCE)


def test_avg_path():
    assert iforest.avg_path(np.array([1, 2]))[0] == 0 and iforest.avg_path(np.array([2]))[0] == 1


@pytest.mark.parametrize("n", [10, 16, 300, 1279, 1281, 5000])
def test_one_sampling_rule_at_every_size(spark, n):
    """Each tree holds exactly min(psi, n) different rows, around and far beyond the size of the pool."""
    cfg = REFERENCE.with_(n_trees=10, max_samples=16)
    feats = iforest.alert_features(_alerts(spark, n=n, outliers=0)).select("k", *iforest.FEATURES)
    s = iforest.tree_samples(feats, "k", cfg, n).collect()
    per_tree = {}
    for r in s:
        per_tree.setdefault(r["tree"], []).append(r["k"])
    assert sorted(per_tree) == list(range(10)) and all(len(v) == len(set(v)) == min(16, n) for v in per_tree.values())
    again = iforest.tree_samples(feats.repartition(5), "k", cfg, n).collect()
    assert sorted((r["tree"], r["k"]) for r in again) == sorted((r["tree"], r["k"]) for r in s)


def test_models_on_different_rows_have_different_ids(spark):
    cfg = REFERENCE.with_(n_trees=5, max_samples=16)
    one = iforest.fit(_alerts(spark, n=200, outliers=0), cfg, "k")
    other = iforest.fit(_alerts(spark, n=200, outliers=0).withColumn("total_amount", F.col("total_amount") * 2), cfg, "k")
    same = iforest.fit(_alerts(spark, n=200, outliers=0), cfg, "k")
    assert one.version == same.version != other.version


def test_nodes_below_the_minimum_are_none(spark):
    cfg = REFERENCE.with_(n_trees=5, max_samples=16)
    assert iforest.fit_nodes(_alerts(spark, n=cfg.min_training_samples - 1, outliers=0), cfg, "k").isEmpty()


def test_scoring_leaves_other_columns_alone(spark):
    cfg = REFERENCE.with_(n_trees=5, max_samples=16)
    a = _alerts(spark, n=200, outliers=0).withColumn("big", F.when(F.col("k").isNotNull(), F.lit(9007199254740993)))
    a = a.unionByName(a.limit(1).withColumn("big", F.lit(None).cast("bigint")))
    scored = iforest.fit(a, cfg, "k").scorer()(a)
    assert {r.big for r in scored.collect()} == {9007199254740993, None}
