"""Registered queries: alert features and the isolation forest (fit / score / hits)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import functions as F

from riskstream.operators import iforest, rules, scoring, velocity
from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.oracle_parts import route_sql, union_sql
from riskstream.plans.q_velocity import CFG, SCORE_EXTRA, WA, scored_alerts
from riskstream.plans.registry import query
from riskstream.sources import fixtures as fx

KEY = "alert_key"


def _alerts(spark, sf):
    a = velocity.velocity_alerts(fx.fx_transactions(spark, sf), CFG)
    return a.withColumn(KEY, F.concat_ws("|", "dimension", "dimension_key", F.col("window_start").cast("string")))


@query("alert_features", with_fx("""
SELECT dimension, dimension_key, window_start, CAST(txn_count AS DOUBLE) AS txn_count_f, total_amount AS total_amount_f,
       greatest(CAST(window_end - window_start AS DOUBLE), 1.0) / 60000.0 AS duration_min,
       CASE WHEN txn_count > 0 THEN total_amount / txn_count ELSE 0.0 END AS amount_per_txn
FROM alerts""", "fx_transactions", extra=WA))
def q_alert_features(spark, sf):
    f = iforest.alert_features(velocity.velocity_alerts(fx.fx_transactions(spark, sf), CFG))
    return f.select("dimension", "dimension_key", "window_start", *iforest.FEATURES)


@query("iforest_fit")
def q_iforest_fit(spark, sf):
    """K2: the node table of the fitted forest (deterministic for a seed)."""
    return iforest.fit_nodes(_alerts(spark, sf), CFG, KEY)


def _forest(spark, sf):
    return iforest.fit(_alerts(spark, sf), CFG, KEY)


@query("iforest_score")
def q_iforest_score(spark, sf):
    """K3: ml_score of every alert under a forest fitted on the same alerts."""
    forest = _forest(spark, sf)
    a = _alerts(spark, sf)
    if forest is None:
        return a.select("dimension", "dimension_key", "window_start", F.lit(0.0).alias("ml_score"))
    return forest.scorer()(a).select("dimension", "dimension_key", "window_start", "ml_score")


@query("ml_hits")
def q_ml_hits(spark, sf):
    """K4: ML rule hits (score > 0) with severity round(score x 100)."""
    forest = _forest(spark, sf)
    a = _alerts(spark, sf)
    s = forest.scorer()(a) if forest is not None else a.withColumn("ml_score", F.lit(0.0))
    h = rules.MlRule().hit()
    return s.select("dimension", "dimension_key", "window_start", "ml_score", h.alias("h")).where("h IS NOT NULL") \
        .select("dimension", "dimension_key", "window_start", "ml_score", F.col("h.severity").alias("ml_severity"),
                "h.reason")


@query("score_alerts_ml")
def q_score_alerts_ml(spark, sf):
    """P1 with the ML layer: forest fitted on the alerts, then the full rule set."""
    forest = _forest(spark, sf)
    s = scored_alerts(spark, sf, ml_scorer=forest.scorer() if forest else None,
                      model_version=forest.version if forest else None)
    return scoring.flatten_scored(s, with_ml=True)


# A small forest given as data, so that SQL can walk it: (tree, node, feature, threshold, left, right, size, depth).
FIXED_NODES = [
    (0, 0, 0, 12.0, 1, 2, 256, 0), (0, 1, -1, 0.0, -1, -1, 200, 1), (0, 2, 1, 2500.0, 3, 4, 56, 1),
    (0, 3, -1, 0.0, -1, -1, 50, 2), (0, 4, -1, 0.0, -1, -1, 6, 2),
    (1, 0, 3, 180.0, 1, 2, 256, 0), (1, 1, -1, 0.0, -1, -1, 254, 1), (1, 2, -1, 0.0, -1, -1, 2, 1),
]
FIXED_PSI, FIXED_OFFSET = 256, -0.55


def fixed_forest() -> iforest.Forest:
    nodes = pd.DataFrame(FIXED_NODES, columns=[f.name for f in iforest.NODE_SCHEMA])
    return iforest.Forest(nodes=nodes, psi=FIXED_PSI, offset=FIXED_OFFSET, version="fixed", n_trees=2)


def _walk_sql(tree: int) -> str:
    """The path length of a row in a tree as a CASE over its splits."""
    nodes = {n[1]: n for n in FIXED_NODES if n[0] == tree}

    def at(i):
        _, _, feature, threshold, left, right, size, depth = nodes[i]
        if feature < 0:
            grown = 0.0 if size < 2 else 1.0 if size == 2 else \
                2 * (math.log(size - 1) + iforest.EULER) - 2 * (size - 1) / size
            return f"{depth + grown!r}::DOUBLE"
        return f"CASE WHEN {iforest.FEATURES[feature]} < {threshold!r} THEN {at(left)} ELSE {at(right)} END"

    return at(0)


_C = 2 * (math.log(FIXED_PSI - 1) + iforest.EULER) - 2 * (FIXED_PSI - 1) / FIXED_PSI
_FIXED = WA + [("feats", """
  SELECT *, CAST(txn_count AS DOUBLE) AS txn_count_f, total_amount AS total_amount_f,
         CASE WHEN txn_count > 0 THEN total_amount / txn_count ELSE 0.0 END AS amount_per_txn FROM alerts"""),
    ("raw", f"SELECT *, -pow(2.0, -(({_walk_sql(0)}) + ({_walk_sql(1)})) / 2.0 / {_C!r}) AS sample FROM feats"),
    ("scored_ml", f"SELECT *, CASE WHEN sample < {FIXED_OFFSET} THEN least(abs(sample) / 2.0, 1.0) ELSE 0.0 END AS ml FROM raw")]


@query("iforest_score_fixed", with_fx("SELECT dimension, dimension_key, window_start, ml AS ml_score FROM scored_ml",
                                      "fx_transactions", extra=_FIXED))
def q_iforest_score_fixed(spark, sf):
    """K3 under a given forest."""
    return fixed_forest().scorer()(_alerts(spark, sf)).select("dimension", "dimension_key", "window_start", "ml_score")


_ML_SEVERITY = "CASE WHEN ml > 0 THEN least(round_even(ml * 100.0::DOUBLE, 0), 100) END"


@query("ml_hits_fixed", with_fx(f"""
SELECT dimension, dimension_key, window_start, ml AS ml_score, CAST({_ML_SEVERITY} AS BIGINT) AS ml_severity
FROM scored_ml WHERE ml > 0""", "fx_transactions", extra=_FIXED))
def q_ml_hits_fixed(spark, sf):
    """K4 under a given forest."""
    s = fixed_forest().scorer()(_alerts(spark, sf))
    return s.select("dimension", "dimension_key", "window_start", "ml_score", rules.MlRule().hit().alias("h")).where(
        "h IS NOT NULL").select("dimension", "dimension_key", "window_start", "ml_score",
                                F.col("h.severity").cast("bigint").alias("ml_severity"))


_SEVERITIES = ["s_vel", "s_amt", "s_bl", "s_ml", "s_ring"]


@query("score_alerts_ml_fixed", with_fx(f"""
SELECT dimension, dimension_key, window_start, CAST(s_ml AS BIGINT) AS ml_severity,
       {union_sql(_SEVERITIES)} AS score, {route_sql(union_sql(_SEVERITIES))} AS routing
FROM (SELECT s.*, {_ML_SEVERITY} AS s_ml FROM scored s
      JOIN (SELECT dimension, dimension_key, window_start, ml FROM scored_ml) m USING (dimension, dimension_key, window_start)) x""",
                                         "fx_transactions", "fx_blacklist_ops", extra=SCORE_EXTRA + _FIXED[len(WA):]))
def q_score_alerts_ml_fixed(spark, sf):
    """P1 with all five layers, under a given forest."""
    s = scored_alerts(spark, sf, ml_scorer=fixed_forest().scorer(), model_version="fixed")
    return scoring.flatten_scored(s, with_ml=True).select("dimension", "dimension_key", "window_start", "ml_severity",
                                                          "score", "routing")
