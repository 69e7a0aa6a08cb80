"""Alert scoring.

The whole per-alert scoring is one projection over the alert rows plus two left joins (blacklist,
user rings) whose physical strategy AQE picks from runtime sizes. Severities are folded by
probabilistic union in rule order inside codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskstream.config import EngineConfig
from riskstream.functions import epoch_ms, prob_union
from riskstream.operators.rules import default_rules, flag_blacklisted
from riskstream.operators.velocity import ALERT_COLS, DIMENSIONS, explode_dimensions
from riskstream.session import materialize

RING_COLS = ["ring_type", "ring_resource", "ring_users", "ring_risk"]


def route(score: Column, cfg: EngineConfig) -> Column:
    """Block / review / allow on the 0-100 score."""
    return (F.when(score >= cfg.block_cut, F.lit("block"))
            .when(score >= cfg.review_cut, F.lit("review")).otherwise(F.lit("allow")))


def attach_rings(alerts: DataFrame, user_rings: DataFrame | None) -> DataFrame:
    """Best ring of the alert's key (the reference looks the key up as a user id whatever the
    dimension). ``user_rings`` has one row per user: user_id + RING_COLS."""
    if user_rings is None:
        out = alerts
        for c, t in zip(RING_COLS, ["string", "string", "bigint", "double"]):
            out = out.withColumn(c, F.lit(None).cast(t))
        return out
    r = user_rings.select(F.col("user_id").alias("_ring_user"), *RING_COLS)
    return alerts.join(r, alerts["dimension_key"] == r["_ring_user"], "left").drop("_ring_user")


def score_alerts(
    alerts: DataFrame,
    cfg: EngineConfig,
    blacklist: DataFrame | None = None,
    user_rings: DataFrame | None = None,
    ml_scorer=None,
    model_version: str | None = None,
    rules: list | None = None,
    keep: tuple = (),
) -> DataFrame:
    """SCORED_ALERT rows: alert columns, score 0-100, routing, triggered_rules, reasons."""
    a = flag_blacklisted(alerts, blacklist)
    a = ml_scorer(a) if ml_scorer is not None else a.withColumn("ml_score", F.lit(0.0))
    a = attach_rings(a, user_rings)
    rules = rules if rules is not None else default_rules(cfg)
    hits = [r.hit() for r in rules]
    a = a.withColumn("_hits", F.array(*hits))
    sev = [F.col("_hits")[i].getField("severity") for i in range(len(hits))]
    a = a.withColumn("score", prob_union(sev))
    a = a.withColumn("triggered_rules", F.filter("_hits", lambda h: h.isNotNull()))
    return a.select(
        *keep, *[c for c in ALERT_COLS if c in alerts.columns],
        *[F.col("_hits")[i].getField("severity").alias(n) for i, n in enumerate(
            ["velocity_severity", "amount_severity", "blacklist_severity", "ml_severity", "ring_severity"][:len(hits)])],
        "score",
        route(F.col("score"), cfg).alias("routing"),
        "triggered_rules",
        F.transform("triggered_rules", lambda h: h.getField("reason")).alias("reasons"),
        F.lit(model_version).cast("string").alias("model_version"),
        F.current_timestamp().alias("scored_at"),
    )


def flatten_scored(scored: DataFrame, with_ml: bool = False) -> DataFrame:
    """Scalar view of scored alerts (arrays joined to text) for comparison and export."""
    sev = ["velocity_severity", "amount_severity", "blacklist_severity", "ring_severity"] + (["ml_severity"] if with_ml else [])
    return scored.select(
        "dimension", "dimension_key", "window_start", "txn_count", "total_amount",
        *[F.col(c).cast("bigint").alias(c) for c in sev],
        "score", "routing",
        F.array_join(F.transform("triggered_rules", lambda h: h.getField("rule_id")), ",").alias("rule_ids"),
        F.array_join("reasons", " | ").alias("reasons"),
    )


def risk_scores_from_hits(hits: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """D12, grouped form: one row per alert from a long table of hits (keys, rule_id, severity).

    A group holds at most one row per rule, so the per-group pivot is bounded; severities are folded
    in the fixed rule ``order``."""
    g = hits.groupBy(*keys).agg(*[
        F.max(F.when(F.col("rule_id") == r, F.col("severity"))).alias(f"_s{i}") for i, r in enumerate(order)
    ], F.count(F.lit(1)).alias("n_hits"))
    return g.select(*keys, "n_hits", prob_union([F.col(f"_s{i}") for i in range(len(order))]).alias("score"))


def adhoc_alerts(tx: DataFrame, window_ms: int = 3_600_000, label: str = "1h") -> DataFrame:
    """The single-transaction USER estimate: txn_count 1, window = the hour before the event."""
    t = epoch_ms("event_time")
    return tx.select(
        "transaction_id", F.lit("USER").alias("dimension"), F.lit(label).alias("window_size"),
        F.col("user_id").alias("dimension_key"), F.lit(1).cast("bigint").alias("txn_count"),
        F.col("amount").cast("double").alias("total_amount"),
        (t - F.lit(window_ms)).alias("window_start"), t.alias("window_end"),
    )


def txn_risk(tx: DataFrame, scored: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Attribute window scores back to the transactions inside the alerting windows.

    Each transaction is expanded to its four (dimension, key, window) rows and equi-joined with the
    scored alerts (one row per key, so AQE's skew-join split handles hot keys); the result is the
    maximum score per transaction with the dimension that produced it."""
    rows = explode_dimensions(tx, "event_time", extra=("transaction_id",)).select(
        "transaction_id", "dimension", "dimension_key",
        epoch_ms(F.window("_t", cfg.window).start).alias("window_start"))
    s = scored.select("dimension", "dimension_key", "window_start", "score")
    j = rows.join(s, ["dimension", "dimension_key", "window_start"])
    # (score, dimension) packed into one long so the per-transaction maximum is a hash aggregate
    names = sorted(d for d, _ in DIMENSIONS)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("dimension")) - 1
    best = j.groupBy("transaction_id").agg(
        F.max(F.col("score") * F.lit(len(names)) + rank).alias("_b"), F.count(F.lit(1)).alias("n_alerts"))
    score = F.floor(F.col("_b") / F.lit(len(names))).cast("bigint")
    top = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("_b") % F.lit(len(names)) + 1).cast("int"))
    return best.select("transaction_id", score.alias("score"), top.alias("top_dimension"),
                       "n_alerts", route(score, cfg).alias("routing"))


def txn_reasons(tx: DataFrame, scored: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per transaction inside alerting windows: the score, routing and reasons of its top alert
    (highest score, then dimension name). The pick is a hash aggregate over a packed long
    (score, dimension rank); the reasons are then joined from the chosen alert, which the
    transaction identifies by its own key in that dimension and its window."""
    names = sorted(d for d, _ in DIMENSIONS)
    rows = explode_dimensions(tx, "event_time", extra=("transaction_id",)).select(
        "transaction_id", "dimension", "dimension_key",
        epoch_ms(F.window("_t", cfg.window).start).alias("window_start"))
    # read twice (pick, then reasons): the alert-sized scored table is written once
    s = materialize(scored.select("dimension", "dimension_key", "window_start", "score", "reasons"), "scored-alerts")
    j = rows.join(s.drop("reasons"), ["dimension", "dimension_key", "window_start"])
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("dimension")) - 1
    best = j.groupBy("transaction_id").agg(F.max(F.col("score") * F.lit(len(names)) + rank).alias("_b"))
    top = best.select("transaction_id", F.element_at(F.array(*[F.lit(n) for n in names]),
                                                     (F.col("_b") % F.lit(len(names)) + 1).cast("int")).alias("dimension"))
    chosen = rows.join(top, ["transaction_id", "dimension"]).join(s, ["dimension", "dimension_key", "window_start"])
    return chosen.select("transaction_id", "score", F.col("dimension").alias("top_dimension"), "reasons",
                         route(F.col("score"), cfg).alias("routing"))


ROUTE_TOPICS = {"block": "fraud-alerts", "review": "human-review", "allow": "approved-transactions"}


def fraud_results(tx: DataFrame, scored: DataFrame, cfg: EngineConfig, user_rings: DataFrame | None = None,
                  model_version: str | None = None) -> DataFrame:
    """FRAUD_RESULT rows of the transactions inside alerting windows: their top alert's score on the 0..1 scale and
    reasons, fraud where it is blocked, the topic of the routing, the first reason as the rule, and the best ring of the
    transaction's user. ``scored_at`` is the event time: results of a batch do not depend on when it runs."""
    r = txn_reasons(tx, scored, cfg)
    t = tx.select("transaction_id", F.col("user_id").alias("_user"), F.col("event_time").alias("scored_at"))
    out = r.join(t, "transaction_id")
    ring = F.lit(None).cast("string")
    if user_rings is not None:
        rings = user_rings.select(F.col("user_id").alias("_ring_user"), "ring_id")
        out, ring = out.join(rings, F.col("_user") == F.col("_ring_user"), "left"), F.col("ring_id")
    topic = F.create_map(*[F.lit(x) for kv in ROUTE_TOPICS.items() for x in kv])
    return out.select(
        "transaction_id", (F.col("routing") == "block").alias("is_fraud"),
        (F.col("score") / F.lit(100.0)).cast("decimal(5,4)").alias("score"), "reasons",
        F.get("reasons", F.lit(0)).alias("rule_triggered"), F.lit(model_version).cast("string").alias("model_version"),
        ring.alias("fraud_ring_id"), F.lit(None).cast("string").alias("llm_summary"),
        F.element_at(topic, F.col("routing")).alias("routed_to"), "scored_at")
