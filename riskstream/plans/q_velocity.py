"""Registered queries: velocity windows, alerts, rules, scoring (daily profile over fixture views)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskstream.config import DAILY, REFERENCE
from riskstream.operators import graph, rules, scoring, state, velocity
from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.oracle_parts import (
    alerts_sql, amount_case, dims_sql, route_sql, threshold_case, union_sql, velocity_case, windows_sql,
)
from riskstream.plans.registry import query
from riskstream.sources import fixtures as fx

CFG = DAILY
W = [("dims", dims_sql()), ("windows", windows_sql(CFG))]
WA = W + [("alerts", alerts_sql(CFG))]


def _tx(spark, sf):
    return fx.fx_transactions(spark, sf)


def _alerts(spark, sf):
    return velocity.velocity_alerts(_tx(spark, sf), CFG)


@query("velocity_windows", with_fx("SELECT * FROM windows", "fx_transactions", extra=W))
def q_velocity_windows(spark, sf):
    return velocity.velocity_windows(_tx(spark, sf), CFG)


@query("velocity_windows_1h", with_fx("SELECT * FROM windows", "fx_transactions",
                                      extra=[("dims", dims_sql()), ("windows", windows_sql(REFERENCE))]))
def q_velocity_windows_1h(spark, sf):
    """D1 with the reference's own profile (1-hour tumbling windows)."""
    return velocity.velocity_windows(_tx(spark, sf), REFERENCE)


@query("velocity_alerts", with_fx("SELECT * FROM alerts", "fx_transactions", extra=WA))
def q_velocity_alerts(spark, sf):
    return _alerts(spark, sf)


@query("alerts_fan_in", with_fx("""
SELECT * FROM alerts WHERE dimension = 'IP' UNION ALL SELECT * FROM alerts WHERE dimension = 'USER'
UNION ALL SELECT * FROM alerts WHERE dimension = 'DEVICE' UNION ALL SELECT * FROM alerts WHERE dimension = 'MERCHANT'""",
                                "fx_transactions", extra=WA))
def q_alerts_fan_in(spark, sf):
    return velocity.fan_in(*velocity.per_dimension_alerts(_tx(spark, sf), CFG))


_CHANGELOG = f"""
SELECT * FROM (
  SELECT dimension, '{CFG.window_label}' AS window_size, dimension_key,
         COUNT(*) OVER w AS txn_count,
         CAST(SUM(CAST(amount AS DECIMAL(12,2))) OVER w AS DOUBLE) AS total_amount,
         ((epoch_us(event_time) // 1000) // {CFG.window_ms}) * {CFG.window_ms} AS window_start,
         ((epoch_us(event_time) // 1000) // {CFG.window_ms}) * {CFG.window_ms} + {CFG.window_ms} AS window_end,
         transaction_id, (epoch_us(event_time) // 1000) AS event_ms
  FROM dims WHERE dimension_key IS NOT NULL AND dimension_key <> ''
  WINDOW w AS (PARTITION BY dimension, dimension_key, (epoch_us(event_time) // 1000) // {CFG.window_ms}
               ORDER BY event_time, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
) x WHERE txn_count >= {threshold_case(CFG)}"""


@query("alert_changelog", with_fx(_CHANGELOG, "fx_transactions", extra=W))
def q_alert_changelog(spark, sf):
    return velocity.alert_changelog(_tx(spark, sf), CFG)


@query("velocity_severity", with_fx(f"""
SELECT dimension, dimension_key, window_start, txn_count, CAST({velocity_case(CFG)} AS BIGINT) AS velocity_severity,
       'vel_' || lower(dimension) AS bucket_id,
       upper(dimension) || ' txn_count ' || txn_count || ' >= ' || ({velocity_case(CFG, 'threshold')})
         || ' (sev ' || ({velocity_case(CFG)}) || ')' AS reason
FROM windows WHERE {velocity_case(CFG)} IS NOT NULL""", "fx_transactions", extra=W))
def q_velocity_severity(spark, sf):
    w = velocity.velocity_windows(_tx(spark, sf), CFG)
    h = rules.VelocityRule(CFG).hit()
    return w.select("dimension", "dimension_key", "window_start", "txn_count", h.alias("h")).where("h IS NOT NULL") \
        .select("dimension", "dimension_key", "window_start", "txn_count", F.col("h.severity").alias("velocity_severity"),
                "h.bucket_id", "h.reason")


@query("amount_severity", with_fx(f"""
SELECT dimension, dimension_key, window_start, total_amount, CAST({amount_case(CFG)} AS BIGINT) AS amount_severity,
       'total_amount ' || format('{{:,.2f}}', total_amount) || ' >= '
         || format('{{:,.0f}}', CAST({amount_case(CFG, 'threshold')} AS DOUBLE))
         || ' (sev ' || ({amount_case(CFG)}) || ')' AS reason
FROM windows WHERE {amount_case(CFG)} IS NOT NULL""", "fx_transactions", extra=W))
def q_amount_severity(spark, sf):
    w = velocity.velocity_windows(_tx(spark, sf), CFG)
    h = rules.AmountRule(CFG).hit()
    return w.select("dimension", "dimension_key", "window_start", "total_amount", h.alias("h")).where("h IS NOT NULL") \
        .select("dimension", "dimension_key", "window_start", "total_amount",
                F.col("h.severity").alias("amount_severity"), "h.reason")


@query("tier_range_join", with_fx(f"""
SELECT dimension, dimension_key, window_start, txn_count, CAST({velocity_case(CFG)} AS BIGINT) AS velocity_severity
FROM windows""", "fx_transactions", extra=W))
def q_tier_range_join(spark, sf):
    w = velocity.velocity_windows(_tx(spark, sf), CFG)
    return rules.tier_range_join(w, rules.tier_table(spark, CFG))


BLACKLIST_SQL = """
SELECT value FROM (
  SELECT value, arg_max(op, seq) AS op FROM fx_blacklist_ops
  WHERE op <> 'clear' AND seq > (SELECT coalesce(max(seq), -1) FROM fx_blacklist_ops WHERE op = 'clear')
  GROUP BY value) s
WHERE op = 'add'"""


def _blacklist(spark, sf):
    return state.set_from_log(fx.fx_blacklist_ops(spark, sf))


@query("blacklist_state", with_fx(BLACKLIST_SQL, "fx_blacklist_ops"))
def q_blacklist_state(spark, sf):
    return _blacklist(spark, sf)


@query("blacklist_hits", with_fx("""
SELECT dimension, dimension_key, window_start, CAST(100 AS BIGINT) AS blacklist_severity,
       'dimension_key ''' || dimension_key || ''' is blacklisted' AS reason
FROM alerts WHERE dimension_key IN (SELECT value FROM bl)""", "fx_transactions", "fx_blacklist_ops",
                                  extra=WA + [("bl", BLACKLIST_SQL)]))
def q_blacklist_hits(spark, sf):
    a = rules.flag_blacklisted(_alerts(spark, sf), _blacklist(spark, sf))
    h = rules.BlacklistRule(CFG).hit()
    return a.select("dimension", "dimension_key", "window_start", h.alias("h")).where("h IS NOT NULL").select(
        "dimension", "dimension_key", "window_start", F.col("h.severity").alias("blacklist_severity"), "h.reason")


_HITS_SQL = f"""
SELECT dimension, dimension_key, window_start,
       {velocity_case(CFG)} AS s_vel, {amount_case(CFG)} AS s_amt,
       CASE WHEN dimension_key IN (SELECT value FROM bl) THEN 100 END AS s_bl
FROM alerts"""


@query("risk_scores", with_fx(f"""
SELECT dimension, dimension_key, window_start,
       CAST((s_vel IS NOT NULL)::INT + (s_amt IS NOT NULL)::INT + (s_bl IS NOT NULL)::INT AS BIGINT) AS n_hits,
       {union_sql(['s_vel', 's_amt', 's_bl'])} AS score
FROM hits WHERE s_vel IS NOT NULL OR s_amt IS NOT NULL OR s_bl IS NOT NULL""",
                                "fx_transactions", "fx_blacklist_ops",
                                extra=WA + [("bl", BLACKLIST_SQL), ("hits", _HITS_SQL)]))
def q_risk_scores(spark, sf):
    a = rules.flag_blacklisted(_alerts(spark, sf), _blacklist(spark, sf))
    keys = ["dimension", "dimension_key", "window_start"]
    hs = [rules.VelocityRule(CFG).hit(), rules.AmountRule(CFG).hit(), rules.BlacklistRule(CFG).hit()]
    long = a.select(*keys, F.explode(F.filter(F.array(*hs), lambda h: h.isNotNull())).alias("h")).select(
        *keys, "h.rule_id", "h.severity")
    return scoring.risk_scores_from_hits(long, keys, ["velocity_alert", "high_window_amount", "blacklist"])


# ----------------------------------------------------------------- full scoring (rules + blacklist + rings)

def ring_ctes(cfg=CFG, order: str = "event_id") -> list[tuple[str, str]]:
    """Shared-resource rings in SQL, as (name, body) CTEs: res -> pairs -> rings -> best; ``order`` is what tells which
    ring was there first."""
    return [
        ("res", f"""
  SELECT 'device' AS resource_type, device_id AS resource_id, user_id, amount, {order} AS seq
  FROM fx_transactions WHERE device_id IS NOT NULL AND user_id IS NOT NULL
  UNION ALL
  SELECT 'ip', ip_address, user_id, amount, {order}
  FROM fx_transactions WHERE ip_address IS NOT NULL AND user_id IS NOT NULL"""),
        ("pairs", """
  SELECT resource_type, resource_id, user_id, min(seq) AS first_use,
         SUM(CAST(amount AS DECIMAL(12,2))) AS amount
  FROM res GROUP BY resource_type, resource_id, user_id"""),
        ("rings", f"""
  SELECT md5(resource_type || ':' || resource_id) AS ring_id, resource_type, resource_id,
         COUNT(*) AS n_users, least(CAST(COUNT(*) AS DOUBLE) / 10.0::DOUBLE, 1.0::DOUBLE) AS risk_score,
         SUM(amount) AS total_amount, min(first_use) AS first_seen
  FROM pairs GROUP BY resource_type, resource_id HAVING COUNT(*) >= {cfg.ring_min_users}"""),
        ("best", """
  SELECT user_id, ring_id, resource_type AS ring_type, resource_id AS ring_resource, n_users AS ring_users,
         risk_score AS ring_risk
  FROM (SELECT p.user_id, r.*, row_number() OVER (PARTITION BY p.user_id ORDER BY r.risk_score DESC, r.first_seen,
               CASE r.resource_type WHEN 'device' THEN 0 ELSE 1 END, r.resource_id) AS rn
        FROM pairs p JOIN rings r USING (resource_type, resource_id)) x
  WHERE rn = 1"""),
    ]


_SCORED_SQL = f"""
SELECT a.*, {velocity_case(CFG)} AS s_vel, {amount_case(CFG)} AS s_amt,
       CASE WHEN a.dimension_key IN (SELECT value FROM bl) THEN 100 END AS s_bl,
       CASE WHEN b.ring_risk IS NOT NULL THEN least(round_even(b.ring_risk * 100.0::DOUBLE, 0), 100) END AS s_ring,
       b.ring_users, b.ring_type, b.ring_resource, b.ring_risk
FROM alerts a LEFT JOIN best b ON a.dimension_key = b.user_id"""

_SCORE_ALERTS = f"""
SELECT dimension, dimension_key, window_start, txn_count, total_amount,
       CAST(s_vel AS BIGINT) AS velocity_severity, CAST(s_amt AS BIGINT) AS amount_severity,
       CAST(s_bl AS BIGINT) AS blacklist_severity, CAST(s_ring AS BIGINT) AS ring_severity,
       {union_sql(['s_vel', 's_amt', 's_bl', 's_ring'])} AS score,
       {route_sql(union_sql(['s_vel', 's_amt', 's_bl', 's_ring']))} AS routing,
       concat_ws(',', CASE WHEN s_vel IS NOT NULL THEN 'velocity_alert' END,
                      CASE WHEN s_amt IS NOT NULL THEN 'high_window_amount' END,
                      CASE WHEN s_bl IS NOT NULL THEN 'blacklist' END,
                      CASE WHEN s_ring IS NOT NULL THEN 'fraud_ring' END) AS rule_ids,
       concat_ws(' | ',
         CASE WHEN s_vel IS NOT NULL THEN upper(dimension) || ' txn_count ' || txn_count || ' >= '
              || ({velocity_case(CFG, 'threshold')}) || ' (sev ' || s_vel || ')' END,
         CASE WHEN s_amt IS NOT NULL THEN 'total_amount ' || format('{{:,.2f}}', total_amount) || ' >= '
              || format('{{:,.0f}}', CAST({amount_case(CFG, 'threshold')} AS DOUBLE)) || ' (sev ' || s_amt || ')' END,
         CASE WHEN s_bl IS NOT NULL THEN 'dimension_key ''' || dimension_key || ''' is blacklisted' END,
         CASE WHEN s_ring IS NOT NULL THEN 'Fraud ring: ' || ring_users || ' members share ' || ring_type
              || ' ''' || ring_resource || '''' END) AS reasons
FROM scored"""

SCORE_EXTRA = WA + [("bl", BLACKLIST_SQL)] + ring_ctes() + [("scored", _SCORED_SQL)]


def scored_alerts(spark, sf, ml_scorer=None, model_version=None):
    tx = _tx(spark, sf)
    return scoring.score_alerts(
        velocity.velocity_alerts(tx, CFG), CFG, blacklist=_blacklist(spark, sf),
        user_rings=graph.user_best_ring(tx, CFG), ml_scorer=ml_scorer, model_version=model_version)


@query("score_alerts", with_fx(_SCORE_ALERTS, "fx_transactions", "fx_blacklist_ops", extra=SCORE_EXTRA))
def q_score_alerts(spark, sf):
    return scoring.flatten_scored(scored_alerts(spark, sf))


@query("route_scores", with_fx("""
SELECT dimension, routing, COUNT(*) AS n_alerts, min(score) AS min_score, max(score) AS max_score
FROM (""" + _SCORE_ALERTS + ") s GROUP BY dimension, routing", "fx_transactions", "fx_blacklist_ops",
                               extra=SCORE_EXTRA))
def q_route_scores(spark, sf):
    s = scored_alerts(spark, sf)
    return s.groupBy("dimension", "routing").agg(
        F.count(F.lit(1)).alias("n_alerts"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


@query("alerts_with_ring", with_fx("""
SELECT a.dimension, a.dimension_key, a.window_start, b.ring_id, b.ring_type, b.ring_resource, b.ring_users, b.ring_risk,
       CAST(least(round_even(b.ring_risk * 100.0::DOUBLE, 0), 100) AS BIGINT) AS ring_severity
FROM alerts a JOIN best b ON a.dimension_key = b.user_id""", "fx_transactions", extra=WA + ring_ctes()))
def q_alerts_with_ring(spark, sf):
    tx = _tx(spark, sf)
    a = velocity.velocity_alerts(tx, CFG)
    r = graph.user_best_ring(tx, CFG)
    j = a.join(r, a["dimension_key"] == r["user_id"])
    return j.select("dimension", "dimension_key", "window_start", "ring_id", "ring_type", "ring_resource", "ring_users",
                    "ring_risk", rules.RingRule().hit().getField("severity").alias("ring_severity"))


@query("txn_risk", with_fx(f"""
SELECT transaction_id, CAST(max(score) AS BIGINT) AS score, arg_max(dimension, {{'s': score, 'd': dimension}}) AS top_dimension,
       COUNT(*) AS n_alerts, {route_sql('max(score)')} AS routing
FROM (SELECT d.transaction_id, s.dimension, s.score
      FROM dims d JOIN (SELECT dimension, dimension_key, window_start, score FROM ({_SCORE_ALERTS}) z) s
        ON d.dimension = s.dimension AND d.dimension_key = s.dimension_key
       AND ((epoch_us(d.event_time) // 1000) // {CFG.window_ms}) * {CFG.window_ms} = s.window_start) j
GROUP BY transaction_id""", "fx_transactions", "fx_blacklist_ops", extra=SCORE_EXTRA))
def q_txn_risk(spark, sf):
    return scoring.txn_risk(_tx(spark, sf), scored_alerts(spark, sf), CFG)


_TOPIC_SQL = "CASE routing WHEN 'block' THEN 'fraud-alerts' WHEN 'review' THEN 'human-review' ELSE 'approved-transactions' END"


@query("fraud_results_from_alerts", with_fx(f"""
SELECT transaction_id, routing = 'block' AS is_fraud, CAST(score AS DOUBLE) / 100.0::DOUBLE AS score, {_TOPIC_SQL} AS routed_to,
       b.ring_id AS fraud_ring_id, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS scored_at
FROM (SELECT transaction_id, max(score) AS score, {route_sql('max(score)')} AS routing
      FROM (SELECT d.transaction_id, s.score
            FROM dims d JOIN (SELECT dimension, dimension_key, window_start, score FROM ({_SCORE_ALERTS}) z) s
              ON d.dimension = s.dimension AND d.dimension_key = s.dimension_key
             AND ((epoch_us(d.event_time) // 1000) // {CFG.window_ms}) * {CFG.window_ms} = s.window_start) j
      GROUP BY transaction_id) x
JOIN fx_transactions t USING (transaction_id) LEFT JOIN best b ON b.user_id = t.user_id""",
                                             "fx_transactions", "fx_blacklist_ops", extra=SCORE_EXTRA))
def q_fraud_results_from_alerts(spark, sf):
    tx = _tx(spark, sf)
    r = scoring.fraud_results(tx, scored_alerts(spark, sf), CFG, graph.user_best_ring(tx, CFG))
    return r.select("transaction_id", "is_fraud", F.col("score").cast("double").alias("score"), "routed_to",
                    "fraud_ring_id", F.date_format("scored_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("scored_at"))


_ADHOC = ["s_vel", "s_amt", "s_bl", "s_ring"]


@query("adhoc_scores", with_fx(f"""
SELECT transaction_id, dimension_key, CAST(s_vel AS BIGINT) AS velocity_severity, CAST(s_amt AS BIGINT) AS amount_severity,
       CAST(s_bl AS BIGINT) AS blacklist_severity, CAST(s_ring AS BIGINT) AS ring_severity,
       {union_sql(_ADHOC)} AS score, {route_sql(union_sql(_ADHOC))} AS routing
FROM (SELECT t.*, {velocity_case(CFG)} AS s_vel, {amount_case(CFG)} AS s_amt,
             CASE WHEN dimension_key IN (SELECT value FROM bl) THEN 100 END AS s_bl,
             CASE WHEN b.ring_risk IS NOT NULL THEN least(round_even(b.ring_risk * 100.0::DOUBLE, 0), 100) END AS s_ring
      FROM (SELECT transaction_id, 'USER' AS dimension, user_id AS dimension_key, 1 AS txn_count, amount AS total_amount
            FROM fx_transactions) t LEFT JOIN best b ON t.dimension_key = b.user_id) u""",
                                "fx_transactions", "fx_blacklist_ops", extra=[("bl", BLACKLIST_SQL)] + ring_ctes()))
def q_adhoc_scores(spark, sf):
    """All layers but the model's, whose scores no SQL gives (see score_alerts_ml)."""
    tx = _tx(spark, sf)
    a = scoring.adhoc_alerts(tx, label=CFG.window_label)
    sc = scoring.score_alerts(a, CFG, blacklist=_blacklist(spark, sf), user_rings=graph.user_best_ring(tx, CFG),
                              keep=("transaction_id",))
    return sc.select("transaction_id", "dimension_key",
                     *[F.col(c).cast("bigint").alias(c) for c in ("velocity_severity", "amount_severity",
                                                                  "blacklist_severity", "ring_severity")],
                     "score", "routing")
