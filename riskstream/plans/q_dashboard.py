"""Registered queries: dashboard parts."""

from __future__ import annotations

from riskstream.operators import dashboard as D
from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.q_velocity import CFG
from riskstream.plans.registry import query
from riskstream.sources import fixtures as fx

ACTION_SQL = ("CASE WHEN routed_to IN ('fraud-alerts', 'block') THEN 'Block' "
              "WHEN routed_to IN ('human-review', 'review') THEN 'Challenge' ELSE 'Allow' END")


def _tr(spark, sf):
    return fx.fx_transactions(spark, sf), fx.fx_fraud_results(spark, sf)


@query("dashboard_kpis", with_fx(f"""
SELECT t AS transactions_scanned,
       round(CASE WHEN t > 0 THEN CAST(f AS DOUBLE) / t * 100 ELSE 0 END, 2) AS high_risk_rate_pct,
       round(CASE WHEN sn > 0 THEN CAST(ss AS DOUBLE) / sn ELSE 0 END, 4) AS avg_model_score,
       round(coalesce(p95, 0), 2) AS p95_latency_ms,
       round(CASE WHEN t > 0 THEN CAST(rv + f AS DOUBLE) / t * 100 ELSE 0 END, 2) AS false_positive_proxy_pct,
       CAST(0 AS BIGINT) AS model_error_count,
       {CFG.risk_threshold}::DOUBLE AS risk_threshold, f AS fraud_count, rv AS review_count, fb AS feedback_count
FROM (SELECT (SELECT COUNT(*) FROM fx_transactions) AS t,
             (SELECT COUNT(*) FROM fx_fraud_results WHERE is_fraud) AS f,
             (SELECT COUNT(*) FROM fx_fraud_results WHERE routed_to = 'human-review') AS rv,
             (SELECT SUM(score) FROM fx_fraud_results) AS ss,
             (SELECT COUNT(score) FROM fx_fraud_results) AS sn,
             (SELECT COUNT(*) FROM fx_feedback) AS fb,
             (SELECT quantile_cont(CAST(latency_ms AS DOUBLE), 0.95) FROM fx_ab_metrics) AS p95) k""",
                                  "fx_transactions", "fx_fraud_results", "fx_feedback", "fx_ab_metrics"))
def q_dashboard_kpis(spark, sf):
    t, r = _tr(spark, sf)
    return D.kpis(t, r, fx.fx_feedback(spark, sf), fx.fx_ab_metrics(spark, sf), CFG)


_HIST = """
SELECT b.range AS bucket, printf('%.1f-%.1f', b.range / 10.0, (b.range + 1) / 10.0) AS bucket_label,
       coalesce(c.n, 0) AS count
FROM range(10) b LEFT JOIN (
  SELECT CAST(least(floor(score * 10), 9) AS BIGINT) AS bucket, COUNT(*) AS n FROM fx_fraud_results GROUP BY 1) c
  ON b.range = c.bucket"""


@query("score_histogram", with_fx(_HIST, "fx_fraud_results"))
def q_score_histogram(spark, sf):
    return D.score_histogram(fx.fx_fraud_results(spark, sf))


_MIX = f"""
SELECT a.action, coalesce(c.n, 0) AS count
FROM (VALUES ('Allow'), ('Block'), ('Challenge')) a(action)
LEFT JOIN (SELECT {ACTION_SQL} AS action, COUNT(*) AS n FROM fx_fraud_results GROUP BY 1) c USING (action)"""


@query("decision_mix", with_fx(_MIX, "fx_fraud_results"))
def q_decision_mix(spark, sf):
    return D.decision_mix(spark, fx.fx_fraud_results(spark, sf))


@query("decision_share", with_fx("""
SELECT action, count, round(pct, 2) AS pct,
       CASE WHEN action IN ('Block', 'Challenge') AND pct >= 30 THEN 'danger'
            WHEN action IN ('Block', 'Challenge') AND pct >= 22 THEN 'warn' END AS alarm
FROM (SELECT action, count, CASE WHEN SUM(count) OVER () > 0
                                 THEN CAST(count AS DOUBLE) / SUM(count) OVER () * 100 ELSE 0 END AS pct
      FROM mix) s""", "fx_fraud_results", extra=[("mix", _MIX)]))
def q_decision_share(spark, sf):
    return D.decision_share(D.decision_mix(spark, fx.fx_fraud_results(spark, sf)))


@query("minute_trend", with_fx("""
SELECT strftime(date_trunc('minute', t.event_time), '%Y-%m-%d %H:%M') AS minute_label, COUNT(*) AS scanned,
       COUNT(*) FILTER (WHERE r.is_fraud) AS flagged
FROM fx_transactions t LEFT JOIN fx_fraud_results r USING (transaction_id)
GROUP BY 1 ORDER BY 1 DESC LIMIT 20""", "fx_transactions", "fx_fraud_results"))
def q_minute_trend(spark, sf):
    return D.minute_trend(*_tr(spark, sf))


@query("minute_trend_labels", with_fx("""
SELECT strftime(t.event_time, '%H:%M') AS minute_label, COUNT(*) AS scanned,
       COUNT(*) FILTER (WHERE r.is_fraud) AS flagged
FROM fx_transactions t LEFT JOIN fx_fraud_results r USING (transaction_id)
GROUP BY 1 ORDER BY 1 DESC LIMIT 20""", "fx_transactions", "fx_fraud_results"))
def q_minute_trend_labels(spark, sf):
    return D.minute_trend(*_tr(spark, sf), label_only=True)


@query("location_matrix", with_fx("""
SELECT t.location AS channel,
       COUNT(*) FILTER (WHERE r.routed_to = 'approved-transactions') AS "Allow",
       COUNT(*) FILTER (WHERE r.routed_to = 'fraud-alerts') AS "Block",
       COUNT(*) FILTER (WHERE r.routed_to = 'human-review') AS "Challenge",
       COUNT(*) AS total
FROM fx_transactions t JOIN fx_fraud_results r USING (transaction_id)
GROUP BY 1 ORDER BY total DESC, channel LIMIT 10""", "fx_transactions", "fx_fraud_results"))
def q_location_matrix(spark, sf):
    return D.location_matrix(*_tr(spark, sf))


@query("top_risky_merchants", with_fx(f"""
SELECT merchant, flagged_count, round(CAST(s AS DOUBLE) / flagged_count, 4) AS avg_score,
       round(CAST(f AS DOUBLE) / flagged_count * 100, 2) AS high_risk_rate_pct,
       CASE WHEN round(CAST(f AS DOUBLE) / flagged_count * 100, 2) >= 24 THEN 'high'
            WHEN round(CAST(f AS DOUBLE) / flagged_count * 100, 2) >= 14 THEN 'medium' ELSE 'low' END AS risk_band
FROM (SELECT t.merchant_id AS merchant, COUNT(*) AS flagged_count, SUM(r.score) AS s,
             COUNT(*) FILTER (WHERE r.is_fraud) AS f
      FROM fx_transactions t JOIN fx_fraud_results r USING (transaction_id)
      WHERE r.score >= {CFG.flagged_score} GROUP BY 1) g
ORDER BY flagged_count DESC, merchant LIMIT 10""", "fx_transactions", "fx_fraud_results"))
def q_top_risky_merchants(spark, sf):
    return D.top_risky_merchants(*_tr(spark, sf), CFG)


@query("recent_flagged", with_fx(f"""
SELECT strftime(t.event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time,
       substring(t.transaction_id, 1, 12) || '...' AS "tranID", t.merchant_id AS merchant, t.location AS channel,
       {ACTION_SQL} AS action, round(CAST(r.score AS DOUBLE), 4) AS score,
       r.score >= {CFG.risk_threshold} AS over_threshold, CAST(0 AS BIGINT) AS latency_ms
FROM fx_transactions t JOIN fx_fraud_results r USING (transaction_id)
WHERE r.score >= {CFG.flagged_score}
ORDER BY t.event_time DESC, t.transaction_id LIMIT 20""", "fx_transactions", "fx_fraud_results"))
def q_recent_flagged(spark, sf):
    return D.recent_flagged(*_tr(spark, sf), CFG)


@query("system_metrics", with_fx("""
SELECT (SELECT COUNT(*) FROM fx_transactions) AS total_transactions,
       (SELECT COUNT(*) FROM fx_fraud_results WHERE routed_to = 'fraud-alerts') AS fraud_detected,
       (SELECT COUNT(*) FROM fx_fraud_results WHERE routed_to = 'human-review') AS pending_review,
       (SELECT COUNT(*) FROM fx_fraud_results WHERE routed_to = 'approved-transactions') AS approved,
       (SELECT COUNT(*) FROM fx_feedback) AS feedback_count,
       (SELECT COUNT(*) FROM fx_experiments WHERE status = 'active') AS active_experiments""",
                                 "fx_transactions", "fx_fraud_results", "fx_feedback", "fx_experiments"))
def q_system_metrics(spark, sf):
    t, r = _tr(spark, sf)
    return D.system_metrics(t, r, fx.fx_feedback(spark, sf), fx.experiments(spark))


@query("histogram_spikes", with_fx("""
SELECT day, bucket, bucket_label, count, prev, max_count,
       CASE WHEN prev < max_count * 0.84::DOUBLE AND count >= max_count * 0.84::DOUBLE THEN 'red'
            WHEN prev < max_count * 0.68::DOUBLE AND count >= max_count * 0.68::DOUBLE
                 AND count < max_count * 0.84::DOUBLE THEN 'amber' END AS spike,
       CASE WHEN (CAST(split_part(bucket_label, '-', 1) AS DOUBLE) + CAST(split_part(bucket_label, '-', 2) AS DOUBLE)) / 2 >= 0.7
            THEN 'high'
            WHEN (CAST(split_part(bucket_label, '-', 1) AS DOUBLE) + CAST(split_part(bucket_label, '-', 2) AS DOUBLE)) / 2 >= 0.4
            THEN 'mid' ELSE 'low' END AS tier
FROM (
  SELECT day, bucket, printf('%.1f-%.1f', bucket / 10.0, (bucket + 1) / 10.0) AS bucket_label, count,
         coalesce(lag(count) OVER (PARTITION BY bucket ORDER BY day), 0) AS prev,
         greatest(1, max(count) OVER (PARTITION BY day)) AS max_count
  FROM (SELECT day, bucket, CAST(SUM(n) OVER (PARTITION BY bucket ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS count
        FROM (SELECT d.day, b.range AS bucket, coalesce(x.n, 0) AS n
              FROM (SELECT DISTINCT day FROM daily) d CROSS JOIN range(10) b
              LEFT JOIN daily x ON x.day = d.day AND x.bucket = b.range) g) c) p""",
                                   "fx_fraud_results", extra=[("daily", """
SELECT strftime(date_trunc('day', scored_at), '%Y-%m-%d') AS day,
       CAST(least(floor(score * 10), 9) AS BIGINT) AS bucket, COUNT(*) AS n
FROM fx_fraud_results GROUP BY 1, 2""")]))
def q_histogram_spikes(spark, sf):
    return D.histogram_history(fx.fx_fraud_results(spark, sf))


@query("snapshot_delta", with_fx("""
SELECT channel, day, "Allow", "Block", "Challenge", total,
       "Allow" > prev_Allow AS "Allow_increased", "Block" > prev_Block AS "Block_increased",
       "Challenge" > prev_Challenge AS "Challenge_increased", total > prev_total AS total_increased,
       prev_Allow, prev_Block, prev_Challenge, prev_total
FROM (
  SELECT channel, day, "Allow", "Block", "Challenge", total,
         coalesce(lag("Allow") OVER w, 0) AS prev_Allow, coalesce(lag("Block") OVER w, 0) AS prev_Block,
         coalesce(lag("Challenge") OVER w, 0) AS prev_Challenge, coalesce(lag(total) OVER w, 0) AS prev_total
  FROM (
    SELECT channel, day,
           CAST(SUM(a) OVER r AS BIGINT) AS "Allow", CAST(SUM(b) OVER r AS BIGINT) AS "Block",
           CAST(SUM(c) OVER r AS BIGINT) AS "Challenge", CAST(SUM(t) OVER r AS BIGINT) AS total
    FROM (SELECT t.location AS channel, strftime(date_trunc('day', r.scored_at), '%Y-%m-%d') AS day,
                 COUNT(*) FILTER (WHERE r.routed_to = 'approved-transactions') AS a,
                 COUNT(*) FILTER (WHERE r.routed_to = 'fraud-alerts') AS b,
                 COUNT(*) FILTER (WHERE r.routed_to = 'human-review') AS c, COUNT(*) AS t
          FROM fx_transactions t JOIN fx_fraud_results r USING (transaction_id) GROUP BY 1, 2) d
    WINDOW r AS (PARTITION BY channel ORDER BY day ROWS UNBOUNDED PRECEDING)) s
  WINDOW w AS (PARTITION BY channel ORDER BY day)) x""", "fx_transactions", "fx_fraud_results"))
def q_snapshot_delta(spark, sf):
    return D.channel_history(*_tr(spark, sf))


def _melt_sql(part: str, item: str | None, metrics: list[str], body: str) -> str:
    it = f'CAST("{item}" AS VARCHAR)' if item else "''"
    return "\nUNION ALL\n".join(
        f"SELECT '{part}' AS part, {it} AS item, '{m}' AS metric, CAST(\"{m}\" AS DOUBLE) AS value, "
        f"CAST(NULL AS VARCHAR) AS text FROM ({body}) x" for m in metrics)


def _snapshot_sql() -> str:
    from riskstream.plans.registry import ORACLES

    parts = [
        ("kpis", None, D.KPI_METRICS, "dashboard_kpis"),
        ("score_distribution", "bucket_label", ["count"], "score_histogram"),
        ("decision_mix", "action", ["count"], "decision_mix"),
        ("trend", "minute_label", ["scanned", "flagged"], "minute_trend"),
        ("channel_matrix", "channel", ["Allow", "Block", "Challenge", "total"], "location_matrix"),
        ("top_risky_merchants", "merchant", ["flagged_count", "avg_score", "high_risk_rate_pct"], "top_risky_merchants"),
        ("recent_flagged_transactions", "tranID", ["score", "latency_ms"], "recent_flagged"),
    ]
    sql = [_melt_sql(p, i, m, ORACLES[q]) for p, i, m, q in parts]
    sql += [f"SELECT 'recent_flagged_transactions', CAST(\"tranID\" AS VARCHAR), '{m}', CAST(NULL AS DOUBLE), "
            f"CAST({m} AS VARCHAR) FROM ({ORACLES['recent_flagged']}) x" for m in ("event_time", "merchant", "channel", "action")]
    sql.append("SELECT 'state', '', 'state_note', CAST(NULL AS DOUBLE), CASE WHEN feedback_count > 0 THEN "
               "feedback_count || ' analyst feedback entries recorded' END FROM (" + ORACLES["dashboard_kpis"] + ") x")
    return "\nUNION ALL\n".join(sql)


@query("dashboard_snapshot", _snapshot_sql())
def q_dashboard_snapshot(spark, sf):
    t, r = _tr(spark, sf)
    return D.snapshot(spark, t, r, fx.fx_feedback(spark, sf), fx.fx_ab_metrics(spark, sf), CFG)


@query("dashboard_view", _snapshot_sql())
def q_dashboard_view(spark, sf):
    """The same snapshot from three triggers of the incremental view. Results come with their transaction, a trigger
    later or before it."""
    import uuid

    from pyspark.sql import functions as F

    from riskstream.session import checkpoint_dir
    from riskstream.streaming.dashboard_view import DashboardView

    t, r = _tr(spark, sf)
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(3))
    view = DashboardView(f"{checkpoint_dir(spark).rstrip('/')}/views/dashboard-{uuid.uuid4().hex[:12]}", CFG)
    feedback, metrics = fx.fx_feedback(spark, sf), fx.fx_ab_metrics(spark, sf)
    for b in range(3):
        late = F.least(F.lit(2), of("transaction_id") + F.pmod(F.xxhash64("transaction_id", F.lit(1)), F.lit(2)))
        early = F.when(F.pmod(F.xxhash64("transaction_id", F.lit(2)), F.lit(5)) == 0, F.lit(0)).otherwise(late)
        snap = view.refresh(spark, t.where(of("transaction_id") == b), r.where(early == b), feedback.where(of("feedback_id") == b),
                            metrics.where(of("transaction_id") == b), b)
    return snap


@query("newest_flagged_history", with_fx(f"""
SELECT day, substring(newest_id, 1, 12) || '...' AS "tranID",
       (lag(newest_id) OVER (ORDER BY day)) IS NULL OR lag(newest_id) OVER (ORDER BY day) <> newest_id AS changed
FROM (SELECT d.day, (SELECT f.transaction_id FROM flagged f WHERE f.day <= d.day
                     ORDER BY f.event_time DESC, f.transaction_id LIMIT 1) AS newest_id
      FROM (SELECT DISTINCT day FROM flagged) d) x""", "fx_transactions", "fx_fraud_results", extra=[("flagged", f"""
SELECT t.transaction_id, t.event_time, strftime(date_trunc('day', r.scored_at), '%Y-%m-%d') AS day
FROM fx_transactions t JOIN fx_fraud_results r USING (transaction_id) WHERE r.score >= {CFG.flagged_score}""")]))
def q_newest_flagged_history(spark, sf):
    return D.newest_flagged_history(*_tr(spark, sf), CFG)


@query("review_queue_depth", with_fx("""
SELECT COUNT(*) AS pending, CAST(ceil(COUNT(*) / 50.0) AS BIGINT) AS pages FROM (
  SELECT i.transaction_id FROM fx_review_events i
  LEFT JOIN (SELECT transaction_id, max(seq) AS last_review FROM fx_review_events WHERE kind = 'review'
             GROUP BY transaction_id) r USING (transaction_id)
  WHERE i.kind = 'item' AND (r.last_review IS NULL OR i.seq > r.last_review)
  GROUP BY i.transaction_id) p""", "fx_review_events"))
def q_review_queue_depth(spark, sf):
    """Pending queue depth and page count at the default page size (50)."""
    from pyspark.sql import functions as F

    from riskstream.operators import feedback as FB

    p = FB.review_queue(fx.fx_review_events(spark, sf))
    return p.agg(F.count(F.lit(1)).alias("pending")).select(
        "pending", F.ceil(F.col("pending") / F.lit(50.0)).cast("bigint").alias("pages"))
