"""Registered queries: A/B experiments and model registry."""

from __future__ import annotations


from riskstream.operators import ab
from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.q_velocity import CFG
from riskstream.plans.registry import query
from riskstream.sources import fixtures as fx

BUCKET_SQL = "(('0x' || substr(md5(transaction_id), 1, 8))::BIGINT % 10000)"


def _versions(spark, sf):
    """Model versions in use (a handful of rows), oldest first: one partially aggregated pass over
    the results, not the whole registry (which also joins feedback)."""
    from pyspark.sql import functions as F

    v = fx.fx_fraud_results(spark, sf).groupBy("model_version").agg(F.min("scored_at").alias("t"))
    return [r["model_version"] for r in v.orderBy("t", "model_version").collect()]


@query("ab_assign", with_fx(f"""
SELECT transaction_id, {BUCKET_SQL} AS bucket,
       CASE WHEN {BUCKET_SQL} < 2000 THEN 'challenger' ELSE 'control' END AS arm,
       CASE WHEN {BUCKET_SQL} < 2000 THEN 'v2.0' ELSE 'v1.0' END AS model_version,
       'exp-001' AS experiment_id
FROM fx_transactions""", "fx_transactions"))
def q_ab_assign(spark, sf):
    return ab.ab_assign(fx.fx_transactions(spark, sf), fx.experiments(spark), _versions(spark, sf), CFG)


@query("ab_assign_fallback", with_fx(f"""
SELECT transaction_id, {BUCKET_SQL} AS bucket,
       CASE WHEN {BUCKET_SQL} < 2000 THEN 'challenger' ELSE 'control' END AS arm, 'v1.0' AS model_version,
       'exp-001' AS experiment_id
FROM fx_transactions""", "fx_transactions"))
def q_ab_assign_fallback(spark, sf):
    """L2: the challenger's model is not there, so its share gets the control model."""
    return ab.ab_assign(fx.fx_transactions(spark, sf), fx.experiments(spark), ["v1.0"], CFG)


_METRICS = """
SELECT experiment_id, model_version, COUNT(*) AS total, COUNT(*) FILTER (WHERE coalesce(was_correct, false)) AS correct_count,
       CAST(SUM(latency_ms) AS DOUBLE) / COUNT(*) AS avg_latency_ms
FROM fx_ab_metrics GROUP BY experiment_id, model_version"""


@query("ab_metrics", with_fx(_METRICS, "fx_ab_metrics"))
def q_ab_metrics(spark, sf):
    return ab.ab_metrics(fx.fx_ab_metrics(spark, sf))


@query("ab_report", with_fx(f"""
SELECT e.experiment_id,
       max(CASE WHEN m.model_version = e.control_model_version THEN m.model_version END) AS control_version,
       max(CASE WHEN m.model_version = e.control_model_version THEN m.total END) AS control_total,
       max(CASE WHEN m.model_version = e.control_model_version THEN m.correct_count END) AS control_correct,
       max(CASE WHEN m.model_version = e.control_model_version THEN m.avg_latency_ms END) AS control_avg_latency_ms,
       max(CASE WHEN m.model_version = e.challenger_model_version THEN m.model_version END) AS challenger_version,
       max(CASE WHEN m.model_version = e.challenger_model_version THEN m.total END) AS challenger_total,
       max(CASE WHEN m.model_version = e.challenger_model_version THEN m.correct_count END) AS challenger_correct,
       max(CASE WHEN m.model_version = e.challenger_model_version THEN m.avg_latency_ms END) AS challenger_avg_latency_ms,
       coalesce(least(max(CASE WHEN m.model_version = e.control_model_version THEN m.total END),
                      max(CASE WHEN m.model_version = e.challenger_model_version THEN m.total END)), 0)
         >= {CFG.min_sample_size} AS ready
FROM m JOIN fx_experiments e USING (experiment_id)
WHERE m.model_version IN (e.control_model_version, e.challenger_model_version)
GROUP BY e.experiment_id""", "fx_ab_metrics", "fx_experiments", extra=[("m", _METRICS)]))
def q_ab_report(spark, sf):
    return ab.ab_report(fx.fx_ab_metrics(spark, sf), fx.experiments(spark), CFG)


@query("latency_p95", with_fx("""
SELECT model_version, round(quantile_cont(CAST(latency_ms AS DOUBLE), 0.95), 2) AS p95_latency_ms, COUNT(*) AS n
FROM fx_ab_metrics GROUP BY model_version""", "fx_ab_metrics"))
def q_latency_p95(spark, sf):
    return ab.latency_p95(fx.fx_ab_metrics(spark, sf))


@query("model_registry", with_fx("""
SELECT version, trained_at, training_data_count, feedback_count, notes,
       {'t': trained_at, 'v': version} = max({'t': trained_at, 'v': version}) OVER () AS is_active
FROM (
  SELECT 'v1.0' AS version, '2023-12-31 00:00:00' AS trained_at, CAST(0 AS BIGINT) AS training_data_count,
         CAST(0 AS BIGINT) AS feedback_count, 'seed' AS notes
  UNION ALL
  SELECT r.version, strftime(r.trained_at, '%Y-%m-%d %H:%M:%S'), r.n, coalesce(f.n, 0), 'derived'
  FROM (SELECT model_version AS version, min(scored_at) AS trained_at, COUNT(*) AS n FROM fx_fraud_results GROUP BY 1) r
  LEFT JOIN (SELECT r.model_version AS version, COUNT(*) AS n FROM fx_feedback f JOIN fx_fraud_results r USING (transaction_id)
             GROUP BY 1) f USING (version)
  WHERE r.version <> 'v1.0') v""", "fx_fraud_results", "fx_feedback"))
def q_model_registry(spark, sf):
    seed = spark.createDataFrame([("v1.0", "2023-12-31 00:00:00", 0, 0, "seed")],
                                 "version string, trained_at string, training_data_count bigint, "
                                 "feedback_count bigint, notes string")
    return ab.model_registry(fx.fx_fraud_results(spark, sf), fx.fx_feedback(spark, sf), seed)


@query("ab_metrics_corrected", with_fx("""
SELECT experiment_id, model_version, COUNT(*) AS total,
       COUNT(*) FILTER (WHERE coalesce(was_correct, false)) AS correct_count,
       CAST(SUM(latency_ms) AS DOUBLE) / COUNT(*) AS avg_latency_ms
FROM (SELECT m.experiment_id, m.model_version, m.latency_ms, coalesce(c.was_correct, m.was_correct) AS was_correct
      FROM fx_ab_metrics m LEFT JOIN (
        SELECT transaction_id,
               max(epoch_us(created_at) * 2 + CAST(verdict = 'true_positive' AS INTEGER)) % 2 = 1 AS was_correct
        FROM fx_feedback GROUP BY transaction_id) c USING (transaction_id)) x
GROUP BY experiment_id, model_version""", "fx_ab_metrics", "fx_feedback"))
def q_ab_metrics_corrected(spark, sf):
    """L3 + D10: analyst verdicts applied to every metric row of their transaction, then aggregated."""
    m = ab.apply_correctness(fx.fx_ab_metrics(spark, sf), ab.corrections_from_feedback(fx.fx_feedback(spark, sf)))
    return ab.ab_metrics(m)
