"""Registered queries: analyst feedback loop and review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskstream.operators import feedback as FB
from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.oracle_parts import dims_sql, windows_sql
from riskstream.plans.q_velocity import CFG
from riskstream.plans.registry import query
from riskstream.sources import fixtures as fx

SINCE = "2024-01-15 00:00:00"  # the last retrain time (a parameter of C1 / M3 / M4)
LABEL_SQL = "verdict IN ('true_positive', 'false_negative')"


@query("feedback_labels", with_fx(f"""
SELECT feedback_id, transaction_id, verdict, {LABEL_SQL} AS is_fraud FROM fx_feedback""", "fx_feedback"))
def q_feedback_labels(spark, sf):
    f = fx.fx_feedback(spark, sf)
    return f.select("feedback_id", "transaction_id", "verdict", FB.fraud_label().alias("is_fraud"))


@query("labeled_data", with_fx(f"""
SELECT f.transaction_id, t.user_id, t.amount, t.merchant_id, strftime(t.event_time, '%Y-%m-%d %H:%M:%S') AS event_time,
       f.verdict, {LABEL_SQL} AS is_fraud
FROM fx_feedback f JOIN fx_transactions t USING (transaction_id)
WHERE f.created_at >= TIMESTAMP '{SINCE}'""", "fx_feedback", "fx_transactions"))
def q_labeled_data(spark, sf):
    d = FB.labeled_data(fx.fx_feedback(spark, sf), fx.fx_transactions(spark, sf), SINCE)
    return d.select("transaction_id", "user_id", "amount", "merchant_id",
                    F.date_format("event_time", "yyyy-MM-dd HH:mm:ss").alias("event_time"), "verdict", "is_fraud")


@query("feedback_enriched", with_fx("""
SELECT f.feedback_id, f.transaction_id, f.analyst_id, f.verdict,
       coalesce(CAST(r.score AS DOUBLE), 0.0) AS original_score, coalesce(r.model_version, 'unknown') AS original_model_version
FROM fx_feedback f LEFT JOIN fx_fraud_results r USING (transaction_id)""", "fx_feedback", "fx_fraud_results"))
def q_feedback_enriched(spark, sf):
    e = FB.feedback_enriched(fx.fx_feedback(spark, sf), fx.fx_fraud_results(spark, sf))
    return e.select("feedback_id", "transaction_id", "analyst_id", "verdict", "original_score", "original_model_version")


_PENDING = """
SELECT i.transaction_id, min(i.seq) AS position, max(i.seq) AS last_arrival, COUNT(*) AS arrivals,
       CAST(arg_max(i.score, i.seq) AS DOUBLE) AS score
FROM fx_review_events i
LEFT JOIN (SELECT transaction_id, max(seq) AS last_review FROM fx_review_events WHERE kind = 'review'
           GROUP BY transaction_id) r USING (transaction_id)
WHERE i.kind = 'item' AND (r.last_review IS NULL OR i.seq > r.last_review)
GROUP BY i.transaction_id"""


def _pending(spark, sf):
    p = FB.review_queue(fx.fx_review_events(spark, sf))
    return p.select("transaction_id", "position", "last_arrival", "arrivals", F.col("score").cast("double").alias("score"))


@query("review_pending", with_fx(_PENDING, "fx_review_events"))
def q_review_pending(spark, sf):
    return _pending(spark, sf)


@query("review_page", with_fx("SELECT * FROM pending ORDER BY position, transaction_id LIMIT 50 OFFSET 50",
                              "fx_review_events", extra=[("pending", _PENDING)]))
def q_review_page(spark, sf):
    return FB.review_page(_pending(spark, sf), limit=50, offset=50)


def _pages(spark, sf):
    """The pending queue in ranges of about a tenth of it: written once, as a snapshot that pages are turned in."""
    from riskstream.operators.pages import OrderedPages

    p = _pending(spark, sf)
    return OrderedPages.write(p, ["position", "transaction_id"], rows=max(1, p.count() // 10))


@query("review_deep_page", with_fx("""SELECT * FROM pending ORDER BY position, transaction_id
LIMIT 50 OFFSET (SELECT COUNT(*) * 3 // 4 FROM pending)""", "fx_review_events", extra=[("pending", _PENDING)]))
def q_review_deep_page(spark, sf):
    """the page three quarters down the queue, by the counts of its ranges."""
    pages = _pages(spark, sf)
    return pages.page(pages.count * 3 // 4, 50)


@query("review_next_page", with_fx("""SELECT * FROM pending ORDER BY position, transaction_id
LIMIT 50 OFFSET (SELECT COUNT(*) // 2 + 50 FROM pending)""", "fx_review_events", extra=[("pending", _PENDING)]))
def q_review_next_page(spark, sf):
    """the page after the last row of the one half way down, by that row's key."""
    pages = _pages(spark, sf)
    seen = pages.page(pages.count // 2, 50).collect()  # one page
    return pages.after((seen[-1]["position"], seen[-1]["transaction_id"]), 50) if seen else pages.page(0, 50)


@query("retrain_due", with_fx(f"""
SELECT COUNT(*) AS feedback_count, {CFG.feedback_retrain_threshold} AS threshold,
       COUNT(*) >= {CFG.feedback_retrain_threshold} AS due
FROM fx_feedback WHERE created_at >= TIMESTAMP '{SINCE}'""", "fx_feedback"))
def q_retrain_due(spark, sf):
    return FB.retrain_due(fx.fx_feedback(spark, sf), SINCE, CFG)


@query("retrain_set", with_fx(f"""
SELECT l.transaction_id, l.is_fraud, w.dimension_key, w.window_start,
       CAST(w.txn_count AS DOUBLE) AS txn_count_f, w.total_amount AS total_amount_f,
       greatest(CAST(w.window_end - w.window_start AS DOUBLE), 1.0) / 60000.0 AS duration_min,
       CASE WHEN w.txn_count > 0 THEN w.total_amount / w.txn_count ELSE 0.0 END AS amount_per_txn
FROM (SELECT f.transaction_id, {LABEL_SQL} AS is_fraud, t.user_id,
             ((epoch_us(t.event_time) // 1000) // {CFG.window_ms}) * {CFG.window_ms} AS window_start
      FROM fx_feedback f JOIN fx_transactions t USING (transaction_id)
      WHERE f.created_at >= TIMESTAMP '{SINCE}') l
JOIN windows w ON w.dimension = 'USER' AND w.dimension_key = l.user_id AND w.window_start = l.window_start""",
                               "fx_feedback", "fx_transactions", extra=[("dims", dims_sql()), ("windows", windows_sql(CFG))]))
def q_retrain_set(spark, sf):
    return FB.retrain_set(fx.fx_feedback(spark, sf), fx.fx_transactions(spark, sf), SINCE, CFG)


@query("feedback_quality", with_fx("""
SELECT original_model_version, COUNT(*) AS reviews,
       COUNT(*) FILTER (WHERE verdict = 'true_positive') AS tp,
       COUNT(*) FILTER (WHERE verdict = 'false_positive') AS fp,
       COUNT(*) FILTER (WHERE verdict = 'false_negative') AS fn,
       CASE WHEN COUNT(*) FILTER (WHERE verdict IN ('true_positive', 'false_positive')) > 0 THEN
            round(CAST(COUNT(*) FILTER (WHERE verdict = 'true_positive') AS DOUBLE)
                  / COUNT(*) FILTER (WHERE verdict IN ('true_positive', 'false_positive')), 4) END AS precision
FROM (SELECT f.verdict, coalesce(r.model_version, 'unknown') AS original_model_version
      FROM fx_feedback f LEFT JOIN fx_fraud_results r USING (transaction_id)) e
GROUP BY original_model_version""", "fx_feedback", "fx_fraud_results"))
def q_feedback_quality(spark, sf):
    return FB.feedback_quality(fx.fx_feedback(spark, sf), fx.fx_fraud_results(spark, sf))


@query("feedback_submitted", with_fx("""
SELECT f.feedback_id, f.transaction_id, f.verdict, coalesce(CAST(r.score AS DOUBLE), 0.0::DOUBLE) AS original_score,
       coalesce(r.model_version, 'unknown') AS original_model_version, f.transaction_id AS message_key,
       epoch_us(f.created_at) // 1000 AS dequeue_seq
FROM fx_feedback f LEFT JOIN fx_fraud_results r USING (transaction_id)
WHERE f.verdict IN ('true_positive', 'false_positive', 'false_negative')""", "fx_feedback", "fx_fraud_results"))
def q_feedback_submitted(spark, sf):
    """M2: the stored rows, with their messages' keys and the queue events that they cause."""
    rows, messages, dequeue = FB.submit_feedback(fx.fx_feedback(spark, sf), fx.fx_fraud_results(spark, sf))
    keys = messages.select(F.get_json_object("value", "$.feedback_id").alias("feedback_id"), F.col("key").alias("message_key"))
    events = dequeue.select("transaction_id", F.col("seq").alias("dequeue_seq"))
    return rows.join(keys, "feedback_id").join(events, "transaction_id").select(
        "feedback_id", "transaction_id", "verdict", "original_score", "original_model_version", "message_key", "dequeue_seq")


@query("retrain_event", with_fx(f"""
SELECT 'model_retrained' AS event, strftime(max(created_at), '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
       (SELECT COUNT(*) FROM fx_feedback f JOIN fx_transactions t USING (transaction_id)) AS samples_used,
       COUNT(*) AS feedback_count
FROM fx_feedback HAVING COUNT(*) >= {CFG.feedback_retrain_threshold}""", "fx_feedback", "fx_transactions"))
def q_retrain_event(spark, sf):
    return FB.retrain_event(fx.fx_feedback(spark, sf), fx.fx_transactions(spark, sf), None, CFG)
