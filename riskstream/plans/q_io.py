"""Registered queries: upserts, lookups, decoding and constraint checks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskstream.operators import quality, state
from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.registry import query
from riskstream.session import checkpoint_dir
from riskstream.sources import fixtures as fx
from riskstream.sources import io
from riskstream.sources.keyed_table import KeyedTable

TS = "%Y-%m-%d %H:%M:%S.%f"
TS_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"


UPSERTED_TRANSACTIONS = with_fx(f"""
SELECT transaction_id, arg_max(user_id, seq) AS user_id, arg_max(amount, seq) AS amount,
       arg_min(currency, seq) AS currency, strftime(arg_min(event_time, seq), '{TS}') AS event_time,
       arg_min(merchant_id, seq) AS merchant_id, arg_min(location, seq) AS location,
       arg_min(device_id, seq) AS device_id, arg_min(ip_address, seq) AS ip_address, COUNT(*) AS n_versions
FROM fx_transaction_updates GROUP BY transaction_id""", "fx_transaction_updates")


@query("upsert_transactions", UPSERTED_TRANSACTIONS)
def q_upsert_transactions(spark, sf):
    u = state.upsert_partial(fx.fx_transaction_updates(spark, sf), "transaction_id", ["user_id", "amount"])
    return u.withColumn("event_time", F.date_format("event_time", TS_SPARK))


UPSERTED_RESULTS = with_fx(f"""
SELECT transaction_id, CAST(arg_max(score, seq) AS DOUBLE) AS score, arg_max(is_fraud, seq) AS is_fraud,
       arg_max(routed_to, seq) AS routed_to, arg_min(model_version, seq) AS model_version,
       strftime(arg_min(scored_at, seq), '{TS}') AS scored_at, COUNT(*) AS n_versions
FROM fx_result_updates GROUP BY transaction_id""", "fx_result_updates")


@query("upsert_fraud_results", UPSERTED_RESULTS)
def q_upsert_fraud_results(spark, sf):
    u = state.upsert_partial(fx.fx_result_updates(spark, sf), "transaction_id", ["score", "is_fraud", "routed_to"])
    return u.select("transaction_id", F.col("score").cast("double").alias("score"), "is_fraud", "routed_to",
                    "model_version", F.date_format("scored_at", TS_SPARK).alias("scored_at"), "n_versions")


def _merged(spark, name, changes, update, batches, buckets=16):
    """A new keyed table with the change log merged one batch of sequence numbers after the other."""
    table = KeyedTable.create(spark, f"{checkpoint_dir(spark).rstrip('/')}/keyed/{name}-{uuid.uuid4().hex[:12]}",
                              changes.drop("seq").schema, ["transaction_id"], update, buckets)
    for n in batches:
        table = table.merge(changes.where(F.col("seq") == n), batch_id=n)
    return table


@query("upsert_transactions_incremental", UPSERTED_TRANSACTIONS)
def q_upsert_transactions_incremental(spark, sf):
    """The change log as three merges into a keyed table."""
    t = _merged(spark, "transactions", fx.fx_transaction_updates(spark, sf), ["user_id", "amount"], (1, 2, 3))
    return t.read().withColumn("event_time", F.date_format("event_time", TS_SPARK))


@query("upsert_fraud_results_incremental", UPSERTED_RESULTS)
def q_upsert_fraud_results_incremental(spark, sf):
    """A10: the re-scored results arrive before the first ones; what is first and latest follows the sequence."""
    t = _merged(spark, "results", fx.fx_result_updates(spark, sf), ["score", "is_fraud", "routed_to"], ())
    changes = fx.fx_result_updates(spark, sf)
    for n in (2, 1):
        t = t.merge(changes.where(F.col("seq") == n))
    return t.read().select("transaction_id", F.col("score").cast("double").alias("score"), "is_fraud", "routed_to", "model_version",
                           F.date_format("scored_at", TS_SPARK).alias("scored_at"), "n_versions")


@query("lookup_by_key", with_fx("""
SELECT transaction_id, CAST(score AS DOUBLE) AS score, routed_to FROM fx_fraud_results
WHERE transaction_id IN (SELECT transaction_id FROM fx_review_events)""", "fx_review_events", "fx_fraud_results"))
def q_lookup_by_key(spark, sf):
    """The results of the transactions that ever waited for a review, by key from the keyed table."""
    t = _merged(spark, "lookup", fx.fx_fraud_results(spark, sf).withColumn("seq", F.lit(1)), ["score", "is_fraud", "routed_to"], (1,))
    return t.lookup(fx.fx_review_events(spark, sf)).select("transaction_id", F.col("score").cast("double").alias("score"), "routed_to")


@query("transaction_detail", with_fx("""
SELECT q.transaction_id, t.user_id, t.amount, t.merchant_id, r.transaction_id IS NOT NULL AS has_result,
       CAST(r.score AS DOUBLE) AS score, r.routed_to, r.model_version
FROM (SELECT DISTINCT transaction_id FROM fx_feedback) q
JOIN fx_transactions t USING (transaction_id)
LEFT JOIN fx_fraud_results r USING (transaction_id)""", "fx_feedback", "fx_transactions", "fx_fraud_results"))
def q_transaction_detail(spark, sf):
    req = fx.fx_feedback(spark, sf).select("transaction_id").distinct()
    t = fx.fx_transactions(spark, sf).select("transaction_id", "user_id", "amount", "merchant_id")
    r = fx.fx_fraud_results(spark, sf).select("transaction_id", F.col("score").cast("double").alias("score"),
                                              "routed_to", "model_version", F.lit(True).alias("_hit"))
    j = req.join(t, "transaction_id").join(r, "transaction_id", "left")
    return j.select("transaction_id", "user_id", "amount", "merchant_id",
                    F.coalesce("_hit", F.lit(False)).alias("has_result"), "score", "routed_to", "model_version")


@query("get_by_key", with_fx("""
SELECT q.transaction_id, r.transaction_id IS NOT NULL AS found, CAST(r.score AS DOUBLE) AS score, r.routed_to
FROM (SELECT DISTINCT transaction_id FROM fx_review_events) q LEFT JOIN fx_fraud_results r USING (transaction_id)""",
                              "fx_review_events", "fx_fraud_results"))
def q_get_by_key(spark, sf):
    """A13, batched: point lookups of result rows for a table of requested keys (misses kept)."""
    req = fx.fx_review_events(spark, sf).select("transaction_id").distinct()
    r = fx.fx_fraud_results(spark, sf).select("transaction_id", F.col("score").cast("double").alias("score"),
                                              "routed_to", F.lit(True).alias("_hit"))
    j = req.join(r, "transaction_id", "left")
    return j.select("transaction_id", F.coalesce("_hit", F.lit(False)).alias("found"), "score", "routed_to")


@query("user_history", with_fx(f"""
SELECT user_id, transaction_id, rn, amount, strftime(event_time, '{TS}') AS event_time FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_time DESC, transaction_id) AS rn
  FROM fx_transactions) x WHERE rn <= 100""", "fx_transactions"))
def q_user_history(spark, sf):
    """F1, all users: the newest 100 per user. ``row_number <= k`` lets Spark insert a partial
    WindowGroupLimit before the shuffle, so a hot user ships at most k rows per map task."""
    t = fx.fx_transactions(spark, sf)
    w = Window.partitionBy("user_id").orderBy(F.col("event_time").desc(), F.col("transaction_id"))
    return t.withColumn("rn", F.row_number().over(w).cast("bigint")).where(F.col("rn") <= 100).select(
        "user_id", "transaction_id", "rn", "amount", F.date_format("event_time", TS_SPARK).alias("event_time"))


@query("constraint_violations", with_fx("""
SELECT 'transactions' AS table_name, 'pk_duplicate' AS rule, transaction_id AS key
FROM fx_transaction_updates GROUP BY transaction_id HAVING COUNT(*) > 1
UNION ALL SELECT 'transactions', 'not_null', transaction_id FROM fx_transaction_updates
  WHERE user_id IS NULL OR amount IS NULL OR event_time IS NULL
UNION ALL SELECT 'fraud_results', 'routed_to_enum', transaction_id FROM fx_fraud_results
  WHERE routed_to IS NULL OR routed_to NOT IN ('fraud-alerts', 'human-review', 'approved-transactions')
UNION ALL SELECT 'fraud_results', 'fk_transaction', transaction_id FROM fx_fraud_results
  WHERE transaction_id NOT IN (SELECT transaction_id FROM fx_transaction_updates)
UNION ALL SELECT 'fraud_results', 'pk_duplicate', transaction_id FROM fx_fraud_results GROUP BY transaction_id HAVING COUNT(*) > 1
UNION ALL SELECT 'analyst_feedback', 'verdict_enum', feedback_id FROM fx_feedback
  WHERE verdict IS NULL OR verdict NOT IN ('true_positive', 'false_positive', 'false_negative')
UNION ALL SELECT 'analyst_feedback', 'fk_transaction', feedback_id FROM fx_feedback
  WHERE transaction_id NOT IN (SELECT transaction_id FROM fx_transaction_updates)
UNION ALL SELECT 'ab_experiments', 'status_enum', experiment_id FROM fx_experiments
  WHERE status NOT IN ('active', 'paused', 'completed', 'draft')
UNION ALL SELECT 'ab_experiments', 'split_range', experiment_id FROM fx_experiments WHERE traffic_split < 0 OR traffic_split > 0.5
UNION ALL SELECT 'ab_experiments', 'one_active', min(experiment_id) FROM fx_experiments WHERE status = 'active'
  HAVING COUNT(*) > 1""", "fx_transaction_updates", "fx_fraud_results", "fx_feedback", "fx_experiments"))
def q_constraint_violations(spark, sf):
    return quality.constraint_violations(fx.fx_transaction_updates(spark, sf), fx.fx_fraud_results(spark, sf),
                                         fx.fx_feedback(spark, sf), fx.experiments(spark))


def _json_lines(spark, sf):
    """Transaction messages as JSON text, with deterministic damage: truncated lines (id % 97),
    a non-numeric amount (id % 89) and empty objects (id % 83)."""
    ev = fx.events(spark, sf)
    t = fx.transactions_from_events(ev, keep=("event_id",))
    eid = F.col("event_id")
    body = F.to_json(F.struct("transaction_id", "user_id", "amount", "currency",
                              F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("timestamp"),
                              "merchant_id", "location", "device_id", "ip_address"))
    bad_amount = F.to_json(F.struct("transaction_id", "user_id",
                                    F.concat(F.col("amount").cast("string"), F.lit("x")).alias("amount")))
    value = (F.when(eid % 97 == 0, F.expr("substring(" + "to_json(struct(transaction_id)), 1, 9)"))
             .when(eid % 89 == 0, bad_amount).when(eid % 83 == 0, F.lit("{}")).otherwise(body))
    return t.select(eid.alias("line_id"), value.alias("value"))


_GOOD = """
SELECT transaction_id, user_id, amount, currency, strftime(event_time, '%Y-%m-%d %H:%M:%S.%f') AS event_time,
       merchant_id, location, device_id, ip_address
FROM fx_transactions WHERE event_id % 97 <> 0 AND event_id % 89 <> 0 AND event_id % 83 <> 0"""


@query("decode_transactions", with_fx(_GOOD, "fx_transactions"))
def q_decode_transactions(spark, sf):
    good, _ = io.decode_json(_json_lines(spark, sf), io.TRANSACTION_JSON, keep=("line_id",))
    t = io.coerce_transactions(good)
    return t.withColumn("event_time", F.date_format("event_time", TS_SPARK))


@query("dead_letter", with_fx("""
SELECT event_id AS line_id, CASE WHEN event_id % 97 = 0 OR event_id % 89 = 0 THEN 'malformed' ELSE 'missing_field' END AS reason
FROM fx_transactions WHERE event_id % 97 = 0 OR event_id % 89 = 0 OR event_id % 83 = 0""", "fx_transactions"))
def q_dead_letter(spark, sf):
    _, bad = io.decode_json(_json_lines(spark, sf), io.TRANSACTION_JSON, keep=("line_id",))
    return bad.select("line_id", "reason")


def _value_lines(spark, sf):
    """Transaction messages whose values are bad in different ways, by event id modulo 40."""
    t = fx.transactions_from_events(fx.events(spark, sf), keep=("event_id",))
    kind = F.col("event_id") % 40
    amount = (F.when(kind == 1, F.lit('1e300')).when(kind == 2, F.lit('"NaN"')).when(kind == 3, F.lit('"12,5"'))
              .when(kind == 4, F.lit("1e11")).when(kind == 5, F.lit("null")).otherwise(F.col("amount").cast("string")))
    time = F.when(kind == 6, F.lit("yesterday")).otherwise(F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    ident = F.when(kind == 7, F.lit("null")).otherwise(F.concat(F.lit('"'), "transaction_id", F.lit('"')))
    return t.select(F.col("event_id").alias("line_id"), F.concat(
        F.lit('{"transaction_id":'), ident, F.lit(',"amount":'), amount, F.lit(',"timestamp":"'), time, F.lit('"}'))
        .alias("value"))


@query("dead_letter_values", with_fx("""
SELECT event_id AS line_id,
       CASE event_id % 40 WHEN 1 THEN 'bad_amount' WHEN 2 THEN 'bad_amount' WHEN 3 THEN 'malformed' WHEN 6 THEN 'bad_timestamp'
            WHEN 7 THEN 'missing_field' END AS reason,
       CASE WHEN event_id % 40 IN (1, 2, 3, 5, 6, 7) THEN NULL WHEN event_id % 40 = 4 THEN 1e11::DOUBLE ELSE amount END AS amount
FROM fx_transactions""", "fx_transactions"))
def q_dead_letter_values(spark, sf):
    """Every message once: its amount, or why it is a dead letter."""
    good, bad = io.transactions_of(_value_lines(spark, sf), keep=("line_id",))
    return good.select("line_id", F.lit(None).cast("string").alias("reason"), "amount").unionByName(
        bad.select("line_id", "reason", F.lit(None).cast("double").alias("amount")))
