"""The fixture views of :mod:`riskstream.sources.fixtures` as DuckDB SQL, inlined by the oracles as CTEs."""

from __future__ import annotations

FX = {
    "fx_k": """
SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events""",
    "fx_transactions": """
SELECT 'txn-' || event_id AS transaction_id, 'User_' || user_id AS user_id, value AS amount,
       'USD' AS currency, ts AS event_time, 'Merch_' || event_type AS merchant_id,
       CASE event_id % 7 WHEN 0 THEN 'US' WHEN 1 THEN 'IN' WHEN 2 THEN 'UK' WHEN 3 THEN 'CA'
                         WHEN 4 THEN 'AU' WHEN 5 THEN 'DE' ELSE 'JP' END AS location,
       CASE WHEN k < 20 THEN 'Dev_SHARED_' || k ELSE 'Dev_User_' || user_id END AS device_id,
       '10.0.' || (user_id % 50) || '.' || k AS ip_address,
       event_id, user_id AS uid, value
FROM fx_k""",
    "fx_fraud_results": """
SELECT transaction_id, score, score >= 0.8 AS is_fraud,
       CASE WHEN score >= 0.8 THEN 'fraud-alerts' WHEN score >= 0.3 THEN 'human-review'
            ELSE 'approved-transactions' END AS routed_to,
       CASE WHEN event_id % 10 < 3 THEN 'v2.0' ELSE 'v1.0' END AS model_version,
       scored_at, event_id
FROM (SELECT 'txn-' || event_id AS transaction_id, event_id, ts AS scored_at,
             CAST(CASE WHEN value >= 250 THEN 1.0 ELSE value / 250.0 END AS DECIMAL(5,4)) AS score
      FROM events WHERE event_id % 17 <> 0) r""",
    "fx_feedback": """
SELECT 'fb-' || event_id AS feedback_id, 'txn-' || event_id AS transaction_id,
       'analyst_' || (user_id % 5) AS analyst_id,
       CASE event_id % 3 WHEN 0 THEN 'true_positive' WHEN 1 THEN 'false_positive' ELSE 'false_negative' END AS verdict,
       '' AS notes, ts + INTERVAL '1' DAY AS created_at
FROM events WHERE event_type = 'error'""",
    "fx_ab_metrics": """
SELECT 'exp-001' AS experiment_id,
       CASE WHEN event_id % 10 < 3 THEN 'v2.0' ELSE 'v1.0' END AS model_version,
       'txn-' || event_id AS transaction_id,
       CAST(value AS DECIMAL(8,2)) AS latency_ms,
       CASE WHEN event_type <> 'error' THEN NULL ELSE (event_id % 3 <> 1) = (value >= 200) END AS was_correct
FROM events""",
    "fx_blacklist_ops": """
SELECT event_id AS seq,
       CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 'add'
            WHEN event_type = 'signup' AND k % 10 = 0 THEN 'remove'
            WHEN event_type = 'error' AND k % 10 = 5 THEN 'add'
            WHEN event_type = 'view' AND k = 3 AND user_id % 25 = 0 THEN 'add'
            WHEN event_type = 'error' AND k = 42 THEN 'add'
            WHEN event_type = 'purchase' AND k = 99 AND user_id % 10 = 0 THEN 'clear' END AS op,
       CASE WHEN event_type = 'error' AND k % 10 = 0 THEN 'User_' || user_id
            WHEN event_type = 'signup' AND k % 10 = 0 THEN 'User_' || user_id
            WHEN event_type = 'error' AND k % 10 = 5 THEN '10.0.' || (user_id % 50) || '.' || k
            WHEN event_type = 'view' AND k = 3 AND user_id % 25 = 0 THEN 'Dev_SHARED_3'
            WHEN event_type = 'error' AND k = 42 THEN 'Merch_error' END AS value
FROM fx_k""",
    "fx_review_events": """
SELECT transaction_id, (epoch_us(scored_at) // 1000) AS seq, 'item' AS kind, score
FROM fx_fraud_results WHERE routed_to = 'human-review'
UNION ALL
SELECT transaction_id, (epoch_us(scored_at) // 1000) + 172800000, 'item', score
FROM fx_fraud_results WHERE routed_to = 'human-review' AND event_id % 5 = 0
UNION ALL
SELECT transaction_id, (epoch_us(created_at) // 1000), 'review', CAST(NULL AS DECIMAL(5,4)) FROM fx_feedback""",
    "fx_transaction_updates": """
SELECT transaction_id, user_id, amount, currency, event_time, merchant_id, location, device_id, ip_address, 1 AS seq
FROM fx_transactions
UNION ALL
SELECT transaction_id, 'User_' || (uid + 1), value + 1, currency, event_time, 'Merch_updated', location,
       device_id, ip_address, 2 FROM fx_transactions WHERE event_id % 4 = 0
UNION ALL
SELECT transaction_id, 'User_' || (uid + 2), value + 2, currency, event_time, 'Merch_updated', 'ZZ',
       device_id, ip_address, 3 FROM fx_transactions WHERE event_id % 8 = 0
UNION ALL
SELECT 'txn-new-' || event_id, user_id, amount, currency, event_time, merchant_id, location, device_id,
       ip_address, 2 FROM fx_transactions WHERE event_id % 10 = 3""",
    "fx_result_updates": """
SELECT transaction_id, score, is_fraud, routed_to, model_version, scored_at, 1 AS seq FROM fx_fraud_results
UNION ALL
SELECT transaction_id, h, h >= 0.8, CASE WHEN h >= 0.8 THEN 'fraud-alerts' WHEN h >= 0.3 THEN 'human-review'
       ELSE 'approved-transactions' END, 'v3.0', scored_at + INTERVAL '1' DAY, 2
FROM (SELECT *, CAST(1 - score AS DECIMAL(5,4)) AS h FROM fx_fraud_results WHERE event_id % 6 = 0) u""",
}

DEPS = {
    "fx_transactions": ["fx_k"],
    "fx_blacklist_ops": ["fx_k"],
    "fx_review_events": ["fx_fraud_results", "fx_feedback"],
    "fx_transaction_updates": ["fx_transactions"],
    "fx_result_updates": ["fx_fraud_results"],
}


def with_fx(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with CTEs for the named fixtures (dependencies first), then ``extra`` CTEs."""
    order: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    ctes = [f"{n} AS ({FX[n]}\n)" for n in order] + [f"{n} AS ({q}\n)" for n, q in (extra or [])]
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body

EXPERIMENTS_SQL = """
SELECT * FROM (VALUES
  ('exp-001', 'Test Experiment', 'v1.0', 'v2.0', 0.20::DOUBLE, 'active', '2026-01-01', NULL),
  ('exp-000', 'Earlier Experiment', 'v0.9', 'v1.0', 0.10::DOUBLE, 'completed', '2025-06-01', '2025-12-31'))
  t(experiment_id, name, control_model_version, challenger_model_version, traffic_split, status, start_date, end_date)"""
FX["fx_experiments"] = EXPERIMENTS_SQL
