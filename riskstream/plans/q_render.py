"""Registered queries: prompt rows and ring narratives."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskstream.operators import graph, render, scoring
from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.q_velocity import CFG, SCORE_EXTRA, _SCORE_ALERTS, ring_ctes, scored_alerts
from riskstream.plans.registry import query
from riskstream.session import materialize
from riskstream.sources import fixtures as fx


def sql_format(template: str, exprs: list[str]) -> str:
    """A %s-template as a DuckDB string concatenation (literal newlines are valid inside quotes)."""
    parts = template.split("%s")
    assert len(parts) == len(exprs) + 1
    out = ["'" + parts[0].replace("'", "''") + "'"]
    for e, p in zip(exprs, parts[1:]):
        out.append(f"({e})")
        out.append("'" + p.replace("'", "''") + "'")
    return " || ".join(out)


_TX_PROMPT = sql_format(render.TRANSACTION_PROMPT, [
    "t.transaction_id", "t.user_id", "CAST(t.amount AS VARCHAR)", "t.currency",
    "strftime(t.event_time, '%Y-%m-%dT%H:%M:%S.%f')", "t.merchant_id", "t.location", "t.device_id", "t.ip_address",
    "CASE WHEN b.has_ring THEN '  - Fraud ring: 1.000' ELSE '' END", "'0.000'"])


@query("transaction_prompt", with_fx(f"""
SELECT t.transaction_id, {_TX_PROMPT} AS prompt
FROM fx_transactions t JOIN (
  SELECT d.transaction_id, max(s.score) AS score,
         arg_max(s.ring_severity IS NOT NULL, {{'s': s.score, 'd': s.dimension}}) AS has_ring
  FROM dims d JOIN ({_SCORE_ALERTS}) s
    ON d.dimension = s.dimension AND d.dimension_key = s.dimension_key
   AND ((epoch_us(d.event_time) // 1000) // {CFG.window_ms}) * {CFG.window_ms} = s.window_start
  GROUP BY d.transaction_id) b USING (transaction_id)
WHERE b.score >= {CFG.review_cut}""", "fx_transactions", "fx_blacklist_ops", extra=SCORE_EXTRA))
def q_transaction_prompt(spark, sf):
    """One prompt per flagged transaction (top alert score >= review cut), rule lines from the
    reasons of its top alert (N4), ML score 0 (the model call itself is out of scope)."""
    tx = fx.fx_transactions(spark, sf)
    r = scoring.txn_reasons(tx, scored_alerts(spark, sf), CFG).where(F.col("score") >= CFG.review_cut)
    return render.transaction_prompt(tx.join(r.select("transaction_id", "reasons"), "transaction_id"))


def _rings(spark, sf):
    tx = fx.fx_transactions(spark, sf)
    pairs = materialize(graph.resource_users(tx), "resource-users")  # read by two branches
    return tx, pairs, materialize(graph.fraud_rings(tx, CFG, pairs), "rings")


def _ring_sql_lines() -> str:
    head_vals = [None, None, None, "r.ring_id", "r.resource_type", "r.resource_id", "CAST(r.n_users AS VARCHAR)", None]
    trail_vals = ["printf('%.2f', r.total_amount)", "printf('%.3f', r.risk_score)",
                  "strftime(r.last_seen, '%Y-%m-%dT%H:%M:%S.%f')", None, None]
    sel = []
    for part, tmpl, vals in ((0, render.RING_HEADER, head_vals), (2, render.RING_TRAILER, trail_vals)):
        for i, (t, v) in enumerate(zip(tmpl, vals)):
            line = sql_format(t, [v]) if v is not None else "'" + t.replace("'", "''") + "'"
            sel.append(f"SELECT r.ring_id, {part} AS part, CAST({i} AS BIGINT) AS k1, '' AS k2, {line} AS line FROM rl r")
    sel.append(f"SELECT r.ring_id, 4, CAST(0 AS BIGINT), '', '{render.RING_CLOSE}' FROM rl r")
    sel.append("SELECT r.ring_id, 1, p.first_use, p.user_id, '    ' || p.user_id "
               "FROM pairs p JOIN rl r USING (resource_type, resource_id)")
    tx_line = sql_format(render.RING_TX_LINE, [
        "t.transaction_id", "t.user_id", "CAST(t.amount AS VARCHAR)", "t.currency", "t.merchant_id",
        "strftime(t.event_time, '%Y-%m-%dT%H:%M:%S.%f')", "t.device_id", "t.ip_address"])
    sel.append(f"""SELECT r.ring_id, 3, epoch_us(t.event_time) // 1000, t.transaction_id, {tx_line}
FROM fx_transactions t JOIN rl r ON (r.resource_type = 'device' AND t.device_id = r.resource_id)
                                 OR (r.resource_type = 'ip' AND t.ip_address = r.resource_id)""")
    return "\nUNION ALL\n".join(sel)


_RL = """
SELECT r.*, x.last_seen FROM rings r JOIN (
  SELECT 'device' AS resource_type, device_id AS resource_id, max(event_time) AS last_seen FROM fx_transactions GROUP BY 1, 2
  UNION ALL SELECT 'ip', ip_address, max(event_time) FROM fx_transactions GROUP BY 1, 2) x
USING (resource_type, resource_id)"""


_PROMPT = """
SELECT ring_id, COUNT(*) AS n_lines,
       string_agg(line, chr(10) ORDER BY k1, k2) FILTER (part = 0) || ' '
       || string_agg(substr(line, 5), ', ' ORDER BY k1, k2) FILTER (part = 1) || chr(10)
       || string_agg(line, chr(10) ORDER BY k1, k2) FILTER (part = 2) || chr(10)
       || string_agg(line, chr(10) ORDER BY k1, k2) FILTER (part = 3) || chr(10) || chr(10)
       || string_agg(line, chr(10)) FILTER (part = 4) AS prompt
FROM ring_lines GROUP BY ring_id"""


def _ring_lines(spark, sf):
    tx, pairs, rings = _rings(spark, sf)
    members = graph.ring_members(tx, CFG, pairs, rings)
    detected = F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return render.ring_prompt_lines(rings, members, tx, detected)


@query("ring_prompt", with_fx(_ring_sql_lines(), "fx_transactions", extra=ring_ctes() + [("rl", _RL)]))
def q_ring_prompt(spark, sf):
    """Ring prompt lines (header, members by first use, trailer, member transactions)."""
    return _ring_lines(spark, sf)


@query("ring_prompt_text", with_fx(
    f"SELECT ring_id, n_lines, CASE WHEN n_lines <= {render.PROMPT_LINES} THEN prompt END AS prompt FROM prompts",
    "fx_transactions", extra=ring_ctes() + [("rl", _RL), ("ring_lines", _ring_sql_lines()), ("prompts", _PROMPT)]))
def q_ring_prompt_text(spark, sf):
    """One prompt per ring below the stated number of lines."""
    return render.ring_prompts(materialize(_ring_lines(spark, sf), "ring-lines"))


@query("ring_narrative", with_fx(f"""
SELECT ring_id, {sql_format(render.RING_DISABLED, ["ring_id", "CAST(n_users AS VARCHAR)", "resource_type",
                                                     "resource_id", "printf('%.3f', risk_score)",
                                                     "printf('%.2f', total_amount)"])} AS narrative
FROM rings""", "fx_transactions", extra=ring_ctes()))
def q_ring_narrative(spark, sf):
    """The fixed narrative used without a language model."""
    _, _, rings = _rings(spark, sf)
    return render.ring_narrative(rings)
