"""Registered queries: shared-resource graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskstream.operators import graph
from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.q_velocity import CFG, ring_ctes
from riskstream.plans.registry import query
from riskstream.sources import fixtures as fx

EDGE_CTES = [
    ("edges_raw", """
  SELECT 'user' AS src_type, user_id AS src, 'device' AS dst_type, device_id AS dst, amount, event_id
  FROM fx_transactions
  UNION ALL SELECT 'user', user_id, 'ip', ip_address, amount, event_id FROM fx_transactions
  UNION ALL SELECT 'device', device_id, 'ip', ip_address, amount, event_id FROM fx_transactions"""),
    ("edges", """
  SELECT src_type, src, dst_type, dst, arg_max(amount, event_id) AS weight, COUNT(*) AS n_txn
  FROM edges_raw WHERE src IS NOT NULL AND dst IS NOT NULL GROUP BY src_type, src, dst_type, dst"""),
]


@query("graph_edges", with_fx("SELECT * FROM edges", "fx_transactions", extra=EDGE_CTES))
def q_graph_edges(spark, sf):
    return graph.graph_edges(fx.fx_transactions(spark, sf))


@query("fraud_rings", with_fx("""
SELECT ring_id, resource_type AS shared_resource_type, resource_id AS shared_resource_id, n_users, risk_score,
       CAST(total_amount AS DOUBLE) AS total_transaction_amount
FROM rings""", "fx_transactions", extra=ring_ctes()))
def q_fraud_rings(spark, sf):
    r = graph.fraud_rings(fx.fx_transactions(spark, sf), CFG)
    return r.select("ring_id", "shared_resource_type", "shared_resource_id", "n_users", "risk_score",
                    F.col("total_transaction_amount").cast("double").alias("total_transaction_amount"))


@query("ring_members", with_fx("""
SELECT r.ring_id, p.user_id, p.first_use AS first_use_seq
FROM pairs p JOIN rings r USING (resource_type, resource_id)""", "fx_transactions", extra=ring_ctes()))
def q_ring_members(spark, sf):
    m = graph.ring_members(fx.fx_transactions(spark, sf), CFG)
    return m.select("ring_id", "user_id", F.col("first_use").alias("first_use_seq"))


@query("user_best_ring", with_fx("SELECT * FROM best", "fx_transactions", extra=ring_ctes()))
def q_user_best_ring(spark, sf):
    return graph.user_best_ring(fx.fx_transactions(spark, sf), CFG)


@query("user_best_ring_by_time", with_fx("SELECT * FROM best", "fx_transactions", extra=ring_ctes(order="event_time")))
def q_user_best_ring_by_time(spark, sf):
    """The same without an arrival sequence, as real sources have none: rings are ordered by event time."""
    return graph.user_best_ring(fx.fx_transactions(spark, sf).drop("ingest_seq"), CFG)


@query("resource_amounts", with_fx("""
SELECT resource_type, resource_id, CAST(SUM(amount) AS DOUBLE) AS total_amount FROM pairs
GROUP BY resource_type, resource_id""", "fx_transactions", extra=ring_ctes()))
def q_resource_amounts(spark, sf):
    return graph.resource_amounts(fx.fx_transactions(spark, sf))


# Components: every device / IP has a user, so components of the tripartite graph equal components of
# the user graph linked through shared resources; reachability by a recursive CTE (UNION dedups).
_NETWORK = """
WITH RECURSIVE
uu AS (
  SELECT DISTINCT a.user_id AS u, b.user_id AS v FROM res a JOIN res b
    ON a.resource_type = b.resource_type AND a.resource_id = b.resource_id),
reach(u, l) AS (
  SELECT DISTINCT user_id, user_id FROM res
  UNION
  SELECT uu.v, reach.l FROM reach JOIN uu ON reach.u = uu.u),
labels AS (SELECT u, min(l) AS l FROM reach GROUP BY u)
SELECT (SELECT COUNT(*) FROM (SELECT DISTINCT user_id FROM fx_transactions WHERE user_id IS NOT NULL)
        ) + (SELECT COUNT(*) FROM (SELECT DISTINCT device_id FROM fx_transactions WHERE device_id IS NOT NULL))
          + (SELECT COUNT(*) FROM (SELECT DISTINCT ip_address FROM fx_transactions WHERE ip_address IS NOT NULL))
         AS node_count,
       (SELECT COUNT(*) FROM edges) AS edge_count,
       (SELECT COUNT(DISTINCT l) FROM labels) AS components"""


def _network_sql():
    from riskstream.plans.fixture_sql import FX
    res = """
SELECT 'device' AS resource_type, device_id AS resource_id, user_id FROM fx_transactions
WHERE device_id IS NOT NULL AND user_id IS NOT NULL
UNION ALL SELECT 'ip', ip_address, user_id FROM fx_transactions WHERE ip_address IS NOT NULL AND user_id IS NOT NULL"""
    ctes = [("fx_k", FX["fx_k"]), ("fx_transactions", FX["fx_transactions"]), ("res", res)] + EDGE_CTES
    head = ",\n".join(f"{n} AS ({b}\n)" for n, b in ctes)
    return _NETWORK.replace("WITH RECURSIVE\n", "WITH RECURSIVE\n" + head + ",\n", 1)


@query("network_stats", _network_sql())
def q_network_stats(spark, sf):
    return graph.network_stats(fx.fx_transactions(spark, sf))


@query("network_stats_growing", _network_sql())
def q_network_stats_growing(spark, sf):
    """The same numbers from three batches added to a growing graph."""
    import uuid

    from pyspark.sql import functions as F

    from riskstream.session import checkpoint_dir
    from riskstream.streaming.growing_graph import GrowingGraph

    g = GrowingGraph(spark, f"{checkpoint_dir(spark).rstrip('/')}/graphs/{uuid.uuid4().hex[:16]}")
    tx = fx.fx_transactions(spark, sf)
    for b in range(3):
        g.add(tx.where(F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == b), b)
    return g.stats()
