"""Shared-resource graph: edges, rings, lookup, components (vs. a brute-force union-find)."""

from pyspark.sql import functions as F

from riskstream.config import REFERENCE
from riskstream.operators import graph
from riskstream.sources import fixtures as fx

from conftest import SF_SMALL


def test_edges_of_one_transaction(transactions):
    tx = transactions([{"user_id": "User_1", "device_id": "Dev_1", "ip_address": "192.168.1.10"}])
    e = {(r["src_type"], r["dst_type"]) for r in graph.graph_edges(tx).collect()}
    assert e == {("user", "device"), ("user", "ip"), ("device", "ip")}
    assert graph.graph_vertices(tx).count() == 3


def _ring_tx(transactions, n):
    return transactions([{"user_id": f"User_{i + 1}", "device_id": "SharedDev", "ip_address": f"10.0.0.{i + 1}"}
                         for i in range(n)])


def test_two_users_no_ring(transactions):
    assert graph.fraud_rings(_ring_tx(transactions, 2), REFERENCE).count() == 0


def test_three_users_ring(transactions):
    tx = _ring_tx(transactions, 3)
    rings = graph.fraud_rings(tx, REFERENCE).collect()
    assert len(rings) == 1
    r = rings[0]
    assert r["shared_resource_type"] == "device" and r["shared_resource_id"] == "SharedDev"
    assert r["n_users"] == 3 and abs(r["risk_score"] - 0.3) < 1e-12
    members = graph.ring_members(tx, REFERENCE).orderBy("first_use").select("user_id").collect()
    assert [m[0] for m in members] == ["User_1", "User_2", "User_3"]


def test_lookup(transactions):
    best = {r["user_id"]: r for r in graph.user_best_ring(_ring_tx(transactions, 3), REFERENCE).collect()}
    assert best["User_1"]["ring_resource"] == "SharedDev" and "User_999" not in best


def test_weight_is_last_amount(transactions):
    tx = transactions([{"amount": 1.0}, {"amount": 2.0}, {"amount": 3.0}])
    assert {r["weight"] for r in graph.graph_edges(tx).collect()} == {3.0}


def _brute_components(rows):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, d, i in rows:
        nodes = [n for n in (("U", u), ("D", d), ("I", i)) if n[1] is not None]
        for n in nodes:
            find(n)
        for a in nodes[1:]:
            parent[find(a)] = find(nodes[0])
    return len({find(x) for x in parent})


def test_components_vs_brute_force(spark):
    tx = fx.fx_transactions(spark, SF_SMALL)
    for df in (tx, tx.where(~F.col("device_id").startswith("Dev_SHARED_"))):
        rows = [tuple(r) for r in df.select("user_id", "device_id", "ip_address").collect()]
        got = graph.network_stats(df).first()
        assert got["components"] == _brute_components(rows)
        assert got["node_count"] == len({("U", r[0]) for r in rows} | {("D", r[1]) for r in rows} | {("I", r[2]) for r in rows})


def test_hot_device_rings_and_components(transactions):
    """One device used by a third of all users (the skew case), plus IP-sharing pairs."""
    rows = []
    for i in range(300):
        dev = "Dev_HOT" if i % 3 == 0 else f"Dev_{i}"
        rows.append({"user_id": f"User_{i % 150}", "device_id": dev, "ip_address": f"10.1.{i % 7}.{i % 5}",
                     "amount": float(i)})
    tx = transactions(rows)
    rings = {(r["shared_resource_type"], r["shared_resource_id"]): r for r in graph.fraud_rings(tx, REFERENCE).collect()}
    hot_users = {f"User_{i % 150}" for i in range(300) if i % 3 == 0}
    assert rings[("device", "Dev_HOT")]["n_users"] == len(hot_users)
    assert float(rings[("device", "Dev_HOT")]["total_transaction_amount"]) == sum(float(i) for i in range(0, 300, 3))
    best = {r["user_id"]: r for r in graph.user_best_ring(tx, REFERENCE).collect()}
    assert all(best[u]["ring_risk"] == 1.0 for u in hot_users)
    got = graph.network_stats(tx).first()
    assert got["components"] == _brute_components([(r["user_id"], r["device_id"], r["ip_address"]) for r in rows])


def test_equal_first_times_give_one_ring_per_user(transactions):
    """Without an arrival sequence, rings first used at the same time must not mix their members."""
    import datetime as dt

    t0 = dt.datetime(2026, 1, 15, 10, 30)
    tx = transactions([{"user_id": f"User_{d}{i}", "device_id": f"Dev_{d}", "ip_address": f"10.0.{d}.{i}", "event_time": t0}
                       for d in (1, 2) for i in range(3)])
    assert "ingest_seq" not in tx.columns
    best = graph.user_best_ring(tx, REFERENCE).collect()
    assert {r["user_id"]: r["ring_resource"] for r in best} == {f"User_{d}{i}": f"Dev_{d}" for d in (1, 2) for i in range(3)}
    assert len(best) == 6
    # a user in both rings gets the one with the smaller id, and scoring keeps one row per alert
    both = tx.unionByName(transactions([{"user_id": "User_10", "device_id": "Dev_2", "ip_address": "10.0.9.9", "event_time": t0}]))
    mine = [r for r in graph.user_best_ring(both, REFERENCE).collect() if r["user_id"] == "User_10"]
    assert [r["ring_resource"] for r in mine] == ["Dev_2"]  # four users there, three at Dev_1


def test_best_ring_aggregates_numbers(transactions):
    """The membership table is reduced by a hash aggregate over longs, not sorted."""
    tx = transactions([{"user_id": f"User_{i}", "device_id": f"Dev_{i % 3}", "ip_address": f"10.0.0.{i}"} for i in range(30)])
    plan = graph.user_best_ring(tx, REFERENCE)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_scored_alerts_keep_one_row_each(spark):
    from riskstream.config import DAILY
    from riskstream.operators import scoring, velocity

    tx = fx.fx_transactions(spark, SF_SMALL).drop("ingest_seq")
    alerts = velocity.velocity_alerts(tx, DAILY)
    blocked = spark.createDataFrame([], "value string")
    got = scoring.score_alerts(alerts, DAILY, blacklist=blocked, user_rings=graph.user_best_ring(tx, DAILY))
    assert got.count() == alerts.count() > 0


def test_components_of_a_long_path(spark):
    """One component, however many rounds it takes."""
    edges = spark.range(201).selectExpr("id as u", "id + 1 as v")
    labels = graph.connected_components(edges).collect()
    assert len(labels) == 202 and {r["label"] for r in labels} == {0}
