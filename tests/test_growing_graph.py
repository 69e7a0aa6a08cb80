"""Dense vertex numbers and components that grow by batches."""

import pytest
from pyspark.sql import functions as F

from riskstream.operators import graph
from riskstream.streaming.growing_graph import GrowingGraph


def tx_of(transactions, seed, n):
    import random

    rng = random.Random(seed)
    pick = lambda p, k: f"{p}{rng.randint(0, k)}" if rng.random() > 0.1 else None
    return transactions([{"user_id": pick("u", 60), "device_id": pick("d", 40), "ip_address": pick("i", 40)} for _ in range(n)])


def partition(df):
    groups = {}
    for r in df.collect():
        groups.setdefault(r.label, set()).add((r.type, r.id))
    return sorted(map(sorted, groups.values()))


def test_dense_ids_leave_none_out(spark):
    got = graph.dense_ids(spark.range(1000).repartition(7).select(F.col("id").cast("string").alias("id")), 50)
    assert sorted(r["node"] for r in got.collect()) == list(range(50, 1050))
    assert graph.dense_ids(spark.range(0).select("id")).collect() == []


def test_batches_give_what_one_run_gives(spark, workdir, transactions):
    parts = [tx_of(transactions, s, 25) for s in (1, 2, 3)]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    g, one = GrowingGraph(spark, f"{workdir}/g"), GrowingGraph(spark, f"{workdir}/one")
    for b, p in enumerate(parts):
        g.add(p, b)
    g.add(parts[1], 1)  # a replay
    g.add(parts[2], 2)
    one.add(whole, 0)
    assert partition(g.components()) == partition(one.components())
    assert g.stats().first() == one.stats().first()
    want = graph.network_stats(whole).first()
    assert g.stats().select("node_count", "edge_count", "components").first() == want


def test_an_interrupted_batch_does_not_count(spark, workdir, transactions):
    g = GrowingGraph(spark, f"{workdir}/g")
    assert g.stats().first() == (0, 0, 0)
    g.add(tx_of(transactions, 1, 20), 0)
    want = g.stats().first()
    spark.createDataFrame([("user", "x", 999)], "type string, id string, node long").write.parquet(f"{workdir}/g/batch_id=1/dictionary")
    assert g.stats().first() == want and g.components().where("id = 'x'").isEmpty()


def test_equal_hashes_do_not_merge_components(spark, transactions, monkeypatch):
    tx = tx_of(transactions, 4, 30)
    want = graph.network_stats(tx).first()
    monkeypatch.setattr(graph, "node_id", lambda kind, name: F.when(name.isNotNull(), F.pmod(F.xxhash64(kind, name), F.lit(20))))
    assert graph.network_stats(tx).first() == want
