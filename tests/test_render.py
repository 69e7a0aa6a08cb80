"""Ring prompts: the lines of a ring and the one text made of them."""

from pyspark.sql import functions as F

from riskstream.config import REFERENCE
from riskstream.operators import graph, render


def _lines(tx):
    pairs = graph.resource_users(tx)
    rings = graph.fraud_rings(tx, REFERENCE, pairs)
    return rings, render.ring_prompt_lines(rings, graph.ring_members(tx, REFERENCE, pairs, rings), tx, F.lit("2026-01-15"))


def test_one_prompt_per_ring(transactions):
    import datetime as dt

    t0 = dt.datetime(2026, 1, 15, 10, 30)
    tx = transactions([{"user_id": u, "device_id": "D", "ip_address": f"10.0.0.{i}", "amount": 10.5, "event_time": t0.replace(second=i)}
                       for i, u in enumerate([" u9", "u1", "u5"])])
    rings, lines = _lines(tx)
    ring = rings.first()
    got = render.ring_prompts(lines).collect()
    assert len(got) == 1 and got[0]["n_lines"] == lines.count()
    tx_lines = "\n".join(f"  - TX t{i}: user={u}, amount=10.5 USD, merchant=Merch_1, time=2026-01-15T10:30:0{i}.000000, "
                         f"device=D, ip=10.0.0.{i}" for i, u in enumerate([" u9", "u1", "u5"]))
    assert got[0]["prompt"] == f"""Analyze the following potential fraud ring:

RING DETAILS:
- Ring ID: {ring['ring_id']}
- Shared Resource Type: device
- Shared Resource ID: D
- Number of Members: 3
- Member User IDs:  u9, u1, u5
- Total Transaction Amount: 31.50
- Risk Score: 0.300
- Detected At: 2026-01-15

MEMBER TRANSACTIONS:
{tx_lines}

Please provide your fraud ring investigation analysis."""


def test_large_rings_keep_their_lines_only(transactions):
    tx = transactions([{"user_id": f"u{i}", "device_id": "Hot" if i % 2 else "Cold", "ip_address": f"10.0.0.{i}"}
                       for i in range(8)] + [{"user_id": f"u{i}", "device_id": "Hot", "ip_address": "10.0.1.1"} for i in (1, 1, 1)])
    rings, lines = _lines(tx)
    sizes = {r["ring_id"]: r["n"] for r in lines.groupBy("ring_id").agg(F.count("*").alias("n")).collect()}
    assert len(set(sizes.values())) > 1
    cut = min(sizes.values())
    got = {r["ring_id"]: r for r in render.ring_prompts(lines, max_lines=cut).collect()}
    assert {k: r["n_lines"] for k, r in got.items()} == sizes
    assert {k for k, r in got.items() if r["prompt"] is not None} == {k for k, n in sizes.items() if n <= cut}


def test_a_ring_without_transactions_and_no_rings(transactions):
    tx = transactions([{"user_id": f"u{i}", "ip_address": f"10.0.0.{i}"} for i in range(3)])
    pairs = graph.resource_users(tx)
    rings = graph.fraud_rings(tx, REFERENCE, pairs)
    lines = render.ring_prompt_lines(rings, graph.ring_members(tx, REFERENCE, pairs, rings), tx.limit(0), F.lit("x"))
    assert "MEMBER TRANSACTIONS:\n  No transactions available\n\nPlease" in render.ring_prompts(lines).first()["prompt"]
    assert render.ring_prompts(lines.limit(0)).collect() == []
