"""Velocity aggregates: the chunked running changelog against brute force on a hot key, and the
changelog's last row per window equal to the window aggregate."""

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from riskstream.config import DAILY, REFERENCE
from riskstream.operators import velocity
from riskstream.sources import fixtures as fx

from conftest import SF_SMALL, TX_SCHEMA


def _hot_tx(spark, n=3000):
    """A third of all rows on one merchant inside one day, bursts of equal timestamps included."""
    t0 = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        ts = t0 + dt.timedelta(seconds=(i // 30) * 7 if hot else i * 13)  # hot rows share timestamps
        rows.append((f"t{i:05d}", f"User_{i % 40}", float(i % 97) + 0.25, "USD", ts,
                     "Merch_hot" if hot else f"Merch_{i % 11}", "US", f"Dev_{i % 50}", f"10.0.0.{i % 60}"))
    return spark.createDataFrame(rows, TX_SCHEMA)


def _brute_changelog(pdf, cfg):
    out = []
    w = cfg.window_ms
    for dim, col in velocity.DIMENSIONS:
        d = pdf[[col, "event_time", "transaction_id", "amount"]].rename(columns={col: "k"})
        d = d[d["k"].notna() & (d["k"] != "")].copy()
        d["ms"] = (d["event_time"] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1)
        d["ws"] = d["ms"] // w * w
        d = d.sort_values(["k", "ws", "ms", "transaction_id"])
        d["n"] = d.groupby(["k", "ws"]).cumcount() + 1
        d["cents"] = (d["amount"] * 100).round().astype("int64")
        d["s"] = d.groupby(["k", "ws"])["cents"].cumsum()
        thr = cfg.alert_threshold(dim)
        for r in d[d["n"] >= thr].itertuples():
            out.append((dim, r.k, int(r.ws), r.transaction_id, int(r.n), int(r.s)))
    return sorted(out)


def test_changelog_hot_key_equals_brute_force(spark):
    tx = _hot_tx(spark)
    cfg = DAILY.with_(changelog_chunk_ms=60_000)
    got = sorted((r["dimension"], r["dimension_key"], r["window_start"], r["transaction_id"], r["txn_count"],
                  int(round(r["total_amount"] * 100)))
                 for r in velocity.alert_changelog(tx, cfg).collect())
    want = _brute_changelog(tx.toPandas(), cfg)
    assert got == want
    assert any(g[1] == "Merch_hot" for g in got)


def test_changelog_last_row_equals_window(spark):
    tx = fx.fx_transactions(spark, SF_SMALL)
    cl = velocity.alert_changelog(tx, DAILY)
    last = cl.groupBy("dimension", "dimension_key", "window_start").agg(
        F.max("txn_count").alias("txn_count"), F.max_by("total_amount", "txn_count").alias("total_amount"))
    al = velocity.velocity_alerts(tx, DAILY).select("dimension", "dimension_key", "window_start", "txn_count",
                                                    "total_amount")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, al.collect()))


def test_single_pass_equals_fan_in(spark):
    tx = _hot_tx(spark, 900)
    a = sorted(map(tuple, velocity.velocity_alerts(tx, DAILY).collect()))
    b = sorted(map(tuple, velocity.fan_in(*velocity.per_dimension_alerts(tx, DAILY)).collect()))
    assert a == b


def test_events_within_a_millisecond_keep_their_order(transactions):
    import datetime as dt

    t0 = dt.datetime(2026, 1, 15, 10, 30)
    rows = [{"transaction_id": f"z{9 - i}", "event_time": t0 + dt.timedelta(microseconds=100 * i), "amount": 1.0 + i}
            for i in range(9)]
    cfg = REFERENCE.with_(velocity_tiers={d: ((1, 60),) for d in ("IP", "USER", "DEVICE", "MERCHANT")})
    got = [r for r in velocity.alert_changelog(transactions(rows), cfg).collect() if r["dimension"] == "USER"]
    by_count = [r["transaction_id"] for r in sorted(got, key=lambda r: r["txn_count"])]
    assert by_count == [f"z{9 - i}" for i in range(9)]


def test_bad_amounts_do_not_end_or_spoil_a_window(transactions):
    tx = transactions([{"amount": a} for a in (10.0, 1e11, float("nan"), float("inf"), 1e30)])
    got = {r["dimension"]: r for r in velocity.velocity_windows(tx, REFERENCE).collect()}
    assert got["USER"]["txn_count"] == 5 and got["USER"]["total_amount"] == 1e11 + 10


def test_a_hot_key_is_cut_into_bounded_chunks(spark, transactions):
    """A third of all rows has one merchant, minute and, for a part, one microsecond."""
    import datetime as dt

    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from riskstream.config import DAILY
    from riskstream.operators.velocity import CHUNK, alert_changelog, changelog_chunks

    t0 = dt.datetime(2026, 1, 15, 10, 30)
    rows = [{"merchant_id": "hot" if i % 3 == 0 else f"m{i % 50}", "user_id": f"u{i % 40}", "amount": float(i % 17) if i % 19 else None,
             "device_id": None, "ip_address": f"ip{i}", "event_time": t0 + dt.timedelta(microseconds=0 if i < 300 else i * 7000)}
            for i in range(1500)]
    tx = transactions(rows)
    cfg = DAILY.with_(changelog_chunk_rows=100)
    chunks = changelog_chunks(tx, cfg).groupBy(*CHUNK, "sub").count().collect()
    assert max(r["count"] for r in chunks) <= 100 and len({r["sub"] for r in chunks}) > 3
    got = alert_changelog(tx, cfg)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in alert_changelog(tx, DAILY).collect()}
    w = Window.orderBy("event_time", "transaction_id")
    hot = tx.where("merchant_id = 'hot'").select("transaction_id", F.row_number().over(w).alias("n"))
    want = {r["transaction_id"]: r["n"] for r in hot.collect() if r["n"] >= DAILY.alert_threshold("MERCHANT")}
    assert {r["transaction_id"]: r["txn_count"] for r in got.where("dimension_key = 'hot'").collect()} == want
