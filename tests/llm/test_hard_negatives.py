"""Strassen products, mergeable heaps and mined negatives against brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskstream.llm import hard_negatives
from riskstream.llm.hard_negatives import Heaps, mine, strassen

SCHEMA = "vec_id long, embedding array<float>, label int"


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 70), st.integers(0, 70), st.integers(0, 70), st.sampled_from([3, 1 << 20, 1 << 40, 1 << 62]), st.integers(0, 9))
def test_products_are_exact_modulo_2_64(m, k, n, size, seed):
    rng = np.random.default_rng(seed)
    a, b = rng.integers(-size, size, (m, k)), rng.integers(-size, size, (k, n))
    with np.errstate(over="ignore"):
        got = strassen(a, b)
    want = a.astype(object) @ b.astype(object) if k else np.zeros((m, n), object)
    assert got.shape == (m, n)
    assert all((int(x) - int(y)) % (1 << 64) == 0 for x, y in zip(got.ravel(), np.asarray(want).ravel()))


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(1)
    scores, ids = rng.integers(0, 5, (3, 60)), np.arange(60)
    want = [sorted(zip(-scores[i], ids))[:4] for i in range(3)]
    for order in (ids, ids[::-1], rng.permutation(60)):
        h = Heaps(3, 4)
        for part in np.array_split(order, 7):
            h.offer(scores[:, part], np.ones((3, len(part)), bool), 0, ids[part], np.ones(len(part), bool), part)
        assert [[(-s, i) for r, s, i in zip(h.slot, h.score, h.id) if r == j] for j in range(3)] == [list(w) for w in want]


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """Every anchor against every row, in Python integers."""
    kept = {(i, l, tuple(v)): (i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows
            if v is not None and l is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for ka, (i, l, v) in kept.items():
        if i is None or i % 100:
            continue
        s = [(-sum(x * y for x, y in zip(v, w)), j is None, j or 0, j, m) for kb, (j, m, w) in kept.items() if kb != ka]
        for p in sorted((x for x in s if x[4] == l), key=lambda x: x[:3])[:positives]:
            near = sorted((x for x in s if x[4] != l and low * -p[0] <= 100 * -x[0] <= high * -p[0]), key=lambda x: x[:3])
            out += [(i, p[3], r, x[3], -p[0], -x[0]) for r, x in enumerate(near[:negatives], 1)]
    return sorted(out, key=repr)


def mined(spark, rows, **settings_):
    df = spark.createDataFrame(rows, SCHEMA)
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score)
                   for r in mine(df, F.col("vec_id") % 100 == 0, **settings_).collect()), key=repr)


def vectors(n, dims=5, labels=3, step=25, seed=0):
    rng = np.random.default_rng(seed)
    return [(i * step, [float(np.float32(x)) for x in rng.normal(0.3, 0.5, dims)], int(rng.integers(0, labels))) for i in range(n)]


@pytest.mark.parametrize("block", [7, 2048])
def test_mined_rows_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rows = vectors(120)
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, rows, positives=2, negatives=3, low=50, high=100) == brute(rows, 2, 3, 50, 100)


def test_one_label_and_ties_and_equal_vectors(spark):
    same = [(i, [0.5, 0.25], 1 if i % 3 else 2) for i in range(0, 600, 5)]
    some = [(1000 + i, [0.25, 0.25], 3) for i in range(40)]
    rows = same + some
    assert mined(spark, rows) == brute(rows)


def test_edges(spark):
    rows = vectors(60) + [(100, None, 1), (200, [0.1, None], 1), (300, [0.1, float("nan")], 2), (400, [float("inf")], 0),
                          (7, [0.4] * 5, None), (None, [0.9] * 5, 1), (None, [0.7] * 5, 2), (5000, [], 1), (5100, [1.0] * 9, 1),
                          (5200, [3.0], 2), vectors(60)[4], vectors(60)[0], (100, [0.3] * 5, 2)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, [(5, [1.0], 1), (6, [1.0], 1)]) == []


def test_other_columns_and_empty_tables(spark):
    rows = vectors(40)
    wide = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA + ", bucket string, score string, no string")
    got = sorted((tuple(r) for r in mine(wide, F.col("vec_id") % 100 == 0).collect()), key=repr)
    assert got == brute(rows)
    assert mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).collect() == []


def test_huge_components_stay_defined(spark):
    rows = [(0, [3e38, 1.0], 1), (1, [1.0, 2.0], 1), (2, [-3e38, 1.0], 2), (3, [1.0, 1.0], 2)]
    assert all(r.anchor_id == 0 for r in mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") == 0).collect())


def test_no_block_goes_through_the_driver(spark, monkeypatch):
    """A side whose estimated size is under Spark's limit for broadcasts still has many copies of each block."""
    plans = []
    of = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or df
    for name in ("materialize", "table"):
        monkeypatch.setattr(hard_negatives, name, lambda df, *a, f=getattr(hard_negatives, name): f(of(df), *a))
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(1 << 30))
    try:
        rows = vectors(120)
        out = mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0)
        assert sorted((tuple(r) for r in of(out).collect()), key=repr) == brute(rows)
        of(out)  # as it ran
    finally:
        spark.conf.set(limit, before)
    assert sum("SortMergeJoin" in p for p in plans) >= 5
    assert not any("Broadcast" in p for p in plans)
