"""Isolation forest on Spark (K1-K6), after Liu, Ting and Zhou (2008).

Fit: every tree draws its own subsample of min(``max_samples``, rows) rows without replacement: the rows
with the smallest hash(seed, tree, row key) of a common pool. A hash filter keeps about 4 x max_samples
candidates per tree, so the per-tree window and the per-tree ``applyInPandas`` group hold a bounded
number of rows whatever the table size. Each group grows one tree with numpy and returns its nodes.

Score: the node table is bounded by n_trees x (2 x max_samples - 1) rows, so it is shipped to the
tasks once; a pandas UDF over the four features walks all trees for an Arrow batch at a time (vectorised over rows).
The anomaly threshold is the ``contamination`` quantile of the training scores (percentile_approx).
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskstream.config import EngineConfig
from riskstream.session import materialize, ship_package

FEATURES = ["txn_count_f", "total_amount_f", "duration_min", "amount_per_txn"]
EULER = 0.5772156649015329

NODE_SCHEMA = T.StructType([
    T.StructField("tree", T.IntegerType()),
    T.StructField("node", T.IntegerType()),
    T.StructField("feature", T.IntegerType()),
    T.StructField("threshold", T.DoubleType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
])


def alert_features(alerts: DataFrame) -> DataFrame:
    """K1: count, total, window length in minutes (at least 1 ms), amount per transaction; nulls -> 0."""
    n = F.coalesce(F.col("txn_count").cast("double"), F.lit(0.0))
    tot = F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0))
    dur = F.greatest(F.coalesce(F.col("window_end").cast("double"), F.lit(0.0))
                     - F.coalesce(F.col("window_start").cast("double"), F.lit(0.0)), F.lit(1.0)) / F.lit(60000.0)
    return alerts.select("*", n.alias("txn_count_f"), tot.alias("total_amount_f"), dur.alias("duration_min"),
                         F.when(n > 0, tot / n).otherwise(F.lit(0.0)).alias("amount_per_txn"))


def avg_path(n):
    """c(n): mean path length of an unsuccessful BST search; c(1) = 0, c(2) = 1."""
    n = np.asarray(n, dtype=float)
    out = np.zeros_like(n)
    big = n > 2
    out[n == 2] = 1.0
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int):
    nodes = []  # (feature, threshold, left, right, size, depth)

    def rec(idx, depth):
        me = len(nodes)
        nodes.append(None)
        sub = x[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[me] = (-1, 0.0, -1, -1, len(idx), depth)
            return me
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        usable = np.flatnonzero(hi > lo)
        if usable.size == 0:
            nodes[me] = (-1, 0.0, -1, -1, len(idx), depth)
            return me
        f = int(rng.choice(usable))
        thr = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < thr
        left = rec(idx[go_left], depth + 1)
        right = rec(idx[~go_left], depth + 1)
        nodes[me] = (f, thr, left, right, len(idx), depth)
        return me

    rec(np.arange(len(x)), 0)
    return nodes


def _build_tree_fn(seed: int, max_depth: int):
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("_h", kind="mergesort")
        x = pdf[FEATURES].to_numpy(dtype=float)
        rng = np.random.default_rng([seed, tree])
        nodes = _grow(x, rng, max_depth)
        return pd.DataFrame({
            "tree": tree, "node": np.arange(len(nodes), dtype=np.int32),
            "feature": [n[0] for n in nodes], "threshold": [n[1] for n in nodes],
            "left": [n[2] for n in nodes], "right": [n[3] for n in nodes],
            "size": [n[4] for n in nodes], "depth": [n[5] for n in nodes],
        }).astype({"feature": "int32", "left": "int32", "right": "int32", "size": "int32", "depth": "int32"})

    return build


def _hash63(seed: int, tree: Column, key: Column) -> Column:
    return F.xxhash64(F.lit(seed), tree, key).bitwiseAND(F.lit((1 << 63) - 1))


def _below(share: float) -> Column:
    """The 63-bit hash below which about ``share`` of all rows lie."""
    return F.lit((1 << 63) - 1 if share >= 1 else int(share * (1 << 63)))


def dense_nodes(nodes: pd.DataFrame) -> tuple:
    """Node table as dense [tree, node] arrays: feature, threshold, left, right, size, depth."""
    t = nodes["tree"].to_numpy()
    trees = np.unique(t)
    tix = np.searchsorted(trees, t)
    n = nodes["node"].to_numpy()
    shape = (len(trees), int(n.max()) + 1 if len(n) else 1)
    feat = np.full(shape, -1, dtype=np.int64)
    arrays = [feat, np.zeros(shape), np.zeros(shape, dtype=np.int64), np.zeros(shape, dtype=np.int64),
              np.zeros(shape), np.zeros(shape)]
    for arr, col in zip(arrays, ["feature", "threshold", "left", "right", "size", "depth"]):
        arr[tix, n] = nodes[col].to_numpy()
    return tuple(arrays)


def path_lengths(dense: tuple, x: np.ndarray) -> np.ndarray:
    """Mean path length over all trees, walking every (row, tree) pair at once, one level per step."""
    feat, thr, left, right, size, depth = dense
    n_trees = feat.shape[0]
    if len(x) == 0 or n_trees == 0:
        return np.zeros(len(x))
    tree_ix = np.broadcast_to(np.arange(n_trees), (len(x), n_trees))
    row_ix = np.broadcast_to(np.arange(len(x))[:, None], (len(x), n_trees))
    cur = np.zeros((len(x), n_trees), dtype=np.int64)
    while True:
        f = feat[tree_ix, cur]
        inner = f >= 0
        if not inner.any():
            break
        go_left = x[row_ix, np.where(inner, f, 0)] < thr[tree_ix, cur]
        cur = np.where(inner, np.where(go_left, left[tree_ix, cur], right[tree_ix, cur]), cur)
    return (depth[tree_ix, cur] + avg_path(size[tree_ix, cur])).mean(axis=1)


def score_samples_np(dense: tuple, psi: int, x: np.ndarray) -> np.ndarray:
    """Negated anomaly score in [-1, 0): -2^(-E[h(x)] / c(psi))."""
    c = float(avg_path(np.array([psi]))[0]) or 1.0
    return -np.power(2.0, -path_lengths(dense, x) / c)


def ml_score_np(dense: tuple, psi: int, offset: float, x: np.ndarray) -> np.ndarray:
    """K3: 0 for inliers; for outliers min(|score_samples| / 2, 1)."""
    s = score_samples_np(dense, psi, x)
    return np.where(s < offset, np.minimum(np.abs(s) / 2.0, 1.0), 0.0)


@dataclass
class Forest:
    """A fitted forest. ``nodes`` is bounded by n_trees x (2 psi - 1) rows; tasks receive its dense
    arrays once per executor through a broadcast variable, not inside every task closure."""

    nodes: pd.DataFrame
    psi: int
    offset: float
    version: str
    n_trees: int
    _dense: tuple | None = None
    _bc: dict | None = None

    def dense(self) -> tuple:
        if self._dense is None:
            self._dense = dense_nodes(self.nodes)
        return self._dense

    def score_samples(self, x: np.ndarray) -> np.ndarray:
        return score_samples_np(self.dense(), self.psi, x)

    def ml_score(self, x: np.ndarray) -> np.ndarray:
        return ml_score_np(self.dense(), self.psi, self.offset, x)

    def broadcast(self, spark):
        """One broadcast of (dense arrays, psi, offset) per application."""
        self._bc = self._bc or {}
        app = spark.sparkContext.applicationId
        if app not in self._bc:
            self._bc[app] = spark.sparkContext.broadcast((self.dense(), self.psi, self.offset))
        return self._bc[app]

    def _map(self, feats: DataFrame, column: str, kind: str) -> DataFrame:
        """Add ``column``; only the four feature doubles go through Python."""
        ship_package(feats.sparkSession)
        bc = self.broadcast(feats.sparkSession)

        def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
            dense, psi, offset = bc.value
            x = np.column_stack([a, b, c, d]).astype(float)
            return pd.Series(ml_score_np(dense, psi, offset, x) if kind == "ml" else score_samples_np(dense, psi, x))

        return feats.withColumn(column, F.pandas_udf(run, "double")(*FEATURES))

    def scorer(self, column: str = "ml_score"):
        """A DataFrame -> DataFrame function adding ``column`` (for :func:`score_alerts`)."""
        forest = self

        def apply(df: DataFrame) -> DataFrame:
            return forest._map(alert_features(df), column, "ml").drop(*FEATURES)

        return apply

    def score_column_df(self, feats: DataFrame, column: str = "score_sample") -> DataFrame:
        return self._map(feats, column, "raw")

    def save(self, path: str, spark) -> None:
        """Persist the node table and, last, the parameters: a folder without ``meta`` holds no model."""
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.psi, self.offset, self.version, self.n_trees)],
                              "psi int, offset double, version string, n_trees int") \
            .write.mode("overwrite").parquet(f"{path}/meta")

    @staticmethod
    def load(path: str, spark) -> "Forest":
        m = spark.read.parquet(f"{path}/meta").first()
        nodes = spark.read.parquet(f"{path}/nodes").toPandas()  # bounded node table
        return Forest(nodes=nodes, psi=m["psi"], offset=m["offset"], version=m["version"], n_trees=m["n_trees"])


def pool_share(cfg: EngineConfig, n: int) -> float:
    """The share of ``n`` rows that is in the pool: about 8 x trees x psi rows, or all."""
    return min(1.0, 8.0 * cfg.n_trees * min(cfg.max_samples, n) / max(n, 1))


def pool_of(feats: DataFrame, key: str, cfg: EngineConfig, n: int) -> DataFrame:
    """The rows that trees are grown from when there are ``n``. The share never grows with ``n`` above the pool's size, so the
    pool of a longer history is a part of the older pools and the newer rows: pools can be kept in place of the history."""
    return feats.where(_hash63(cfg.seed, F.lit(-1), F.col(key).cast("string")) <= _below(pool_share(cfg, n)))


def tree_samples(feats: DataFrame, key: str, cfg: EngineConfig, n: int) -> DataFrame:
    """Per-tree subsamples of min(psi, n) rows without replacement, deterministic for the seed.

    One rule at every size: a pool of about 8 x trees x psi rows, those with the smallest hash of their key, or all rows
    if there are fewer; from it every tree draws the psi rows with the smallest hash(seed, tree, key). Before the
    per-tree window only about 4 x psi candidates a tree remain, so a row outside the pool costs one hash."""
    psi = min(cfg.max_samples, n)
    k = F.col(key).cast("string")
    share = min(1.0, 4.0 * psi / max(pool_share(cfg, n) * n, 1))
    trees = F.sequence(F.lit(0), F.lit(cfg.n_trees - 1))
    cand = (pool_of(feats, key, cfg, n).select(
        key, *FEATURES, F.explode(F.filter(trees, lambda t: _hash63(cfg.seed, t, k) <= _below(share))).alias("tree"))
        .withColumn("_h", _hash63(cfg.seed, F.col("tree"), k)))
    w = Window.partitionBy("tree").orderBy("_h", key)
    return cand.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= psi).drop("_rn")


def _trees(feats: DataFrame, cfg: EngineConfig, key: str, n: int) -> DataFrame:
    depth = int(math.ceil(math.log2(max(min(cfg.max_samples, n), 2))))
    return tree_samples(feats, key, cfg, n).groupBy("tree").applyInPandas(_build_tree_fn(cfg.seed, depth), NODE_SCHEMA)


def model_version(nodes: pd.DataFrame) -> str:
    """An id of the node table itself: equal forests, and only those, share it."""
    ordered = nodes.sort_values(["tree", "node"])[[f.name for f in NODE_SCHEMA]]
    return "if-" + hashlib.md5(pd.util.hash_pandas_object(ordered, index=False).to_numpy().tobytes()).hexdigest()[:12]


def fit(alerts: DataFrame, cfg: EngineConfig, key: str) -> Forest | None:
    """K2/K6: fit on the alerts (one row per ``key``); None below ``min_training_samples``."""
    ship_package(alerts.sparkSession)
    # the training set is read three times (count, per-tree samples, offset pass): written once
    feats = materialize(alert_features(alerts).select(key, *FEATURES), "iforest-train")
    n = feats.count()
    if n < cfg.min_training_samples:
        return None
    nodes = _trees(feats, cfg, key, n).toPandas()  # bounded: n_trees x (2 psi - 1) rows
    return _with_offset(nodes, feats, cfg, min(cfg.max_samples, n))


def fit_pool(pool: DataFrame, cfg: EngineConfig, key: str, n: int) -> Forest | None:
    """K2/I8: the forest of a history of ``n`` rows from its pool (:func:`pool_of`, with the K1 features): the same trees as
    :func:`fit` grows from all rows. The offset is the quantile of the pool's scores, a uniform sample of the history by hash,
    or all of it as long as that has no more than 8 x trees x psi rows."""
    ship_package(pool.sparkSession)
    if n < cfg.min_training_samples:
        return None
    feats = pool.select(key, *FEATURES)
    nodes = _trees(feats, cfg, key, n).toPandas()  # bounded: n_trees x (2 psi - 1) rows
    return _with_offset(nodes, feats, cfg, min(cfg.max_samples, n))


def _with_offset(nodes: pd.DataFrame, feats: DataFrame, cfg: EngineConfig, psi: int) -> Forest:
    version = model_version(nodes)
    forest = Forest(nodes=nodes, psi=psi, offset=0.0, version=version, n_trees=cfg.n_trees)
    scored = forest.score_column_df(feats)
    offset = scored.agg(F.percentile_approx("score_sample", F.lit(cfg.contamination), F.lit(100000))).first()[0]
    # a new object: the probe's broadcast carries offset 0 and must not be reused
    return Forest(nodes=nodes, psi=psi, offset=float(offset), version=version, n_trees=cfg.n_trees,
                  _dense=forest.dense())


def fit_nodes(alerts: DataFrame, cfg: EngineConfig, key: str) -> DataFrame:
    """The fitted node table as a DataFrame (what K2 persists); no rows below ``min_training_samples`` (K6)."""
    ship_package(alerts.sparkSession)
    feats = materialize(alert_features(alerts).select(key, *FEATURES), "iforest-train")
    n = feats.count()
    if n < cfg.min_training_samples:
        return alerts.sparkSession.createDataFrame([], NODE_SCHEMA)
    return _trees(feats, cfg, key, n)


def should_retrain(n_samples: int, since_retrain: int, trained: bool, cfg: EngineConfig) -> bool:
    """K5: first fit at ``min_training_samples``, then every ``retrain_interval`` new samples."""
    if not trained:
        return n_samples >= cfg.min_training_samples
    return since_retrain >= cfg.retrain_interval
