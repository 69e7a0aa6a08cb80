"""Quality classifier: random-indexing word vectors, pooled per document, and a small network with calibrated outputs.

A token's index vector has ``NONZERO`` entries of plus or minus one at places given by its hash. Its word vector is the sum
of the index vectors of the tokens within ``WINDOW`` places of it, over the texts of all documents, labelled or not; tokens
share ``BUCKETS`` vectors by hash, so the table has a fixed size. A document is the mean of its tokens' word vectors, each of length one, with three
measures of its length, variety and repetition. A network of two layers, trained in numpy, gives a logit, and a temperature that
minimizes the loss on rows kept aside turns it into a probability.

The network is fitted on at most about ``SAMPLE`` labelled rows, chosen by a hash of the id, outside the held-out
part; every document is scored, over its whole text. Language, source, id and labels are no inputs of a score.

Defined results: a null text counts as empty; a text without tokens has the zero vector and is scored like any other;
documents without a label, and labels that are null or contradict each other, are not fitted on; without labels of both
kinds every score is the share of label 1 (one half if there is none); a null id is held out and scored; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import materialize, ship_package

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 64, 4, 2
SAMPLE = 20_000
FIT_PARTS = 8  # tasks that pool the labelled rows
HIDDEN, STEPS, RATE, BATCH, DECAY = 32, 3000, 0.005, 256, 1e-4
ASIDE = 5  # one fitting row in so many is kept for the temperature
THRESHOLD = 0.7
INPUTS = DIM + 3
CACHE = 300_000
TOKENS = 500_000  # whose neighbours are added up at once

TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
_KNOWN: dict[str, int] = {}


def buckets(text: str) -> np.ndarray:
    """The bucket of each token."""
    global _KNOWN
    if len(_KNOWN) > CACHE:
        _KNOWN = {}
    known, tokens = _KNOWN, TOKEN.findall(text)
    at = list(map(known.get, tokens))
    if None in at:
        for i, b in enumerate(at):
            if b is None:
                at[i] = known[tokens[i]] = zlib.crc32(tokens[i].encode()) % BUCKETS
    return np.array(at, np.int64)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    h = np.arange(BUCKETS * NONZERO, dtype=np.uint64).reshape(BUCKETS, NONZERO)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h + np.uint64(0x9E3779B97F4A7C15)) ^ (h >> np.uint64(shift))
        h = h * np.uint64(mult)
    h ^= h >> np.uint64(31)
    return (h % np.uint64(DIM)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0)


def _context(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums of neighbours' index vectors for each bucket, over the task's texts."""
    places, signs = index_vectors()
    places, signs = np.vstack([places, places[:1]]), np.vstack([signs, 0 * signs[:1]])  # the last stands between texts
    gap = np.full(WINDOW, BUCKETS)
    total = np.zeros((BUCKETS + 1) * DIM)

    def add(parts: list[np.ndarray]) -> None:
        t = np.concatenate(parts)
        for d in range(1, WINDOW + 1):
            for word, near in ((t[d:], t[:-d]), (t[:-d], t[d:])):
                for k in range(NONZERO):
                    total[:] += np.bincount(word * DIM + places[near, k], signs[near, k], len(total))

    held, size = [gap], 0
    for b in batches:
        for text in b["text"]:
            held += [buckets(text), gap]
            size += len(held[-2])
            if size >= TOKENS:
                add(held)
                held, size = [gap], 0
    add(held + [gap])
    total = total[:BUCKETS * DIM]
    total = total.reshape(BUCKETS, DIM)
    used = np.flatnonzero(np.abs(total).sum(axis=1))
    yield pd.DataFrame({"bucket": used, "vector": pd.Series([v.tolist() for v in total[used]], dtype=object)})


def pooled(text: str, vectors: np.ndarray) -> np.ndarray:
    """The inputs of the network for a text."""
    t = buckets(text)
    out = np.zeros(INPUTS)
    if len(t):
        out[:DIM] = vectors[t].mean(axis=0, dtype=np.float64) * np.sqrt(DIM)
        out[DIM] = np.log1p(len(t))
        out[DIM + 1] = len(np.unique(t)) / len(t)
        out[DIM + 2] = (t[1:] == t[:-1]).mean() if len(t) > 1 else 0
    return out


class Network:
    """Two layers: tanh units, then one logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7):
        self.share = float(y.mean()) if len(y) else 0.5
        self.ready = len(y) > ASIDE and 0 < y.sum() < len(y)
        if not self.ready:
            return
        rng = np.random.default_rng(seed)
        aside = np.arange(len(y)) % ASIDE == 0
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        fit, fit_y = z[~aside], y[~aside]
        params = [rng.normal(0, INPUTS ** -0.5, (INPUTS, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN),
                  np.zeros(1)]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, STEPS + 1):
            at = rng.integers(0, len(fit), BATCH)
            h = np.tanh(fit[at] @ params[0] + params[1])
            error = (1 / (1 + np.exp(-(h @ params[2] + params[3]))) - fit_y[at]) / BATCH
            back = np.outer(error, params[2]) * (1 - h * h)
            grads = [fit[at].T @ back + DECAY * params[0], back.sum(axis=0), h.T @ error + DECAY * params[2],
                     np.array([error.sum()])]
            rate = RATE * (1 - step / (STEPS + 1))
            for p, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        self.params, self.temperature = params, 1.0
        logits, truth = self._logits(z[aside]), y[aside]
        ladder = np.geomspace(0.05, 8, 201)
        ones = truth.sum()  # targets short of 0 and 1 keep the temperature from running to zero on separable rows
        goal = np.where(truth > 0, (ones + 1) / (ones + 2), 1 / (len(truth) - ones + 2))
        losses = [(np.logaddexp(0, logits / t) - goal * logits / t).mean() for t in ladder]
        self.temperature = float(ladder[int(np.argmin(losses))])

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.params[0] + self.params[1]) @ self.params[2] + self.params[3]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.share)
        return 1 / (1 + np.exp(-self._logits(self._scaled(x)) / self.temperature))


def _pool(vectors):
    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "x": pd.Series([pooled(t, vectors.value).tolist() for t in b["text"]],
                                                            dtype=object)})

    return pool


def fit(docs: DataFrame, labels: DataFrame, held_out_of: int = 4, held_out: int = 2):
    """Word vectors and network, as broadcasts."""
    spark = docs.sparkSession
    ship_package(spark)
    mine = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
            .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of != held_out)
            .groupBy("doc_id").agg(F.min("quality").alias("y"), F.max("quality").alias("top")).where("y = top"))
    share = min(1.0, SAMPLE / max(1, mine.count()))
    chosen = mine.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))).select(
        F.col("doc_id").alias("label_id"), "y")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = texts.join(
        F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # SAMPLE rows, about, by choice
    rows = materialize(rows.select("doc_id", "text", "y").repartition(FIT_PARTS, "doc_id"), "quality-fit")
    sums = texts.select("text").mapInPandas(_context, "bucket int, vector array<double>")
    total = np.zeros((BUCKETS, DIM))
    for r in sums.groupBy("bucket").agg(*[F.sum(F.get("vector", F.lit(i))).alias(f"v{i}") for i in range(DIM)]).collect():
        total[r.bucket] = r[1:]  # BUCKETS rows at most
    vectors = spark.sparkContext.broadcast(
        (total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-9)).astype(np.float32))
    got = rows.orderBy("doc_id", "text").select("y", "text").mapInPandas(_pool(vectors), "y int, x array<double>").collect()
    x = np.array([r.x for r in got]).reshape(len(got), INPUTS)
    return vectors, spark.sparkContext.broadcast(Network(x, np.array([r.y for r in got], float)))


def _scorer(vectors, network):
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([pooled(t, vectors.value) for t in texts]).reshape(len(texts), INPUTS)
        return pd.Series(network.value.score(x))

    return F.pandas_udf(score, "double")


def quality(docs: DataFrame, labels: DataFrame, held_out_of: int = 4, held_out: int = 2) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    score = _scorer(*fit(docs, labels, held_out_of, held_out))
    aside = F.crc32(F.col("doc_id").cast("string").cast("binary")) % held_out_of == held_out
    return (docs.select("doc_id", F.coalesce(aside, F.lit(True)).alias("held_out"),
                        score(F.coalesce("text", F.lit(""))).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))
