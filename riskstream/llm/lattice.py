"""Subword lattice likelihood: marginal probability of a text over all ways to cut its words into pieces.

The pieces are those of an existing vocabulary file. Its scores, the ranks of the pieces, give the first weights,
``1 / (RANK_OFFSET - score)``; ``ROUNDS`` rounds of expectation maximization over the distinct training words make them
probabilities: each adds up, over all words and all their segmentations, how often a piece is expected, with the first
weights as ``PRIOR`` pseudo-counts. A character without a piece is written in bytes, which share one class. The sum over a
word's segmentations is computed by the forward recursion in log space, over many words of equal length at once.

A word that training texts have is also one edge of its lattice, from its start to its end, with the share of its count
less ``DISCOUNT``; what the discounts leave is the weight of all paths through pieces. So the probability of a word is
``max(c - DISCOUNT, 0) / N + DISCOUNT * types / N * pieces(word)``, and that of a text is the product of its words' and of
the end token's, its count in N: it sums to at most 1 over all texts.

Both the word counts that the base score needs and the lattice depend on a word only. So all distinct words are counted
first, in Spark, and scored once each; the documents then look up the ``HEAVY`` most frequent words at most in a broadcast
table of bounded size, and join the rest by the words' 64-bit hashes.

Defined results: a null text counts as empty, which has the end token only; a null ``doc_id`` is held out; rows with equal
ids are scored each for itself; without training words the base score is that of an empty count table; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import materialize, ship_package
from riskstream.llm.piecetable import SPACE, code_points, equal_lengths, piece_table

RANK_OFFSET = 10.0
ROUNDS = 2
PRIOR = 1000.0
DISCOUNT = 0.75
HEAVY = 1 << 18
WORDS = 400_000  # distinct words that a counting task holds
ALPHA = 0.1

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_LATTICES: dict[str, Lattice] = {}


class Lattice:
    """The pieces of a vocabulary file, numbered from 0; number ``size`` is the class of bytes."""

    def __init__(self, path: str):
        self.table = piece_table(path)
        self.size, self.max_len = self.table.size, self.table.max_len
        weight = 1 / (RANK_OFFSET - self.table.scores)
        self.first = np.append(weight, np.sort(weight)[len(weight) // 100])
        self.first /= self.first.sum()

    def _edges(self, words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """The pieces in words of equal length, and the bytes of each of their characters."""
        codes = code_points([SPACE + w for w in words])
        return self.table.edges(codes), 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)

    def _weights(self, edges: list[np.ndarray], sizes: np.ndarray, logs: np.ndarray) -> list[np.ndarray]:
        padded = np.append(logs[:self.size], -np.inf)
        out = [padded[e] for e in edges]
        out[0] = np.where(edges[0] < 0, sizes * (logs[self.size] - math.log(256)), out[0])
        return out

    @staticmethod
    def _sums(weights: list[np.ndarray], backward: bool) -> np.ndarray:
        """Log sums over all paths from the start to each place, or from each place to the end."""
        rows, width = weights[0].shape
        a = np.zeros((width + 1, rows))
        for j in range(width - 1, -1, -1) if backward else range(1, width + 1):
            terms = ([w[:, j] + a[j + k] for k, w in enumerate(weights, 1) if j + k <= width] if backward else
                     [w[:, j - k] + a[j - k] for k, w in enumerate(weights, 1) if j >= k])
            t = np.stack(terms)
            top = t.max(axis=0)
            a[j] = top + np.log(np.exp(t - top).sum(axis=0))
        return a

    def log10(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        """Marginal log10 probability of each word."""
        out = np.empty(len(words))
        for at in equal_lengths(words, self.max_len):
            w = self._weights(*self._edges([words[i] for i in at]), logs)
            out[at] = self._sums(w, False)[-1]
        return out / math.log(10)

    def expected(self, words: list[str], times: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """How often each piece is expected in ``times`` copies of the words."""
        total = np.zeros(self.size + 1)
        for at in equal_lengths(words, self.max_len):
            edges, sizes = self._edges([words[i] for i in at])
            weights = self._weights(edges, sizes, logs)
            a, b = self._sums(weights, False), self._sums(weights, True)
            width = sizes.shape[1]
            for k, (e, w) in enumerate(zip(edges, weights), 1):
                p = np.exp(a[:width + 1 - k].T + w + b[k:].T - a[-1][:, None]) * times[at][:, None]
                hit = e >= 0
                total[:self.size] += np.bincount(e[hit], p[hit], self.size)
                if k == 1:
                    total[self.size] += (p * sizes)[~hit].sum()
        return total


def lattice(path: str) -> Lattice:
    if path not in _LATTICES:
        _LATTICES[path] = Lattice(path)
    return _LATTICES[path]


def _words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # of bytes: A-Z only, and the six white-space characters


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of words, in training texts and in all."""
    held = {True: Counter(), False: Counter()}

    def flush():
        train, rest = held[True], held[False]
        words = list(train.keys() | rest.keys())
        out = pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in words], pa.string()),
                                          "c": pa.array([train[w] for w in words], pa.int64()),
                                          "n": pa.array([train[w] + rest[w] for w in words], pa.int64())})
        train.clear()
        rest.clear()
        return out

    for b in batches:
        for text, out in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist()):
            held[not out].update(_words(text))
            if len(held[True]) + len(held[False]) > WORDS:
                yield flush()
    yield flush()


def _expect(path, logs):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattice(path)
        total = np.zeros(lat.size + 1)
        for b in batches:
            total += lat.expected(b.column("word").to_pylist(), np.ones(b.num_rows), logs.value)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": some, "times": total[some]})

    return expect


def piece_logs(words: DataFrame, vocabulary: str) -> np.ndarray:
    """Natural logs of the piece probabilities learned from the words with c > 0 of (word, c)."""
    spark, lat = words.sparkSession, lattice(vocabulary)
    p = lat.first
    for _ in range(ROUNDS):
        got = (words.where("c > 0").select("word")
               .mapInArrow(_expect(vocabulary, spark.sparkContext.broadcast(np.log(p))), "piece long, times double")
               .groupBy("piece").agg(F.sum("times").alias("times")).collect())  # a row a piece
        total = PRIOR * lat.first
        for r in got:
            total[r.piece] += r.times
        p = total / total.sum()
    return np.log(p)


def _score_words(path, logs, n_train, word_types):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lat = lattice(path)
        left = math.log(DISCOUNT * word_types / n_train) if word_types else 0.0
        for b in batches:
            words, c = b.column("word").to_pylist(), b.column("c").to_numpy()
            keys = np.array([xxhash.xxh3_64_intdigest(w.encode()) for w in words], _U).astype(np.int64)
            yield pa.RecordBatch.from_pydict({
                "word": b.column("word"), "n": b.column("n"), "key": keys, "known": (c > 0).astype(np.int32),
                "base": np.log10((c + ALPHA) / (n_train + ALPHA * (word_types + (n_train > 0) + 1))),
                "score": np.logaddexp(np.log(np.maximum(c - DISCOUNT, 1e-300) / max(n_train, 1)),
                                      left + lat.log10(words, logs.value) * math.log(10)) / math.log(10)})

    return score


DOC = ("row_key long, key long, times int, doc_id long, held_out boolean, n_tokens long, n_known long, base double, "
       "score double")


def _score_docs(heavy, end):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        numbers, known, base, lp = heavy.value
        known, base, lp = (np.append(x, 0) for x in (known, base, lp))  # the last stands for all other words
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                docs = {k: [] for k in ("row_key", "n_tokens", "n_known", "base", "score")}
                keys, times, owners = [], [], []
                for text in part.column("text").to_pylist():
                    row += 1
                    words = _words(text)
                    at = np.array(list(map(numbers.get, words, [len(numbers)] * len(words))), np.int64)
                    if (at == len(numbers)).any():
                        rest = Counter([w for w in words if w not in numbers])
                        keys += map(xxhash.xxh3_64_intdigest, rest)
                        times += rest.values()
                        owners += [row] * len(rest)
                    for k, v in zip(docs, (row, len(words) + 1, int(known[at].sum()) + end[0],
                                           float(base[at].sum()) + end[1], float(lp[at].sum()) + end[2])):
                        docs[k].append(v)
                n, m = len(docs["row_key"]), len(keys)
                own = (np.array(docs["row_key"], np.int64).astype(_U) * _BASE).astype(np.int64)  # deals them out evenly
                pad = lambda x, kind: pa.concat_arrays([pa.array(x, kind), pa.nulls(m, kind)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs["row_key"] + owners, pa.int64()),
                    pa.array(np.concatenate([own, np.array(keys, _U).astype(np.int64)])),
                    pa.array([0] * n + times, pa.int32()),
                    pa.concat_arrays([part.column("doc_id"), pa.nulls(m, pa.int64())]),
                    pa.concat_arrays([part.column("held_out"), pa.nulls(m, pa.bool_())]),
                    pad(docs["n_tokens"], pa.int64()), pad(docs["n_known"], pa.int64()),
                    pad(docs["base"], pa.float64()), pad(docs["score"], pa.float64())],
                    names=[c.split()[0] for c in DOC.split(", ")])

    return score


def _heavy(words: DataFrame) -> list:
    """The most frequent words, ``HEAVY`` at most: those above the lowest eighth of a power of two that leaves so many."""
    step = F.floor(F.log2("n") * 8).cast("int")
    least, room = 1 << 30, HEAVY
    for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():  # a row a step
        if r["count"] > room:
            break
        least, room = r.step, room - r["count"]
    return words.where(step >= least).select("word", "known", "base", "score").collect()


def scores(docs: DataFrame, vocabulary: str, held_out_of: int = 10) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document.

    Training documents are those whose crc32 of the id modulo ``held_out_of`` is not 0."""
    spark = docs.sparkSession
    ship_package(spark)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                    (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % held_out_of == 0)
                    .alias("held_out"))
    words = materialize(d.select("text", "held_out").mapInArrow(_count, "word string, c long, n long").groupBy("word")
                        .agg(F.sum("c").alias("c"), F.sum("n").alias("n")), "lm-words")
    training_docs = d.where("not held_out").count()
    total = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"), F.count_if(F.col("c") > 0).alias("types")).first()
    n_train, n_types = total.c + training_docs, total.types + (training_docs > 0)
    logs = piece_logs(words, vocabulary)
    scored = materialize(words.mapInArrow(_score_words(vocabulary, spark.sparkContext.broadcast(logs), n_train, total.types),
                                          "word string, n long, key long, known int, base double, score double"),
                         "lm-scored")
    top = _heavy(scored)
    heavy = spark.sparkContext.broadcast(({r.word.encode(): i for i, r in enumerate(top)},
                                          np.array([r.known for r in top], np.int64), np.array([r.base for r in top]),
                                          np.array([r.score for r in top])))
    end = (int(training_docs > 0), math.log10((training_docs + ALPHA) / (n_train + ALPHA * (n_types + 1))),
           math.log10(training_docs / n_train) if training_docs else 0.0)
    rows = d.mapInArrow(_score_docs(heavy, end), DOC)
    w = scored.select(F.col("key").alias("w_key"), F.col("known").alias("w_known"), F.col("base").alias("w_base"),
                      F.col("score").alias("w_score"))

    def both(own, word):
        return F.sum(F.coalesce(F.col(own), F.lit(0)) + F.col("times") * F.coalesce(F.col(word), F.lit(0)))

    return (rows.join(w, F.col("key") == F.col("w_key"), "left").groupBy("row_key")
            .agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
                 both("n_known", "w_known").alias("n_known"), both("base", "w_base").alias("base_score"),
                 both("score", "w_score").alias("score"))
            .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"),
                    "base_score", "score"))
