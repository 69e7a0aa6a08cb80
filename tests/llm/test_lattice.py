import math
import zlib
from collections import Counter

import numpy as np
import pytest

from riskstream.llm import lattice as L
from riskstream.llm.queries import vocabulary

from .conftest import LONG, edge_rows, rows


@pytest.fixture(scope="module")
def path():
    return vocabulary("piece_bpe_32k.model")


def all_paths(lat, word, logs):
    """Sum over all segmentations of a word, one by one."""
    number = {p: i for i, p in enumerate(lat.table.pieces)}
    text = "▁" + word

    def total(at):
        if at == len(text):
            return 1.0
        out = 0.0
        for end in range(at + 1, len(text) + 1):
            p = text[at:end]
            if p in number:
                out += math.exp(logs[number[p]]) * total(end)
            elif end == at + 1:
                out += math.exp(len(p.encode()) * (logs[lat.size] - math.log(256))) * total(end)
        return out

    return total(0)


WORDS = ["the", "a", "thing", "é", "日本", "x<", "ingtion", "", "😀z"]


def test_marginal_over_all_segmentations(path):
    lat = L.lattice(path)
    logs = np.log(lat.first)
    got = lat.log10(WORDS, logs)
    assert np.allclose(got, [math.log10(all_paths(lat, w, logs)) for w in WORDS], rtol=1e-9)
    long = "ab" * 3000  # far below the smallest double
    assert -1e6 < lat.log10([long], logs)[0] < -1000


def test_expected_counts_explain_every_character(path):
    lat = L.lattice(path)
    got = lat.expected(["the", "thing"], np.array([3.0, 1.0]), np.log(lat.first))
    sizes = np.array([len(p) for p in lat.table.pieces])
    assert abs((got[:lat.size] * sizes).sum() - (3 * 4 + 6)) < 1e-6 and got[lat.size] == 0


def test_training_raises_the_likelihood(spark, path):
    words = spark.createDataFrame([(w, 1) for w in sorted(set(LONG.split()))], "word string, c long")
    lat, logs = L.lattice(path), L.piece_logs(words, path)
    some = sorted(set(LONG.split()))[:200]
    assert lat.log10(some, logs).sum() > lat.log10(some, np.log(lat.first)).sum() + 200
    assert abs(np.exp(logs).sum() - 1) < 1e-9


def base(rows_):
    c, docs = Counter(), 0
    for i, t, *_ in rows_:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 10:
            c.update((t or "").encode().lower().split())
            docs += 1
    n, v = sum(c.values()) + docs, len(c) + (docs > 0)
    out = []
    for i, t, *_ in rows_:
        w = (t or "").encode().lower().split()
        s = sum(math.log10((x + 0.1) / (n + 0.1 * (v + 1))) for x in [*(c[k] for k in w), docs])
        out.append((i, len(w) + 1, sum(c[k] > 0 for k in w) + (docs > 0), n, round(s, 6)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("heavy", [L.HEAVY, 8])
def test_base_score(edges, clashing, nothing, path, monkeypatch, heavy):
    monkeypatch.setattr(L, "HEAVY", heavy)
    got = L.scores(edges, path)
    assert sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.collect()],
                  key=repr) == base(edge_rows())
    same = [[(r[0], round(r[6], 6)) for r in rows(L.scores(d, path))] for d in (edges, clashing)]
    assert same[0] == same[1] and all(s < 0 for _, s in same[0])
    assert L.scores(nothing, path).count() == 0


def test_probabilities_of_known_words_sum_to_at_most_one(make, path):
    docs = make([f"{w} {w} common" for w in ("one", "two", "three", "four")])
    got = {r.doc_id: r for r in L.scores(docs, path).collect()}
    assert all(r.score < 0 for r in got.values())
