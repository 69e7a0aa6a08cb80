import zlib

import numpy as np
import pandas as pd

from riskstream.llm import classifier as C

from .conftest import WORDS, rows

LABELS = "doc_id long, quality int, toxic int"


def corpus(spark, n=400):
    rng = np.random.default_rng(4)
    texts, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        words = rng.choice(WORDS, 60)
        texts.append((i, " ".join(words if good else [w.upper() + " $$$" for w in words]), "en", "s", 0))
        labels.append((i, int(good), 0))
    return (spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long"),
            spark.createDataFrame(labels, LABELS), dict((i, q) for i, q, _ in labels))


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus(spark)
    got = C.quality(docs, labels).collect()
    aside = [r for r in got if r.held_out]
    assert {r.doc_id for r in aside} == {i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == truth[r.doc_id] for r in aside]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)


def test_held_out_labels_are_not_used(spark):
    docs, labels, truth = corpus(spark)
    turned = spark.createDataFrame([(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, 0) for i, q in truth.items()], LABELS)
    equal = rows(C.quality(docs, labels)) == rows(C.quality(docs, turned))
    assert equal


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, C.INPUTS))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (rng.random(3000) < p).astype(float)
    s = C.Network(x[:2000], y[:2000]).score(x[2000:])
    for low in (0.0, 0.3, 0.7):
        mine = (s >= low) & (s < low + 0.3)
        assert abs(s[mine].mean() - y[2000:][mine].mean()) < 0.12


def test_edges(spark, edges, clashing, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (3, None, 0), (99, 1, None)], LABELS)
    got = C.quality(edges, labels).collect()
    assert len(got) == edges.count() and all(r.score == 0.5 for r in got)
    assert all(r.held_out for r in got if r.doc_id is None)
    some = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], LABELS)
    equal = rows(C.quality(clashing, some)) == rows(C.quality(edges, some))
    assert equal
    assert C.quality(nothing, labels).count() == 0


def test_word_vectors_come_from_all_documents(spark):
    docs, labels, _ = corpus(spark, 40)
    more = [f"zeta{i} eta{i % 3} theta{i % 5} unlabelled" for i in range(30)]
    every = docs.unionAll(spark.createDataFrame([(1000 + i, t, "en", "s", 0) for i, t in enumerate(more)], docs.schema))
    vectors, _ = C.fit(every, labels)
    sums = pd.concat(C._context([every.select("text").toPandas()]))
    want = np.zeros((C.BUCKETS, C.DIM))
    want[sums["bucket"]] = np.stack(sums["vector"])
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    assert np.allclose(vectors.value, want, atol=1e-6)
    assert np.abs(vectors.value[C.buckets("unlabelled")]).sum() > 0
