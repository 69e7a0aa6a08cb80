import re

from pyspark.sql import functions as F

from riskstream.llm import mixing

from .conftest import edge_rows, rows


def filled(sizes, weights, share, most):
    """Targets by capping the sources above and resharing until none is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, open_, out = share * sum(sizes.values()), set(names), {}
    while True:
        level = (budget - sum(out.values())) / max(1, sum(w[s] for s in open_))
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: float(most * sizes[s]) for s in over}
        open_ -= over


def test_targets_and_taken(spark):
    texts = [(i, "w " * (1 + i % 9), "en", "abc"[min(2, i % 10 // 4)], 0) for i in range(4000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long")
    got = mixing.mix(docs).withColumn("source", F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 1)).collect()
    by_id = {r[0]: r for r in texts}
    sizes = {}
    for i, t, _, s, _ in texts:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    goal, taken = filled(sizes, (3, 1, 2), 1.5, 2), dict.fromkeys(sizes, 0)
    for r in got:
        s = by_id[r.doc_id][3]
        assert r.size == len(by_id[r.doc_id][1].split()) and r.source_size == sizes[s]
        assert abs(r.target - goal[s]) < 1e-6 and r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= 9
    equal = rows(mixing.mix(docs)) == rows(mixing.mix(docs.repartition(7)))
    assert equal


def test_smaller_budgets_are_nested(make):
    docs = make(["x y z"] * 500)
    few, many = ({r.doc_id for r in mixing.mix(docs, share=s).collect() if r.taken} for s in (0.3, 0.6))
    assert few < many and 140 <= len(few) <= 160


def test_edges(edges, clashing, nothing):
    got = mixing.mix(edges).collect()
    assert len(got) == len(edge_rows())
    word = re.compile(r"[^\x20\x09-\x0D]+")
    assert sorted(r.size for r in got) == sorted(len(word.findall(t or "")) for _, t, *_ in edge_rows())
    assert all(r.taken <= 2 * r.size for r in got)
    equal = rows(mixing.mix(clashing)) == rows(mixing.mix(edges))
    assert equal
    assert mixing.mix(nothing).count() == 0 and mixing.mixed_documents(nothing).columns == nothing.columns
    copies = mixing.mixed_documents(clashing)
    assert copies.columns == clashing.columns
    assert copies.where("mix_key != 'mix_key!'").isEmpty()
