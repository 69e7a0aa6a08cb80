import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from riskstream.llm import partenum as E
from riskstream.llm.components import components

from .conftest import edge_rows, rows

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(texts):
    """Component of each text, as its smallest number."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, share):
    words = list(words)
    for _ in range(int(len(words) * share)):
        kind, at = rng.randrange(3), rng.randrange(len(words))
        if kind == 0:
            words[at] = f"new{rng.randrange(10 ** 6)}"
        elif kind == 1:
            words.insert(at, f"in{rng.randrange(10 ** 6)}")
        elif len(words) > 1:
            del words[at]
    return words


def corpus(seed, groups=25, passage=0):
    """Groups of copies and edits of every degree around the threshold, and passages that many texts share."""
    rng, out = random.Random(seed), []
    shared = [f"p{i}" for i in range(passage)]
    for g in range(groups):
        base = [f"g{g}w{i}" for i in range(rng.choice([1, 3, 5, 6, 9, 14, 30, 80, 200]))] + shared
        out.append(base)
        for _ in range(rng.randrange(6)):
            out.append(edited(rng, rng.choice(out[-3:]), rng.choice([0, 0.01, 0.02, 0.03, 0.05])))
    rng.shuffle(out)
    return [" ".join(w) for w in out]


@pytest.mark.parametrize("seed,passage,group", [(1, 0, 32), (2, 40, 32), (3, 60, 3), (4, 0, 2)])
def test_all_links_are_found(spark, make, monkeypatch, seed, passage, group):
    monkeypatch.setattr(E, "GROUP", group)  # small groups send sets through all levels
    texts = corpus(seed, passage=passage)
    got = {r.doc_id: r for r in E.classes(make(texts)).collect()}
    want = brute(texts)
    assert [got[i].component_id for i in range(len(texts))] == want
    assert [got[i].n_shingles for i in range(len(texts))] == [len(shingles(t)) for t in texts]


def test_similar_sets_agree_in_enough_partitions():
    rng = np.random.default_rng(8)
    for size in (1, 2, 4, 5, 8, 13, 40, 160, 700):
        for _ in range(30):
            a = np.unique(rng.integers(1, 2 ** 63, size).astype(np.uint64))
            drop = rng.integers(0, size // 9 + 1)
            b = np.unique(np.concatenate([a[drop:], rng.integers(1, 2 ** 63, rng.integers(0, size // 9 + 1)).astype(np.uint64)]))
            if not len(b) or 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
                continue
            sa, _, ma = E.signatures(E.Sets(a, np.array([len(a)])), np.array([1]), 0, 80, a[:0], False)
            sb, _, _ = E.signatures(E.Sets(b, np.array([len(b)])), np.array([2]), 0, 80, a[:0], False)
            slack = {m // 256: m % 256 - 1 for m in ma if m >= 0}
            agreed = [m // 256 for s, m in zip(sa, ma) if m >= 0 and s in sb]
            stuck = -1 in ma
            assert stuck or any(agreed.count(t) > slack[t] for t in slack)


def test_sets_of_texts():
    texts = ["", "a", " A  b\n", "a b c d e", "A B C D E f", "\x1c x\xa0y z", "é ü ß", "one", "ONE", "", "a b c d e f g a b c d e"]
    found = E.shingle_sets(pa.array(texts))
    assert found.sizes.tolist() == [len(shingles(t)) for t in texts]
    ids = found.ids().tolist()
    assert [[x == y for y in ids] for x in ids] == [[shingles(t) == shingles(u) for u in texts] for t in texts]
    assert (E.shingle_sets(pa.array(texts).slice(2, 6)).ids() == found.ids()[2:8]).all()


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5), (None, 1)]
    got = {r.node: r.label for r in components(spark.createDataFrame(path, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(50))
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_edges(spark, edges, clashing, nothing):
    got = rows(E.classes(edges))
    assert len(got) == len(edge_rows())
    assert {(1, 1), (2, 1), (8, 8), (9, 8), (3, 3), (4, 4), (5, 5), (7, 7), (10, 1), (2, 2)} >= {(r[0], r[2]) for r in got if r[0] in (1, 3, 4, 5, 7, 8, 9, 10)}
    equal = rows(E.classes(clashing)) == got
    assert equal
    assert E.classes(nothing).count() == 0 and E.representatives(nothing).columns == nothing.columns


def test_one_of_each_group_stays(clashing, make):
    kept = E.representatives(clashing)
    assert kept.columns == clashing.columns and kept.where("text_key != 'text_key!'").isEmpty()
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    plain = edge_rows()[0][1]
    assert texts.count((1, plain)) == 1 and (2, plain) not in texts and (2, "another text of the same id") in texts
    assert (3, None) in texts and (4, "") in texts and (None, None) in texts and (None, plain) not in texts
    docs = corpus(7)
    assert sorted(r.doc_id for r in E.representatives(make(docs)).collect()) == sorted(set(brute(docs)))


def test_word_hashes_hold_few_bytes_for_a_byte_of_text():
    rng = random.Random(5)
    texts = ["".join(rng.choice("abC \n") for _ in range(n)) for n in (3 * E.RUN, 0, E.RUN - 1, 1, E.RUN, 7 * E.RUN)]
    got, lengths = E.word_hashes(pa.array(texts))
    assert lengths.tolist() == [len(t.split()) for t in texts]
    base = E._BASE
    want = [sum((b + 1) * pow(base, i, 1 << 64) for i, b in enumerate(w.encode().lower())) % (1 << 64)
            for t in texts for w in t.split()]
    assert (got == E.mixed(np.array(want, np.uint64))).all()
    big = pa.array(["word text " * 100_000])
    tracemalloc.start()
    E.word_hashes(big)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * big.nbytes


def test_frequent_items_of_a_window_in_place():
    rng = np.random.default_rng(6)
    held = [rng.integers(0, 50_000, 100_000).astype(np.uint64) for _ in range(4)]
    values, times = np.unique(np.concatenate(held), return_counts=True)
    size = sum(x.nbytes for x in held)
    tracemalloc.start()
    got = E.frequent_items(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    often = times >= E.FREQUENT
    assert (got[0] == values[often]).all() and (got[1] == times[often]).all() and held == []
    assert peak < 2 * size
    for n in (0, E.FREQUENT - 1, E.FREQUENT):
        assert len(E.frequent_items([np.zeros(n, np.uint64)])[0]) == (n == E.FREQUENT)
