import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskstream.llm import quality as Q

from .conftest import LONG, WORDS, edge_rows, rows


def brute_counts(text):
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    return (len(words), sum(len(w.decode()) for w in words), sum(text.count(c) for c in "#*$%&|<>"),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


@pytest.mark.parametrize("text", ["", " \n", "a a a a", "a b c a b c d", "x\ny\nx\n\n \nx", "é # b c <|>", "a b a b a b a", LONG[:3000],
                                  "\x1c a\x85b"])
def test_counts(text):
    assert Q.counts(text) == brute_counts(text)


def plain_probability(grams, order):
    """Interpolated modified Kneser-Ney by its definition, from a Counter of tuples."""
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {k: Q.discounts(np.array(list(c.values()))) for k, c in levels.items()}

    def p(g):
        if not g:
            return 1 / Q.CLASSES
        k, c = len(g), levels[len(g)]
        after = {h: n for h, n in c.items() if h[:-1] == g[:-1]}
        total = sum(after.values())
        if not total:
            return p(g[1:])
        d = cut[k]
        back = sum(d[min(n, 3)] for n in after.values()) / total
        return max(c[g] - d[min(c[g], 3)], 0) / total + back * p(g[1:])

    return p


def test_model_is_modified_kneser_ney():
    codes, _ = Q.ngrams([" ".join(WORDS[:6]), "abc abd abe, x"])
    unpack = lambda c: tuple(int(c >> 6 * k) & 63 for k in (3, 2, 1, 0))
    grams = Counter(map(unpack, codes))
    p = plain_probability(grams, 4)
    values, n = np.unique(codes, return_counts=True)
    m = Q.Model({k: x.astype("<i4" if k[0] in "gc" else "<f4").tobytes() for k, x in Q.kneser_ney(values, n).items()})
    asked = list(grams)[:40] + [(3, 4, 5, 60), (3, 4, 50, 5), (61, 61, 61, 61), (0, 0, 0, 3)]
    got = m._prob(np.array([a << 18 | b << 12 | c << 6 | d for a, b, c, d in asked], np.int32), 4)
    assert np.allclose(got, [p(g) for g in asked], rtol=1e-5)
    ctx = next(iter(grams))[:3]
    everything = np.array([ctx[0] << 18 | ctx[1] << 12 | ctx[2] << 6 | d for d in range(64)], np.int32)
    assert abs(m._prob(everything, 4).sum() - 1) < 1e-5


def test_bands_reject_strange_texts_only(spark):
    plain = []
    for i in range(80):
        rng = np.random.default_rng(i)
        plain.append(" ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(150)))
    strange = []
    for i in range(2):
        rng = np.random.default_rng(100 + i)
        strange.append(" ".join("".join(rng.choice(list("#$%&<>|*q7Zx"), 7)) for _ in range(150)))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(plain + strange)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in Q.rules(docs).collect()}
    assert not got[80].kept and not got[81].kept and not got[80].base_failed
    assert sum(got[i].kept for i in range(80)) >= 78


def test_edges(edges, clashing, nothing, monkeypatch):
    got = Q.rules(edges)
    want = [(i, *brute_counts(t or "")) for i, t, *_ in edge_rows()]
    equal = rows(got.select("doc_id", *Q.COUNTS)) == sorted(want, key=repr)
    assert equal
    for r in got.collect():
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    equal = rows(Q.rules(clashing)) == rows(got)
    assert equal
    assert Q.rules(nothing).count() == 0
    once = rows(Q.rules(edges))
    monkeypatch.setattr(Q, "MODEL_BYTES", 1)  # a pass for each language
    assert rows(Q.rules(edges)) == once
    kept = Q.kept(clashing)
    assert kept.columns == clashing.columns
    assert kept.count() == got.where("kept").count() and kept.where(F.col("q_kept") != "q_kept!").isEmpty()


def prose(seed, words=150, letters="abcdefgh"):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(letters), 6)) for _ in range(words))


def judged(spark, pairs):
    docs = spark.createDataFrame([(i, t, lang, "s", 0) for i, (lang, t) in enumerate(pairs)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    return {r.doc_id: r for r in Q.rules(docs).collect()}


def test_copies_do_not_narrow_the_band(spark):
    plain = [prose(i, 60 + 7 * i) for i in range(60)]
    strange = prose(200, letters="#$%&<>|*q7Zx")
    got = judged(spark, [("en", t) for t in [*plain, strange]] + [("en", plain[0])] * 110)  # 60 % are one text
    assert all(got[i].kept for i in [*range(60), *range(61, 171)]) and not got[60].kept
    assert not got[60].base_failed


def test_languages_of_two_texts(spark):
    two = [("xx", prose(300, 80, "mnopqrst")), ("xx", prose(301, 900, "ijklmnop")), (None, prose(302, 80)), (None, prose(303, 600))]
    got = judged(spark, [("en", prose(i)) for i in range(60)] + two)
    assert all(got[i].kept for i in range(60, 64))
    few = judged(spark, two)  # nothing to take a band from
    assert all(r.kept for r in few.values())


def test_texts_are_counted_once(spark, edges):
    got = rows(Q.distinct_texts(edges.unionAll(edges)))
    assert got == sorted({(lang, t or "") for _, t, lang, *_ in edge_rows()}, key=repr)


def varied(seed, words):
    """Prose whose letters are more or less frequent from text to text."""
    rng = np.random.default_rng(seed)
    p = 1 + rng.random(8)
    return ["".join(rng.choice(list("abcdefgh"), 6, p=p / p.sum())) for _ in range(words)]


@pytest.mark.parametrize("share", [0.3, 0.45])
def test_garbage_in_less_than_half_of_a_text(spark, share):
    n = int(6000 * share)
    garbage = prose(401, 6000, "#$%&<>|*q7Zx").split()
    words = varied(400, 6000)
    at_end = words[n:] + garbage[:n]
    words = varied(402, 6000)
    dealt = [w for i in range(0, 6000, 300) for w in words[i:i + 300 - n // 20] + garbage[i:i + n // 20]]
    passage = varied(403, 5700) + garbage[:300]  # a twentieth stays
    got = judged(spark, [("en", " ".join(t)) for t in [*(varied(i, 2000) for i in range(60)), at_end, dealt, passage, varied(404, 6000)]])
    assert not got[60].kept and not got[61].kept and got[62].kept and got[63].kept
    assert not got[60].base_failed and not got[61].base_failed
    assert sum(got[i].kept for i in range(60)) >= 58


def test_symbols_tell_all_code_points_apart():
    text = "aA\u0000é中\U0001F600b"
    for most in (Q.MOST_BITS, 3):
        a = Q.Alphabet(Q.Alphabet.points_of(text))
        if most == 3:  # as with more code points than symbols
            a.bits, a.singles = Q.MOST_BITS, 4
        seen = {tuple(a.symbols(c).tolist()) for c in text}
        assert len(seen) == len(text) and all(0 < x < 1 << a.bits for s in seen for x in s)
        assert a.symbols(text).tolist() == [x for c in text for x in a.symbols(c).tolist()]


def test_n_grams_are_counted_with_their_texts():
    texts = ["abcabc", "abcd", "", "xabc"]
    alphabet = Q.Alphabet(Q.Alphabet.points_of("".join(texts)))
    codes, lengths = Q.ngrams(texts, alphabet)
    by_text = [set(x.tolist()) for x in np.split(codes, np.cumsum(lengths)[:-1])]
    want = {g: (n, sum(g in t for t in by_text)) for g, n in Counter(codes.tolist()).items()}
    for bits in (4 * alphabet.bits, 63):
        got = {g: (n, t) for g, n, t in zip(*(x.tolist() for x in Q._counted(codes, lengths, bits)))}
        assert got == want


def test_other_characters_of_the_same_kind_are_strange(spark):
    """Random capitals for capitals, digits for digits and letters of another script for one another."""
    def text(seed, capitals, digits, letters):
        rng = np.random.default_rng(seed)
        pick = lambda chars, n: "".join(rng.choice(list(chars), n))
        return " ".join(pick(capitals, 3) + pick(letters, 3) + pick(digits, 2) for _ in range(200))

    plain = [text(i, "ABCD", "123", "абвг") for i in range(60)]
    odd = [text(100, "QXYZ", "123", "абвг"), text(101, "ABCD", "789", "абвг"), text(102, "ABCD", "123", "фъщы")]
    got = judged(spark, [("ru", t) for t in plain + odd])
    assert not any(got[i].kept or got[i].base_failed for i in (60, 61, 62)) and sum(got[i].kept for i in range(60)) >= 58


def test_parts_and_rounds_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 30 + i), lang, "s", 0) for i in range(40) for lang in ("en", None)],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    once = sorted(map(tuple, Q.rules(docs).drop("log_ppl").collect()))
    ppl = [r.log_ppl for r in Q.rules(docs).orderBy("doc_id", "log_ppl").collect()]
    monkeypatch.setattr(Q, "PART_GRAMS", 1000)
    monkeypatch.setattr(Q, "MODEL_BYTES", 30_000)
    parts = Q.model(docs, Q.alphabets(docs))
    assert any(len(rounds) > 1 for _, rounds in Q._passes(parts))
    assert sorted(map(tuple, Q.rules(docs).drop("log_ppl").collect())) == once
    assert np.allclose([r.log_ppl for r in Q.rules(docs).orderBy("doc_id", "log_ppl").collect()], ppl, rtol=1e-6)


def test_a_task_that_counts_has_one_python_step(edges):
    twice = edges.unionAll(edges)
    schema = "lang string, code long, n long, texts long"
    letters = edges.sparkSession.sparkContext.broadcast(Q.alphabets(twice))
    out = Q.distinct_texts(twice, Q._counter(letters), schema)
    tree = out._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in tree and not re.search(r"MapIn[^\n]*\n[^\n]*MapIn", tree)
    got = out.groupBy("lang", "code").sum("n", "texts").collect()
    want = {}
    for lang, text in {(r.lang, r.text or "") for r in edges.collect()}:
        codes, _ = Q.ngrams([text], letters.value.get(lang) or Q.Alphabet(np.zeros(0)))
        for c, n in zip(*(x.tolist() for x in np.unique(codes, return_counts=True))):
            n0, t0 = want.get((lang, c), (0, 0))
            want[lang, c] = n0 + n, t0 + 1
    assert {(r[0], r[1]): (r[2], r[3]) for r in got} == want and len(got) == len(want)
