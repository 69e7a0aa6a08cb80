"""License labels against every block beside every template."""

import random
import re

import numpy as np
import pytest

from riskstream.llm import licenses
from riskstream.llm.licenses import PHRASES, TEMPLATES, block_size, blocks_of, labelled, scanned, words

from .conftest import DOCUMENTS, LONG, edge_rows, rows


def plain_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[0-9a-z\x80-\U0010ffff]+", lowered)


def brute(doc_id, text, templates=TEMPLATES, percent=80, phrases=PHRASES):
    w = plain_words(text)
    places = [(i, label) for p, label in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    found = {}
    for label, t in templates:
        t = plain_words(t)
        if not t:
            continue
        size = block_size(len(t))
        for s in range(0, max(1, len(w)), size // 2):
            n = len(set(w[s:s + size]) & set(t))
            if n * 100 >= percent * len(set(t)):
                found[label] = max(found.get(label, 0), n / len(set(t)))
    base = {x[1] for x in places}
    at = [x[0] for x in places]
    return (doc_id, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)),
            ",".join(sorted(base | set(found))), 1.0 if places else max(found.values(), default=0.0))


def mutated(rng):
    """Texts around templates: whole, with words changed, dropped or added, and with their order lost."""
    filler = "the of to a in and software any use this under license version copy work 2 0 3 prose words".split()
    out = []
    for _, t in TEMPLATES * 3:
        w = t.split()
        for _ in range(rng.randint(0, max(1, len(w) // 3))):
            i = rng.randrange(len(w))
            w[i:i + 1] = rng.choice([[], [rng.choice(filler)], [w[i], rng.choice(filler)]]) or [w[i]][:rng.randint(0, 1)]
            w = w or ["x"]
        if rng.random() < 0.3:
            rng.shuffle(w)
        around = [[rng.choice(filler) for _ in range(rng.randint(0, 90))] for _ in range(2)]
        out.append(" ".join(around[0] + w + around[1]))
    return out


@pytest.mark.parametrize("stretch", [1 << 20, 50])
def test_equals_brute_force(spark, make, monkeypatch, stretch):
    monkeypatch.setattr(licenses, "STRETCH", stretch)
    texts = mutated(random.Random(4)) + ["The MIT license. mit LICENSE", "mit", "license", "apache  license mit license\ngeneral public license"]
    assert rows(labelled(make(texts))) == sorted((brute(i, t) for i, t in enumerate(texts)), key=repr)
    templates = [("x", "a b c d e f"), ("y", "the of to the"), ("z", "--"), ("x", "a " * 40 + "b c")]
    got = rows(labelled(make(texts), templates, {}, 50))
    assert got == sorted((brute(i, t, templates, 50, {}) for i, t in enumerate(texts)), key=repr)


def test_words_do_not_follow_the_stretches(monkeypatch):
    text = "Eins, zwei! dreié X9 " * 30 + "ende"
    for stretch in (1, 2, 7, 1000):
        monkeypatch.setattr(licenses, "STRETCH", stretch)
        assert [w for part in words(text) for w in part] == plain_words(text)


def test_every_passage_lies_in_a_block():
    for n in (1, 5, 8, 9, 40):
        size = block_size(n)
        for at in range(0, 200):
            total = at + n + 13
            got = blocks_of(np.arange(at, at + n), np.arange(n), total, size, n)
            assert got and all(b["start"] <= at and at + n <= b["start"] + size for b in got)


def test_spans_are_given(spark, make):
    text = "one two three " + TEMPLATES[7][1] + " four five"
    _, matches = scanned(make([text, "nothing of the kind"]))
    [m] = [m for m in matches.collect()]
    assert (m.doc_id, m.label, m.start, m.containment) == (0, "bsd", 0, 1.0) and m.end == len(plain_words(text))


def test_edges(spark, edges, clashing, nothing):
    got = rows(labelled(edges))
    assert got == sorted((brute(r[0], r[1]) for r in edge_rows()), key=repr)
    assert rows(labelled(clashing)) == got
    assert labelled(nothing).collect() == []


def test_a_long_text_with_a_notice(spark, make):
    text = LONG + " " + TEMPLATES[1][1] + " " + LONG
    assert rows(labelled(make([text]))) == [brute(0, text)]
    assert "mit" in brute(0, text)[6]
