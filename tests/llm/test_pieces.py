import random
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from riskstream.llm import pieces as P
from riskstream.llm.queries import vocabulary

from .conftest import LONG, edge_rows, rows

TEXTS = ["", " ", "the cat", "a  b   c\n\n日本語 ééé 😀 x", " lead", "trail ", "a\tb", "x" * 300, "▁x ▁ y", "\n", "\x00a b\x00", LONG]


@pytest.fixture(scope="module")
def codec():
    return P.Codec(vocabulary("piece_bpe_32k.model"))


def exhaustive(text, scores, unknown):
    best = None
    for cuts in product([0, 1], repeat=len(text) - 1):
        at = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
        pieces = [text[a:z] for a, z in zip(at, at[1:])]
        if all(p in scores or len(p) == 1 for p in pieces):
            score = sum(scores.get(p, unknown) for p in pieces)
            best = score if best is None else max(best, score)
    return best


def test_best_of_all_segmentations():
    rng = random.Random(5)
    for _ in range(200):
        scores = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.randint(1, 20) for _ in range(12)}
        reach = dict.fromkeys(p[:i] for p in scores for i in range(1, len(p))) | scores
        text = "".join(rng.choice("abcd") for _ in range(rng.randint(1, 9)))
        v = P.StreamingViterbi(reach, 4, -50)
        got = [*v.feed(text), *v.finish()]
        assert "".join(got) == text
        assert sum(scores.get(p, -50) for p in got) == exhaustive(text, scores, -50)


def test_streaming_equals_whole_and_keeps_a_short_window(codec):
    text = "▁" + LONG[:20_000].replace(" ", "▁")
    v = P.StreamingViterbi(codec.reach, codec.table.max_len, codec.unknown)
    rng, got, at, widest = random.Random(2), [], 0, 0
    while at < len(text):
        step = rng.randint(1, 120)
        got += v.feed(text[at:at + step])
        at, widest = at + step, max(widest, len(v.text))
    got += v.finish()
    assert [codec.ids[p] for p in got] == codec.encode(LONG[:20_000]).tolist()
    assert widest < 10 * codec.table.max_len


def test_together_equals_alone(codec):
    words = ["▁" + w for w in LONG.split()[:300]] + ["\n", "▁", "▁日本", "▁é", "z" * 30]
    assert codec.search_many(words) == [codec.search(w) for w in words]


def test_round_trip(codec):
    ids, lengths = codec.encode_many(pa.array(TEXTS))
    stops = np.concatenate([[0], np.cumsum(lengths)])
    for t, a, z in zip(TEXTS, stops, stops[1:]):
        assert ids[a:z].tolist() == codec.encode(t).tolist()
        assert codec.decode(ids[a:z].tolist()) == t


def test_operator(edges, clashing, nothing):
    path = vocabulary("piece_bpe_32k.model")
    got = P.round_trip(edges, path)
    assert got.count() == len(edge_rows()) and got.where("not exact").isEmpty()
    equal = rows(P.round_trip(clashing, path)) == rows(got)
    assert equal
    back = P.decoded(P.encoded(edges, path), path)
    equal = rows(back) == sorted(((i, t or "") for i, t, *_ in edge_rows()), key=repr)
    assert equal
    assert P.encoded(nothing, path).count() == 0


def test_checked_encoding_decodes_its_ids(monkeypatch):
    path = vocabulary("piece_bpe_32k.model")
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())})
    plain, checked = (pa.Table.from_batches(P._encoder(path, check)([batch])) for check in (False, True))
    assert checked == plain
    monkeypatch.setattr(P.Codec, "decode", lambda self, ids: "x")
    with pytest.raises(ValueError, match="do not decode"):
        list(P._encoder(path, True)([batch]))


def test_older_stretches_count_among_those_remembered(monkeypatch):
    c = P.codec(vocabulary("piece_bpe_32k.model"))
    c.forget()
    monkeypatch.setattr(P, "CACHE", 100)
    for i in range(12):
        c.encode_many(pa.array([" ".join(f"word{i}x{j}" for j in range(60))]))
        assert len(c.known) + len(c.older) <= 100 + 2 * 60
    c.forget()
