"""Tries of conversations against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from riskstream.llm import prefix_trie
from riskstream.llm.prefix_trie import Tree, encoded, medians, path_keys, shard, spliced, trie

TURNS = "conv_id long, turn long, role string, text string"


def key(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def sequences(turns):
    out = {}
    for c, n, role, text in turns:
        if c is not None:
            out.setdefault(c, []).append((n is not None, n or 0, key(role or "", text or ""), (role or "", text or "")))
    return {c: [x[3] for x in sorted(v, key=lambda x: x[:3])] for c, v in out.items()}


def brute(convs):
    nodes = {}
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for p, members in nodes.items():
        below = [(q, m) for q, m in nodes.items() if q[:len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q, _ in below)
        leaves = sum(not any(len(r) == len(q) + 1 and r[:len(q)] == q for r, _ in below) for q, _ in below)
        saved = sum((len(m) - 1) * len(q[-1][1]) for q, m in below if q)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(p))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children, leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def rebuilt(convs):
    out = {}
    for c, seq in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + seq[h:]
    return out


def found(spark, turns, splice=False):
    convs = encoded(spark.createDataFrame(turns, TURNS))
    if splice:
        head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
        convs = spliced(convs, F.col("conv_id") - F.col("conv_id") % 100, head, 5)
    return sorted((tuple(r) for r in trie(convs).collect()), key=repr)


def random_turns(seed, n, depth=6, kinds=3):
    rng = random.Random(seed)
    return [(c, d, rng.choice(["user", "bot"]), "x" * rng.randint(0, kinds)) for c in range(n) for d in range(rng.randint(1, depth))]


@pytest.mark.parametrize("size", [(1, 1, 3), (20, 4, 8), (100_000, 64, 4096)])
def test_equals_brute_force(spark, monkeypatch, size):
    for name, value in zip(("SHARD_IDS", "SHARD_ROWS", "FEW"), (size[0], max(4, size[1]), size[2])):
        monkeypatch.setattr(prefix_trie, name, value)
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    turns = random_turns(1, 260)
    assert found(spark, turns) == brute(sequences(turns))
    assert found(spark, turns, True) == brute(rebuilt(sequences(turns)))


def test_one_conversation_many_times_and_turnless_ones(spark):
    turns = [(c, d, "user", f"t{d}") for c in range(300) for d in range(3)] + [(1000 + c, 0, "bot", "only") for c in range(120)]
    convs = sequences(turns)
    assert found(spark, turns) == brute(convs)
    got = found(spark, turns, True)
    assert got == brute(rebuilt(convs)) and any(d == 0 and n == len(convs) for _, d, _, n, *_ in got)


def test_edges(spark):
    long = "w " * 20_000
    turns = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "", "user"), (2, 3, "user", long), (2, 3, "user", long),
             (2, -1, "user", "é\U0001f600"), (None, 1, "user", "lost"), (-5, 0, "user", "a"), (-5, 1, None, "b"), (7, 1, "1:u", "x"),
             (8, 1, "1", ":ux")]
    assert found(spark, turns) == brute(sequences(turns))
    assert found(spark, turns, True) == brute({c: sequences(turns).get(int(c - (abs(c) % 100) * (1 if c > 0 else -1)), [])[
        :zlib.crc32(str(c).encode()) % 6] + s[zlib.crc32(str(c).encode()) % 6:] for c, s in sequences(turns).items()})
    assert found(spark, []) == []


def test_other_columns_change_nothing(spark):
    turns = random_turns(5, 30)
    wide = spark.createDataFrame([(*t, "a", "b", "c") for t in turns], TURNS + ", id string, seq string, chars string")
    assert sorted((tuple(r) for r in trie(encoded(wide)).collect()), key=repr) == brute(sequences(turns))


def test_a_deep_conversation(spark):
    turns = [(c, d, "user", "same") for c in (1, 2) for d in range(3000)] + [(3, d, "user", "same") for d in range(1500)]
    got = found(spark, turns)
    assert len(got) == 3001 and {r[5] for r in got} == {1}
    assert max(r[6] for r in got) == 4 * (2 * 1500 + 1500)


def test_median_insertion_is_balanced():
    n = 1000
    assert sorted(medians(n)) == list(range(n))
    tree = Tree()
    for i in medians(n):
        tree.insert([i], [1])

    def depth(at):
        best, stack = 0, [(at, 1)]
        while stack:
            x, d = stack.pop()
            if x:
                best = max(best, d)
                stack += [(tree.low[x], d + 1), (tree.high[x], d + 1)]
        return best

    assert depth(tree.down[0]) == 10


def test_a_shard_keeps_its_border_open():
    rows = [([1, 2], [1, 1], [(2, 1, 10, 0, 0, 0, "a")]), ([1, 3], [1, 1], [(2, 1, 11, 0, 0, 0, "b")]),
            ([1, 4], [1, 1], [(2, 1, 12, 0, 0, 0, "c")])]
    done, paths = shard(rows, True, False)
    assert [(r[0], r[1], r[2]) for r in done] == [(11, 2, None)] and done[0][-1] == path_keys([1])[1]
    assert [p[0] for p in paths] == [[1, 2], [1, 4]]
    assert {m[0] for m in paths[0][2]} == {1, 2} and {m[0] for m in paths[1][2]} == {2}
