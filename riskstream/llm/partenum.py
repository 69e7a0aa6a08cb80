"""Similarity join of word-shingle sets by PartEnum signatures, and its connected components.

Two sets whose Jaccard similarity is at least ``percent`` differ in at most (a + b) * (100 - p) / (100 + p) elements, and
the larger is at most 100 / p times the smaller. Sizes are cut into bands of that ratio, so similar sets lie in one band or
in neighbours, and each pair of neighbours (an instance) has a bound ``k`` on the difference. An instance deals the shingle
domain into ``k + 1 + slack`` partitions by hash; a signature is what a set holds in one partition. Similar sets agree in
at least ``1 + slack`` partitions, so they share a signature even after up to ``slack`` of a set's signatures are set aside:
those of empty partitions, and those that very many different sets share. To keep the latter few, shingles that are
frequent within a task's input are left out of the first level's partitions.

A set for which more than ``slack`` signatures would have to go is taken to the next level, together with all other such
sets, where the domain is dealt by another hash and no shingle is left out. There large groups are not set aside: groups
with common members are one family, whose members are compared block by block. The last level takes the few sets that
have too many empty partitions, and uses those as signatures too. No case is dropped at any level.

Only components are asked for, so a signature group is not expanded into pairs: first each member is compared with one
member, the one that shares most signatures; the links found are contracted, and only members still in different
components are compared after that. Every comparison is exact, on the sets of 64-bit shingle hashes.

Copies: texts with equal sets are one set throughout. Defined results: null and empty texts and those without words have
no shingles and link with nothing; with fewer words than a shingle the whole sequence is one; rows with equal ids or null
ids take part like any others, and a component of null ids only has a null id; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import given_back, materialize, packed, ship_package, table, unpacked
from riskstream.session import discard
from riskstream.llm.components import components

SHINGLE = 5
PERCENT = 80
#: A shingle is frequent if this many documents among about WINDOW shingles of one task have it.
FREQUENT, WINDOW = 8, 1 << 21
FREQUENT_MAX = 1 << 20  # entries of the list; what is beyond it only costs time
#: Sets in a group that are compared pair by pair; larger groups are set aside at the first level, families after it.
GROUP = 32
BLOCK, COLUMNS = 1024, 4096
BITS = 512  # of a set's bitmap
LEVELS = 3
#: The first level's signatures are dealt in this many rounds, by remainder, so that the disks hold the shuffle of one.
ROUNDS = 3
#: Of the filter that tells which rows' texts may be needed as sets: more of them than this cost time, nothing else.
WANTED_BITS = 1 << 26

_U = np.uint64
_MULT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F],
                 _U)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.ones(1, _U)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * _U(step)])
        step = step * step & (2 ** 64 - 1)
    return out[:n]


_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at once; the powers of later ones are these times the power of the first.
RUN = 1 << 16
_POWERS, _INVERSES = _powers(_BASE, RUN), _powers(_inverse(_BASE), RUN)
_LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_WORD = np.array([i not in b"\x20\x09\x0a\x0b\x0c\x0d" for i in range(256)])


class Sets:
    """The distinct shingle hashes of some texts: ``items``, sorted within each text, and how many each has."""

    def __init__(self, items: np.ndarray, sizes: np.ndarray):
        self.items, self.sizes = items, sizes
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the items' values by text, modulo 2^64."""
        c = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
        return c[self.stops] - c[self.starts]

    def ids(self) -> np.ndarray:
        """A 64-bit hash of each set."""
        return mixed(self.sums(mixed(self.items ^ _MULT[1])) ^ self.sizes.astype(_U)).astype(np.int64)

    def take(self, which: np.ndarray) -> Sets:
        keep = np.repeat(which, self.sizes)
        return Sets(self.items[keep], self.sizes[which])

    def bits(self) -> pa.Array:
        """A bitmap of each set as 64-bit integers, in which each element turns one bit over: two bitmaps differ in no more
        bits than the sets differ in elements."""
        owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        at = (mixed(self.items ^ _MULT[2]) % _U(BITS)).astype(np.int64) + owner * BITS
        odd = (np.bincount(at, minlength=len(self.sizes) * BITS) & 1).astype(np.uint8)
        words = np.packbits(odd).view(np.int64)
        return pa.FixedSizeListArray.from_arrays(pa.array(words), BITS // 64).cast(pa.list_(pa.int64()))

    def lists(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], self.stops]).astype(np.int32)),
                                        pa.array(self.items.astype(np.int64)))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts one after the other, and how many words each has.

    A word's hash is the polynomial of its bytes, A-Z lowered, from running sums over all bytes of the texts, of which RUN are
    held at once: whole, they and the powers would take some 40 bytes for each byte of text."""
    texts = pa.concat_arrays([texts]).cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    inside = np.zeros(len(data) + 2, bool)  # a place before and one after the bytes
    inside[1:-1] = _WORD[data]
    first = inside[1:-1] & ~inside[:-2]
    last = inside[1:-1] & ~inside[2:]
    edge = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a word ends with its text
    first[edge] |= inside[1:-1][edge]
    last[edge - 1] |= inside[1:-1][edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes, before = np.zeros(len(starts), _U), np.zeros(1, _U)
    for a in range(0, len(data), RUN):
        z = min(a + RUN, len(data))
        sums = np.concatenate([before, (_LOWER[data[a:z]] + _U(1)) * (_POWERS[:z - a] * _U(pow(_BASE, a, 1 << 64)))])
        np.cumsum(sums, out=sums)
        i, j = np.searchsorted(starts, (a, z))  # words that begin here
        hashes[i:j] -= sums[starts[i:j] - a]
        i, j = np.searchsorted(stops, (a, z), "right")  # and that end here
        hashes[i:j] += sums[stops[i:j] - a]
        before = sums[-1:]
    blocks = np.array([pow(_inverse(_BASE), a, 1 << 64) for a in range(0, len(data) + 1, RUN)], _U)
    hashes *= _INVERSES[starts % RUN] * blocks[starts // RUN]
    return mixed(hashes), np.diff(np.searchsorted(starts, offsets))


def shingle_sets(texts: pa.Array) -> Sets:
    """The sets of the texts; a text of fewer words than a shingle is one shingle."""
    flat, lengths = word_hashes(texts)
    stops = np.cumsum(lengths)
    counts = np.where(lengths >= SHINGLE, lengths - SHINGLE + 1, np.minimum(lengths, 1))
    n = max(0, len(flat) - SHINGLE + 1)
    runs = mixed(sum((flat[j:j + n] * _MULT[j] for j in range(SHINGLE)), np.zeros(n, _U)))
    starts = stops - lengths
    ends = np.cumsum(counts)
    at = np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)
    short = np.repeat((lengths > 0) & (lengths < SHINGLE), counts)
    items = np.zeros(len(at), _U)
    items[~short] = runs[at[~short]]
    items[short] = [mixed((w * _MULT[:len(w)]).sum(keepdims=True, dtype=_U) + _U(len(w)))[0]
                    for w in (flat[a:z] for a, z in zip(starts, stops) if 0 < z - a < SHINGLE)]
    for a, z in zip(ends - counts, ends):
        items[a:z].sort()
    new = np.ones(len(items), bool)
    new[1:] = items[1:] != items[:-1]
    new[(ends - counts)[counts > 0]] = True
    sizes = np.zeros(len(counts), np.int64)
    if len(items):
        c = np.concatenate([[0], np.cumsum(new)])
        sizes = c[ends] - c[ends - counts]
    return Sets(items[new], sizes)


SLICE_BYTES = 1 << 20  # of texts handled at once, about


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    size = max(1, b.num_rows * SLICE_BYTES // (b.nbytes + 1))
    for i in range(0, b.num_rows, size):
        yield b.slice(i, size)


def frequent_items(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The items that occur at least FREQUENT times in the arrays ``held``, which is emptied, and how often each does."""
    x = np.concatenate(held)
    held.clear()
    x.sort()
    n = max(0, len(x) - FREQUENT + 1)
    values = np.unique(x[:n][x[:n] == x[len(x) - n:]])
    return values, np.searchsorted(x, values, "right") - np.searchsorted(x, values)


READ = "row_key long, text_key long, doc_id long, n long, set long, shingle long, times long"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document, and rows for the frequent shingles of each window."""
    held, size = [], 0

    def frequent():
        values, times = frequent_items(held)
        return rows(shingle=values.astype(np.int64), times=times)

    def rows(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_pydict({c.split()[0]: pa.array(columns[c.split()[0]], pa.int64())
                                           if c.split()[0] in columns else pa.nulls(n, pa.int64())
                                           for c in READ.split(", ")})

    for batch in batches:
        for b in _slices(batch):
            sets = shingle_sets(b.column("text"))
            yield rows(row_key=b.column("row_key"), text_key=b.column("text_key"), doc_id=b.column("doc_id"),
                       n=sets.sizes, set=sets.ids())
            held.append(sets.items)
            size += len(sets.items)
            if size >= WINDOW:
                yield frequent()
                size = 0
    if held:
        yield frequent()


def bands(size: int, percent: int) -> tuple[int, int, int]:
    """Number, first size and first size of the next of the band that ``size`` lies in."""
    t, low = 0, 1
    while True:
        after = low * 100 // percent + 1
        if size < after:
            return t, low, after
        t, low = t + 1, after


def instances(size: int, percent: int) -> list[tuple[int, int, int]]:
    """(instance, partitions, slack) in which a set of ``size`` takes part: that of its band, and as a larger partner that
    of the band below."""
    t, low, after = bands(size, percent)
    out = [(t, after - 1)]
    if t and size * percent <= (low - 1) * 100:
        out.append((t - 1, low - 1))
    sized = []
    for number, largest in out:
        k = (largest + largest * 100 // percent) * (100 - percent) // (100 + percent)
        slack = 3 + -(-7 * k // 100) if k else 0
        sized.append((number, k + 1 + slack, slack))
    return sized


def signatures(sets: Sets, ids: np.ndarray, level: int, percent: int, frequent: np.ndarray, last: bool):
    """(signature, set, meta) rows of non-empty sets as arrays; meta is the instance * 256 plus the signatures that may
    still be set aside plus 1. A set that has more empty partitions than slack gets one more signature of its own, with
    meta -1."""
    plan = [(i, *x) for i, n in enumerate(sets.sizes.tolist()) for x in instances(n, percent)]
    which, number, parts, slack = (np.array(x, np.int64) for x in zip(*plan))
    whole = sets
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, sets.items), len(frequent) - 1)
        rare = frequent[at] != sets.items
        c = np.concatenate([[0], np.cumsum(rare)])
        whole = Sets(sets.items[rare], c[sets.stops] - c[sets.starts])
    salt = number.astype(_U) * _U(0x9E3779B97F4A7C15) + _U((level + 1) * 0xC2B2AE3D27D4EB4F & (2 ** 64 - 1))
    base = np.cumsum(parts) - parts  # of each instance's cells among all
    sizes = whole.sizes[which]
    at = np.repeat(whole.starts[which] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    h = mixed(whole.items[at] ^ np.repeat(salt, sizes))
    cell = ((h >> _U(32)) * np.repeat(parts, sizes).astype(_U) >> _U(32)).astype(np.int64) + np.repeat(base, sizes)
    h, cells = mixed(h), int(parts.sum())
    held = np.bincount(cell, minlength=cells)
    low = np.bincount(cell, (h & _U(0xFFFFFFFF)).astype(float), cells)  # exact: below 2^53
    high = np.bincount(cell, (h >> _U(32)).astype(float), cells)
    place = np.arange(cells) - np.repeat(base, parts)
    sig = mixed(low.astype(_U) + (high.astype(_U) << _U(32)) + mixed(place.astype(_U) + np.repeat(salt, parts)))
    empty = held == 0
    left = slack - np.add.reduceat(empty, base, dtype=np.int64)
    meta = np.repeat(number * 256 + np.clip(left, -1, 200) + 1, parts)
    owner = np.repeat(ids[which], parts)
    if last:
        return sig, owner, meta
    stuck = np.unique(ids[which][left < 0])
    return (np.concatenate([sig[~empty], mixed(stuck.astype(_U) ^ _MULT[4])]), np.concatenate([owner[~empty], stuck]),
            np.concatenate([meta[~empty], np.full(len(stuck), -1)]))


SIGNED = "sig long, set long, meta int"


def _signed(sets: Sets, ids: np.ndarray, level, percent, frequent, last) -> pa.RecordBatch:
    some = sets.sizes > 0
    if not some.any():
        return pa.RecordBatch.from_pydict({"sig": pa.array([], pa.int64()), "set": pa.array([], pa.int64()),
                                           "meta": pa.array([], pa.int32())})
    sig, me, meta = signatures(sets.take(some), ids[some], level, percent, frequent, last)
    return pa.RecordBatch.from_pydict({"sig": sig.astype(np.int64), "set": me, "meta": meta.astype(np.int32)})


def _sign_texts(frequent, percent, number=0, rounds=1):
    """The signatures whose remainder by ``rounds`` is ``number``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()  # copies within the task's input
        for batch in batches:
            for b in _slices(batch):
                sets = shingle_sets(b.column("text"))
                ids = sets.ids()
                new = np.zeros(len(ids), bool)
                for i, me in enumerate(ids.tolist()):
                    if me not in seen:
                        seen.add(me)
                        new[i] = True
                out = _signed(sets.take(new), ids[new], 0, percent, frequent.value, False)
                yield out.filter(pa.array(out.column("sig").to_numpy() % rounds == number)) if rounds > 1 else out

    return sign


def _sign_sets(level, percent, last):
    none = np.zeros(0, _U)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _slices(batch):
                lists = b.column("items")
                sets = Sets(lists.flatten().to_numpy().astype(_U), lists.value_lengths().to_numpy().astype(np.int64))
                yield _signed(sets, b.column("set").to_numpy(), level, percent, none, last)

    return sign


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by signature and set those whose signature another set has, once each, and those with meta -1."""
    names = [c.split()[0] for c in SIGNED.split(", ")]
    carry, given = None, False  # the last row so far, and whether it was given out
    for b in batches:
        cols = [b.column(c).to_numpy() for c in names]
        if carry is not None:
            cols = [np.concatenate([x, y]) for x, y in zip(carry, cols)]
        sig, me, meta = cols
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (me[1:] != me[:-1])
        had = given
        sig, me, meta = sig[new], me[new], meta[new]
        same = np.zeros(len(sig) + 1, bool)
        same[1:-1] = sig[1:] == sig[:-1]
        out = same[1:] | same[:-1] | (meta < 0)
        given = bool(out[-1]) or (had and len(sig) == 1)
        if had:
            out[0] = False
        carry = [x[-1:] for x in (sig, me, meta)]
        if out.any():
            yield pa.RecordBatch.from_pydict(dict(zip(names, (sig[out], me[out], meta[out]))))


def _shared_rows(signed: DataFrame, name: str) -> DataFrame:
    return table(signed.repartition("sig").sortWithinPartitions("sig", "set").mapInArrow(given_back(_shared), SIGNED), name)


ITEMS = "set long, times long, items array<long>, bits array<long>"


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = set()  # sets that more than one row has, of this task
    for batch in batches:
        for b in _slices(batch):
            sets = shingle_sets(b.column("text"))
            own = sets.ids() == b.column("set").to_numpy()
            for i in np.flatnonzero(own & (b.column("times").to_numpy() > 1)).tolist():
                me = b.column("set")[i].as_py()
                own[i] = me not in seen
                seen.add(me)
            mine = sets.take(own)
            yield pa.RecordBatch.from_arrays([*(b.column(c).filter(pa.array(own)) for c in ("set", "times")),
                                              mine.lists(), mine.bits()], names=["set", "times", "items", "bits"])


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The similar ones of ``pairs`` (a, b), as a table.

    Sizes and bitmaps rule most pairs out before whole sets are brought together: similar sets differ in at most
    (n + m) * (100 - p) / (100 + p) elements, and their bitmaps in no more bits."""
    light = sets.select("set", F.size("items").alias("n"), "bits")
    x = light.select(F.col("set").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = light.select(F.col("set").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    apart = " + ".join(f"bit_count(xa[{i}] ^ xb[{i}])" for i in range(BITS // 64))
    near = pairs.join(x, "a").join(y, "b").where(
        (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
        & (F.expr(apart) * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)))
    near = materialize(near.select("a", "b"), f"{name}-near")
    x = sets.select(F.col("set").alias("a"), F.col("items").alias("x"))
    y = sets.select(F.col("set").alias("b"), F.col("items").alias("y"))
    both = near.join(x, "a").join(y, "b").select(
        "a", "b", (F.size("x") + F.size("y")).alias("n"), F.size(F.array_intersect("x", "y")).alias("i"))
    out = materialize(both.where(100 * F.col("i") >= percent * (F.col("n") - F.col("i"))).select("a", "b"), name)
    discard(near)
    return out


def _candidates(rows: DataFrame, sets: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Links (a, b) among the sets that share signatures, the sets that the next level has to look at again, and the tables
    to delete when both are written."""
    groups = rows.where("meta >= 0")
    sizes = groups.groupBy("sig").agg(F.count("*").alias("m"))
    degree = groups.join(sizes, "sig").groupBy("set").agg(F.sum("m").alias("degree"))
    hubs = groups.join(degree, "set").groupBy("sig").agg(F.max(F.struct("degree", "set")).alias("top"))
    star = materialize(groups.join(hubs, "sig").where("set != top.set").select(
        F.least("set", "top.set").alias("a"), F.greatest("set", "top.set").alias("b")).distinct(), "pe-star")
    links = _verified(star, sets, percent, "pe-star-ok")
    label = components(links, "a", "b")
    placed = groups.join(label, groups["set"] == label["node"], "left").select(
        "sig", "set", "meta", F.coalesce("label", "set").alias("comp"))
    open_groups = (placed.groupBy("sig").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                   .where("lo != hi").select("sig", "m"))
    rest = materialize(placed.join(open_groups, "sig"), "pe-open")
    near = rest.where(F.col("m") <= GROUP)
    u, v = (near.select("sig", F.col("set").alias(s), F.col("comp").alias(f"c{s}")) for s in "ab")
    cross = (u.join(v, "sig").where("a < b and ca != cb").select("a", "b").distinct()
             .join(star, ["a", "b"], "left_anti"))
    crossed = _verified(cross, sets, percent, "pe-cross-ok")
    discard(star)
    used = [links, crossed, label, rest]
    links = links.unionByName(crossed)
    stuck, large = rows.where("meta < 0").select("set"), rest.where(F.col("m") > GROUP)
    if level:
        joined = _families(large, sets, percent)
        if joined is not None:
            links = links.unionByName(joined)
            used.append(joined)
    else:
        over = (large.groupBy("set", F.expr("meta DIV 256").alias("instance"))
                .agg(F.count("*").alias("aside"), F.min(F.col("meta") % 256 - 1).alias("room")))
        stuck = stuck.unionByName(over.where("aside > room").select("set"))
    return links, stuck.distinct(), used


def _block_links(percent: int):
    """Compare the members of block i with those of block j of a family, by a product of their membership matrices, and
    give a link for each two components that it joins."""

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        i, j = group["i"].iloc[0], group["j"].iloc[0]
        group = group.sort_values("set")
        x, y = group[group["block"] == i], group[group["block"] == j]
        items = [np.asarray(s, np.int64) for s in (x["items"] if i == j else chain(x["items"], y["items"]))]
        values, at, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1  # columns of items that more than one member has
        owner = np.repeat(np.arange(len(items)), [len(s) for s in items])[times[at] > 1]
        column = shared[at[times[at] > 1]]
        common = np.zeros((len(x), len(y)), np.float32)
        for first in range(0, int((times > 1).sum()), COLUMNS):
            here = (column >= first) & (column < first + COLUMNS)
            m = np.zeros((len(items), COLUMNS), np.float32)
            m[owner[here], column[here] - first] = 1
            common += m[:len(x)] @ (m if i == j else m[len(x):]).T
        size = np.array([len(s) for s in items])
        union = size[:len(x), None] + (size if i == j else size[len(x):])[None, :] - common
        a, b = np.nonzero(100 * common >= percent * union)
        found = pd.DataFrame({"a": x["set"].to_numpy()[a], "b": y["set"].to_numpy()[b],
                              "ca": x["comp"].to_numpy()[a], "cb": y["comp"].to_numpy()[b]})
        return found[found["ca"] != found["cb"]].drop_duplicates(["ca", "cb"])[["a", "b"]]

    return compare


def _families(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between components among sets that share signatures of large groups, None without such. Groups that have members in common
    are one family, so that two sets are compared once however many groups they share; a family is cut into blocks of
    about ``BLOCK`` sets, and each two blocks are one task's work."""
    if large.isEmpty():
        return None
    family = components(large, "set", "sig")
    member = (large.select("set", "comp").distinct().join(family, F.col("set") == F.col("node"))
              .select("set", "comp", F.col("label").alias("family")))
    sized = member.groupBy("family").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    member = (member.join(sized, "family").withColumn("block", F.pmod(F.xxhash64("set"), "blocks").cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    member = member.select("family", "set", "comp", "block", F.least("block", "other").alias("i"),
                           F.greatest("block", "other").alias("j"))
    out = materialize(member.join(sets.select("set", "items"), "set").groupBy("family", "i", "j")
                      .applyInPandas(_block_links(percent), "a long, b long"), "pe-family-links")
    discard(family)
    return out


def _wanted_sets(d: DataFrame, own: DataFrame, rows: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(set, items, bits) of each set that shares a signature, and the tables it is read from. Texts that have none stay where
    they are; a table of bits tells nearly all of them.

    Of the rows that have a set, those with the smallest key are read. Mostly that is one row; only sets of rows that repeat
    their key, which a task gives once, are brought together by a shuffle."""
    keys = own.join(rows.select("set").distinct(), "set").groupBy("set", "row_key").agg(F.count("*").alias("times"))
    wanted = materialize(keys.groupBy("set").agg(F.min_by("times", "row_key").alias("times"),
                                                 F.min("row_key").alias("row_key")), "pe-wanted")
    bit = F.pmod(F.xxhash64("row_key"), F.lit(WANTED_BITS))
    place = [F.floor(bit / 64).alias("word"), (bit % 64).cast("int").alias("at")]
    words = wanted.select(*place).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("pe_bits"))
    near = (d.select("row_key", "text", *place).join(F.broadcast(words), "word")  # at most WANTED_BITS / 64 rows
            .where("getbit(pe_bits, at) = 1").select("row_key", "text"))
    items = table(near.join(wanted, "row_key").select("set", "times", "text").mapInArrow(given_back(_items), ITEMS), "pe-sets")
    discard(wanted)
    again = materialize(items.where("times > 1").dropDuplicates(["set"]), "pe-repeated")
    return items.where("times = 1").unionByName(again).drop("times"), [items, again]


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with row_key, the id or if it is null a hash of the text; text_key; and pe_text, the text or empty."""
    return (docs.withColumn("pe_text", F.coalesce("text", F.lit(""))).withColumn("text_key", F.xxhash64("pe_text"))
            .withColumn("row_key", F.coalesce(F.col("doc_id").cast("long"), "text_key")))


def similar(docs: DataFrame, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(row_key, text_key, doc_id, n, set) of each document, and links (a, b) enough to join the similar sets: not all."""
    spark = docs.sparkSession
    ship_package(spark)
    d = keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    read = table(d.select("row_key", "text_key", "doc_id", "pe_text").withColumnRenamed("pe_text", "text")
                       .mapInArrow(given_back(_read), READ), "pe-read")
    d = d.select("row_key", F.col("pe_text").alias("text"))
    often = (read.where("times is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
             .orderBy(F.desc("times"), "shingle").limit(FREQUENT_MAX).select("shingle").toPandas())
    frequent = spark.sparkContext.broadcast(np.sort(often["shingle"].to_numpy(np.int64).astype(_U)))
    dealt = [_shared_rows(d.select("text").mapInArrow(given_back(_sign_texts(frequent, percent, i, ROUNDS)), SIGNED), "pe-rows")
             for i in range(ROUNDS)]
    rows = reduce(DataFrame.unionByName, dealt)
    own = read.where("set is not null").select("row_key", "text_key", "doc_id", "n", "set")
    sets, held = _wanted_sets(d, own, rows)
    found = []
    for level in range(LEVELS):
        links, stuck, used = _candidates(rows, sets, percent, level)
        found.append(materialize(links, "pe-links"))
        stuck = materialize(stuck, "pe-stuck")
        for t in [*dealt, *used]:
            discard(t)
        if level == LEVELS - 1 or stuck.isEmpty():
            discard(stuck)
            break
        again = sets.select("set", "items").join(stuck, "set")
        last = level + 1 == LEVELS - 1
        rows = _shared_rows(again.mapInArrow(given_back(_sign_sets(level + 1, percent, last)), SIGNED), "pe-rows")
        dealt = [rows]
        discard(stuck)
    for t in held:
        discard(t)
    return own, reduce(DataFrame.unionByName, found)


def _grouped(own: DataFrame, links: DataFrame) -> DataFrame:
    """(s, comp): the component of each set that is not empty."""
    label = components(links, "a", "b")
    sets = own.where("n > 0").select(F.col("set").alias("s")).distinct()
    return materialize(sets.join(label, sets["s"] == label["node"], "left")
                       .select("s", F.coalesce("label", "s").alias("comp")), "pe-grouped")


def classes(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each document."""
    own, links = similar(docs, percent)
    group = _grouped(own, links)
    in_set = (F.col("set") == F.col("s")) & (F.col("n") > 0)
    least = own.groupBy("set", "n").agg(F.min("doc_id").alias("least")).join(group, in_set)
    named = group.join(least.groupBy("comp").agg(F.min("least").alias("component")), "comp").select("s", "component")
    return own.join(materialize(named, "pe-named"), in_set, "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"))


def representatives(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` for each component, that with the smallest id, and all rows without shingles."""
    own, links = similar(docs, percent)
    placed = own.join(_grouped(own, links), (F.col("set") == F.col("s")) & (F.col("n") > 0))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "row_key", "text_key")
    top = placed.groupBy("comp").agg(F.min(order).alias("top"))
    rows = (placed.groupBy("comp", "row_key", "text_key").agg(F.count("*").alias("times")).join(top, "comp")
            .withColumn("stays", (F.col("row_key") == F.col("top.row_key")) & (F.col("text_key") == F.col("top.text_key"))))
    rows = materialize(rows.where("not stays or times > 1").select("row_key", "text_key", "stays"), "pe-others")
    needed, keys = ["doc_id", "text"], ["row_key", "text_key"]
    d = keyed(packed(docs, needed))
    out = d.join(rows.select(keys), keys, "left_anti")
    again = rows.where("stays")  # repeated rows, of which one stays
    if not again.isEmpty():
        out = out.unionByName(d.join(again.select(keys), keys, "left_semi").dropDuplicates(keys))
    return unpacked(out, docs, needed)
