"""Hard negatives of anchors by Strassen products of integer tiles.

Rows are dealt out by a hash, sorted by label bucket, id and content hash and packed into blocks of ``BLOCK`` vectors at most
(``_pack``). Blocks of anchors meet blocks of rows in a grid of cells, each anchor block in every split of the rows and each
row block in every group of the anchors, so neither side is broadcast or held whole and a label with a third of all rows is
just more blocks. All joins are sort-merge joins by a hint: Spark's estimate of a side's size leaves out that the grid repeats
its blocks, and a small estimate would send a copy of each block for every split or group through the driver.

A pair of blocks is one tile: an int64 matrix product by Strassen's recursion, with zero padding where a side is odd
(``strassen``), from which every anchor's heap takes its best rows. Heaps of several tiles merge (``Heaps``): in the task that
made them, then over all tasks by a row limit per heap.

First same-label buckets are multiplied for each anchor's best ``positives``; their scores are windows
``low <= 100 * negative / positive <= high``, and the second run takes the best ``negatives`` of other labels in each window.

Scores are sums modulo 2^64 in two's complement, as int64 adds: Strassen's recursion only adds, subtracts and multiplies, so
every score that a long can hold is exact. Leaf products run in double precision only where the tile's largest values prove
that every partial sum stays below 2^53, else in int64.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; a component is
``floor(scale * x)``, cut to the range of a long; of vectors of different lengths the shorter counts as padded with zeros, so
an empty vector scores 0; rows that repeat another in id, label and vector count once; rows of one id with another label or
vector are rows of their own, and ties of score and id are broken by a hash of label and vector; a null id comes last among
ties and is never an anchor; an empty table, or one without anchors, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskstream.llm.common import discard, materialize, partitions, ship_package, slices, table

BLOCK = 2048  # rows of a block
ANCHORS = 512  # anchors of a block
CELLS = 1 << 20  # components of a block
BUCKETS = 16  # of labels
LEAF = 16  # smallest side that is still halved
DEPTH = 4096  # components multiplied at once
TILES = 8  # joined pairs of blocks that go to Python at once
MOST, LEAST = np.iinfo(np.int64).max, np.iinfo(np.int64).min

_BLOCKS = "bucket int, ids binary, known binary, hashes binary, labels binary, lens binary, width string, parts binary, marks binary"
_HEAP = "anchor_id long, anchor_hash long, slot int, score long, other_id long, other_hash long"


def strassen(a: np.ndarray, b: np.ndarray, leaf=None) -> np.ndarray:
    """``a @ b`` of int64 matrices: seven products of quarters in place of eight, until a side is ``LEAF`` or less."""
    if leaf is None:
        leaf = _leaf(a, b)
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return leaf(a, b)
    if m % 2 or k % 2:
        a = np.pad(a, ((0, m % 2), (0, k % 2)))
    if k % 2 or n % 2:
        b = np.pad(b, ((0, k % 2), (0, n % 2)))
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p = strassen(a11 + a22, b11 + b22, leaf)
    q = strassen(a21 + a22, b11, leaf)
    r = strassen(a11, b12 - b22, leaf)
    s = strassen(a22, b21 - b11, leaf)
    t = strassen(a11 + a12, b22, leaf)
    u = strassen(a21 - a11, b11 + b12, leaf)
    v = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), np.int64)
    out[:i, :l], out[:i, l:] = p + s - t + v, r + t
    out[i:, :l], out[i:, l:] = q + s, p - q + r + u
    return out[:m, :n]


def _leaf(a: np.ndarray, b: np.ndarray):
    """The leaf product: in double precision if no partial sum of it can reach 2^53. Each level at most doubles the operands."""
    levels, side = 0, min(*a.shape, b.shape[1])
    while side > LEAF:
        side, levels = (side + 1) // 2, levels + 1
    high = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    if high[0] * high[1] * 4 ** levels * max(a.shape[1], 1) < 1 << 53:
        return lambda x, y: (x.astype(np.float64) @ y.astype(np.float64)).astype(np.int64)
    return lambda x, y: x @ y


class Heaps:
    """The ``k`` best (score, id, hash) of each slot; larger scores first, then smaller ids. Merging is associative."""

    def __init__(self, slots: int, k: int):
        self.slots, self.k = slots, k
        self.slot = self.score = self.id = self.hash = np.empty(0, np.int64)
        self.known = np.empty(0, bool)
        self.worst = np.full(slots, LEAST)

    def merge(self, slot, score, ids, known, hashes) -> None:
        slot, score = np.concatenate([self.slot, slot]), np.concatenate([self.score, score])
        ids, known = np.concatenate([self.id, ids]), np.concatenate([self.known, known])
        hashes = np.concatenate([self.hash, hashes])
        o = np.lexsort((hashes, ids, ~known, ~score, slot))  # ~x falls as x grows, without overflow
        slot = slot[o]
        start = np.searchsorted(slot, np.arange(self.slots))
        rank = np.arange(len(slot)) - start[slot]
        o, last = o[rank < self.k], o[rank == self.k - 1]
        self.worst[slot[rank == self.k - 1]] = score[last]
        self.slot, self.score, self.id, self.known, self.hash = slot[rank < self.k], score[o], ids[o], known[o], hashes[o]

    def offer(self, scores: np.ndarray, allowed: np.ndarray, first_slot: int, ids, known, hashes) -> None:
        """The ``allowed`` scores of a tile, whose row i belongs to slot ``first_slot + i``."""
        n, m = scores.shape[1], scores.shape[0]
        if not n or not m:
            return
        floor = self.worst[first_slot:first_slot + m]
        if n > self.k:
            held = np.where(allowed, scores, LEAST)
            floor = np.maximum(floor, np.partition(held, n - self.k, axis=1)[:, n - self.k])
        rows, cols = np.nonzero(allowed & (scores >= floor[:, None]))
        if len(rows):
            self.merge(rows + first_slot, scores[rows, cols], ids[cols], known[cols], hashes[cols])


class Block:
    """The vectors of a packed row."""

    def __init__(self, row: dict, prefix: str):
        get = lambda c, t: np.frombuffer(row[prefix + c], t)
        self.ids, self.known, self.hashes = get("ids", np.int64), get("known", bool), get("hashes", np.int64)
        self.labels, self.lens = get("labels", np.int64), get("lens", np.int64)
        self.parts = get("parts", np.dtype(row[prefix + "width"]))
        marks = row[prefix + "marks"]
        self.marks = None if marks is None else np.frombuffer(marks, np.int64).reshape(len(self.ids), -1, 2)
        self.starts = np.cumsum(self.lens) - self.lens
        self.depth = int(self.lens.max(initial=0))

    def dense(self, at: int, upto: int) -> np.ndarray:
        """Components ``at`` to ``upto``, zero where a vector is shorter."""
        n = len(self.ids)
        if n and self.depth == self.lens.min():
            return self.parts.reshape(n, -1)[:, at:upto].astype(np.int64)
        out = np.zeros((n, upto - at), np.int64)
        take = np.clip(self.lens - at, 0, upto - at)
        rows = np.repeat(np.arange(n), take)
        cols = np.arange(len(rows)) - np.repeat(np.cumsum(take) - take, take)
        out[rows, cols] = self.parts[self.starts[rows] + at + cols]
        return out


def products(a: Block, b: Block) -> np.ndarray:
    """The scores of a tile. Components that only one side has add nothing."""
    out = np.zeros((len(a.ids), len(b.ids)), np.int64)
    depth = min(a.depth, b.depth)
    for at in range(0, depth, DEPTH):
        upto = min(depth, at + DEPTH)
        out += strassen(a.dense(at, upto), b.dense(at, upto).T)
    return out


def _narrow(parts: np.ndarray) -> np.ndarray:
    for t in (np.int8, np.int16, np.int32):
        if not len(parts) or (np.iinfo(t).min <= parts.min() and parts.max() <= np.iinfo(t).max):
            return parts.astype(t)
    return parts


def _pack(size: int, scale: int, low: int, high: int):
    """Sorted rows to blocks of one bucket each."""

    def block(bucket, cols) -> dict:
        ids, known, hashes, labels, lens, parts, marks = cols
        parts = _narrow(parts)
        return {"bucket": bucket, "ids": ids.tobytes(), "known": known.tobytes(), "hashes": hashes.tobytes(),
                "labels": labels.tobytes(), "lens": lens.tobytes(), "width": parts.dtype.str, "parts": parts.tobytes(),
                "marks": None if marks is None else marks.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], {"int": pa.int32(), "string": pa.string()}.get(c.split()[1], pa.binary()))
                            for c in _BLOCKS.split(", ")])
        last = None  # the row before, to see repeated ones
        for b in slices(batches, 4 << 20):
            vectors = b.column("embedding")
            lens = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(b.num_rows), lens)
            good = np.bincount(of[~np.isfinite(flat)], minlength=b.num_rows) == 0
            with np.errstate(over="ignore", invalid="ignore"):
                whole = np.floor(scale * flat).clip(-2.0 ** 63, 2.0 ** 63)
                parts = np.where(whole >= 2.0 ** 63, MOST, whole.astype(np.int64))
            known = pc.is_valid(b.column("vec_id")).to_numpy(zero_copy_only=False)
            ids = pc.fill_null(b.column("vec_id"), int(MOST)).to_numpy(zero_copy_only=False)
            hashes, labels, buckets = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row_hash", "label", "bucket"))
            rows = list(zip(ids.tolist(), known.tolist(), hashes.tolist()))
            new = np.array([x != y for x, y in zip(rows, [last, *rows])], bool)
            last = rows[-1] if rows else last
            marks = None
            if "marks" in b.schema.names:
                m = pc.list_flatten(b.column("marks"))
                there = pc.is_valid(m).to_numpy(zero_copy_only=False)
                m = pc.fill_null(m, 0).to_numpy(zero_copy_only=False)
                least = m // 100 * low - (-(m % 100 * low) // 100)
                most = m // 100 * high + m % 100 * high // 100
                marks = np.stack([np.where(there, least, 1), np.where(there, most, 0)], axis=1).reshape(b.num_rows, -1, 2)
            keep = np.flatnonzero(new & good)
            starts = np.cumsum(lens) - lens
            at = 0
            while at < len(keep):
                end = min(at + size, len(keep))
                end = at + int(np.searchsorted(buckets[keep[at:end]], buckets[keep[at]], side="right"))
                end = at + max(1, int(np.searchsorted(np.cumsum(lens[keep[at:end]]), CELLS, side="right")))
                k = keep[at:end]
                chosen = np.concatenate([parts[starts[i]:starts[i] + lens[i]] for i in k])
                cols = (ids[k], known[k], hashes[k], labels[k], lens[k], chosen, None if marks is None else marks[k])
                yield pa.RecordBatch.from_pylist([block(int(buckets[k[0]]), cols)], schema)
                at = end

    return run


def _blocks(rows: DataFrame, size: int, parts: int, scale: int, low: int, high: int, name: str) -> DataFrame:
    sorted_rows = rows.repartition(parts, "vec_id", "row_hash").sortWithinPartitions("bucket", F.col("vec_id").asc_nulls_last(), "row_hash")
    packed = sorted_rows.mapInArrow(_pack(size, scale, low, high), _BLOCKS)
    return materialize(packed.withColumn("no", F.monotonically_increasing_id()), name)


def _tiles(anchors: DataFrame, blocks: DataFrame, cells: int, same: bool) -> DataFrame:
    """Each anchor block beside each row block (of its bucket, if ``same``), dealt by cells of a grid."""
    spark = anchors.sparkSession
    n_a, n_b = anchors.count(), blocks.count()
    groups = max(1, min(n_a, round((cells * n_a * ANCHORS / max(1, n_b * BLOCK)) ** 0.5)))
    splits = max(1, -(-cells // groups))
    dealt = lambda n: F.pmod(F.xxhash64("no"), F.lit(n)).cast("int")
    left = anchors.select(*[F.col(c).alias("a_" + c) for c in anchors.columns if c != "no"], dealt(groups).alias("a_g"),
                          F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("a_s"))
    right = blocks.select(*[c for c in blocks.columns if c != "no"], dealt(splits).alias("s"),
                          F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    on = (F.col("a_g") == F.col("g")) & (F.col("a_s") == F.col("s"))
    return left.join(right.hint("merge"), on & (F.col("a_bucket") == F.col("bucket")) if same else on)


def _heap_rows(anchor: Block, heaps: Heaps) -> pa.RecordBatch:
    who = heaps.slot % len(anchor.ids)
    return pa.RecordBatch.from_arrays([
        pa.array(anchor.ids[who]), pa.array(anchor.hashes[who]), pa.array((heaps.slot // len(anchor.ids) + 1).astype(np.int32)),
        pa.array(heaps.score), pa.array(heaps.id, mask=~heaps.known), pa.array(heaps.hash)],
        names=[c.split()[0] for c in _HEAP.split(", ")])


def _search(k: int, windows: int):
    """The heaps of all tiles of a task: of rows with the anchor's label if ``windows`` is 0, else of the others by window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, tuple[Block, Heaps]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                key = row["a_ids"] + row["a_hashes"]
                if key not in held and len(held) == 32:
                    yield _heap_rows(*held.pop(next(iter(held))))
                a = held[key][0] if key in held else Block(row, "a_")
                heaps = held.setdefault(key, (a, Heaps(max(1, windows) * len(a.ids), k)))[1]
                b = Block(row, "")
                scores = products(a, b)
                same = a.labels[:, None] == b.labels[None, :]
                if not windows:
                    itself = (a.ids[:, None] == b.ids[None, :]) & (a.hashes[:, None] == b.hashes[None, :]) & b.known[None, :]
                    heaps.offer(scores, same & ~itself, 0, b.ids, b.known, b.hashes)
                for w in range(windows):
                    inside = (scores >= a.marks[:, w, :1]) & (scores <= a.marks[:, w, 1:]) & ~same
                    heaps.offer(scores, inside, w * len(a.ids), b.ids, b.known, b.hashes)
        for a, heaps in held.values():
            yield _heap_rows(a, heaps)

    return run


def _best(heaps: DataFrame, k: int) -> DataFrame:
    """Heaps of all tasks merged, with each row's rank."""
    w = Window.partitionBy("anchor_id", "anchor_hash", "slot").orderBy(F.desc("score"), F.col("other_id").asc_nulls_last(), "other_hash")
    return heaps.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
         scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors`` (vec_id, label, embedding)."""
    spark = vectors.sparkSession
    ship_package(spark)
    rows = (vectors.select("vec_id", F.col("label").cast("long").alias("label"), "embedding", is_anchor.alias("is_anchor"))
            .where("label is not null and embedding is not null")
            .withColumn("row_hash", F.xxhash64("label", "embedding"))
            .withColumn("bucket", F.pmod("label", F.lit(BUCKETS)).cast("int")))
    parts = partitions(spark)
    cells = 4 * parts
    anchors = rows.where("is_anchor and vec_id is not null")
    few = max(1, parts // 8)  # anchors are a small part of the rows: fewer, fuller blocks
    packed = [_blocks(rows, BLOCK, parts, scale, low, high, "hn-rows"), _blocks(anchors, ANCHORS, few, scale, low, high, "hn-anchors")]
    near = table(_tiles(packed[1], packed[0], cells, True).mapInArrow(_search(positives, 0), _HEAP), "hn-near", TILES)
    pos = materialize(_best(near, positives), "hn-positives")
    marks = (pos.groupBy("anchor_id", "anchor_hash").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("m"))
             .select("anchor_id", "anchor_hash", F.transform(F.sequence(F.lit(1), F.lit(positives)),
                                                             lambda i: F.try_element_at("m", i)["score"]).alias("marks")))
    marked = (anchors.join(marks.hint("merge"), (F.col("vec_id") == F.col("anchor_id")) & (F.col("row_hash") == F.col("anchor_hash")))
              .drop("anchor_id", "anchor_hash").withColumn("bucket", F.lit(0)))
    packed.append(_blocks(marked, ANCHORS, few, scale, low, high, "hn-marked"))
    far = table(_tiles(packed[2], packed[0], cells, False).mapInArrow(_search(negatives, positives), _HEAP), "hn-far", TILES)
    for t in (*packed, near):
        discard(t)
    neg = _best(far, negatives)
    p = pos.select("anchor_id", "anchor_hash", F.col("rank").alias("slot"), F.col("other_id").alias("positive_id"),
                   F.col("score").alias("positive_score"))
    return (neg.join(p.hint("merge"), ["anchor_id", "anchor_hash", "slot"])
            .select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
