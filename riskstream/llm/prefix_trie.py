"""Prefix tries of conversations, as ternary search trees per range of sequences.

``encoded`` numbers the distinct (role, text) turns in a written dictionary and gives every conversation as an array of turn
ids. ``trie`` deals the sequences by ranges of their lexicographic order and sorts them. Equal sequences become one, with
their number, smallest member and the digest of all members. Neighbouring sequences of at most ``SHARD_IDS`` ids (but 64
sequences at least) make a shard, whose ternary search tree is filled median first and so balanced (``Tree``); one iterative
walk accumulates members, leaves and savings bottom-up.

A shard's nodes on the paths of its first and last sequence may also lie in the shards beside it. They leave the shard as
paths with what their finished subtrees add (``_MARK``), and the paths, about 2 a shard, go through the same step again until
one shard holds them all. So no prefix, the root included, is gathered in one task, however many conversations share it.
A node below such a path is given its parent's smallest member by a join, with the few open parents repeated by a salt.

Defined results: turns are ordered by number, nulls first, then by the digest of role and text; null role and text are empty;
rows without conv_id belong to no conversation; repeated rows are turns of their own; an empty table gives no nodes, not even
a root. Other columns are ignored. A conversation's ids are one array of 8 bytes a turn, a row as its texts would be; all
else that a task holds is bounded by the shard. The digest of a node's members reads their ids in order, in pieces of
``PIECE`` joined ids: a digest can't be merged, so one task reads the pieces of one node, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskstream.llm.common import discard, materialize, partitions, ship_package, slices

SHARD_IDS = 100_000  # turn ids of a shard
SHARD_ROWS = 64  # sequences of a shard at least
FEW = 4096  # paths that are not dealt out
PIECE = 4096  # member ids of a piece
HOT = 256  # turns with more than this part of all rows are joined by broadcast: fewer than HOT of them
SALTS = 16
NOTHING = [0, None, 0, 0, 0, None]
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What the finished subtrees below a node of a path, and the conversations that end at it, add to it.
_MARK = "struct<depth:int,members:bigint,least:bigint,children:bigint,leaves:bigint,saved:bigint,ends:string>"
_PATHS = f"seq array<bigint>, chars array<bigint>, marks array<{_MARK}>"
_NODES = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
          "ends_sha256 string, node_key binary, open_parent binary")
_STEP = f"node struct<{', '.join(c.replace(' ', ':', 1) for c in _NODES.split(', '))}>, path struct<{', '.join(c.replace(' ', ':', 1) for c in _PATHS.split(', '))}>"


def turn_key(role: Column, text: Column) -> Column:
    """32 bytes that stand for a turn: the digest of role and text with the length of the role before them."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))


def encoded(turns: DataFrame) -> DataFrame:
    """(conv_id, seq, chars): the turn ids of every conversation and the code points of their texts, written once.

    Turns that make up more than 1 / ``HOT`` of all rows are looked up by broadcast, so they don't meet in one task."""
    coded = materialize(turns.where("conv_id is not null").select(
        "conv_id", "turn", turn_key(F.col("role"), F.col("text")).alias("turn_key"),
        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("chars")), "trie-turns")
    distinct = coded.groupBy("turn_key").agg(F.count(F.lit(1)).alias("uses"))
    ids = materialize(distinct.withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    hot = ids.where(F.col("uses") > F.lit(coded.count() / HOT)).select("turn_key", F.col("id").alias("hot_id"))
    marked = coded.join(F.broadcast(hot), "turn_key", "left")
    numbered = (marked.where("hot_id is not null").withColumnRenamed("hot_id", "id")
                .unionByName(marked.where("hot_id is null").drop("hot_id").join(ids.drop("uses"), "turn_key")))
    turns_of = F.sort_array(F.collect_list(F.struct("turn", "turn_key", "id", "chars")))
    convs = numbered.groupBy("conv_id").agg(turns_of.alias("t"))
    out = materialize(convs.select("conv_id", F.col("t.id").alias("seq"), F.col("t.chars").alias("chars")), "trie-convs")
    discard(coded)
    discard(ids)
    return out


def spliced(convs: DataFrame, base: Column, head: Column, most: int) -> DataFrame:
    """Conversations whose first ``head`` (at most ``most``) turns are those of the conversation ``base``, all if it has fewer,
    none if there is no such; then come their own after the first ``head``."""
    first = lambda c: F.slice(c, 1, most)
    heads = convs.select(F.col("conv_id").alias("base_id"), first("seq").alias("base_seq"), first("chars").alias("base_chars"))
    bases = convs.select(base.alias("base_id")).distinct()
    kept = heads.join(bases, "base_id")  # the few conversations that are a base
    joined = convs.withColumn("base_id", base).withColumn("head", head).join(kept, "base_id", "left")

    def built(own: str, other: str) -> Column:
        front = F.slice(F.coalesce(other, F.array().cast("array<bigint>")), F.lit(1), F.col("head"))
        return F.concat(front, F.slice(own, F.col("head") + 1, F.greatest(F.size(own) - F.col("head"), F.lit(0))))

    return joined.select("conv_id", built("seq", "base_seq").alias("seq"), built("chars", "base_chars").alias("chars"))


class Tree:
    """A ternary search tree over sequences of ids; node 0 is the root, without an id. ``low`` and ``high`` lead to siblings
    with a smaller and a larger id, ``down`` to the first child tried."""

    def __init__(self):
        self.key, self.low, self.high, self.down, self.above, self.depth, self.chars = [0], [0], [0], [0], [-1], [0], [0]
        self.marks: list = [NOTHING.copy()]

    def _new(self, key: int, above: int, chars: int) -> int:
        for column, value in ((self.key, key), (self.low, 0), (self.high, 0), (self.down, 0), (self.above, above),
                              (self.depth, self.depth[above] + 1), (self.chars, chars), (self.marks, NOTHING.copy())):
            column.append(value)
        return len(self.key) - 1

    def insert(self, seq, chars) -> list[int]:
        """The nodes of ``seq``, root first; missing ones are added."""
        path, at = [0], 0
        for key, n in zip(seq, chars):
            links, link, at = self.down, at, self.down[at]
            while at and self.key[at] != key:
                links = self.low if key < self.key[at] else self.high
                link, at = at, links[at]
            if not at:
                at = links[link] = self._new(key, path[-1], n)
            path.append(at)
        return path

    def add(self, node: int, members, least, children, leaves, saved, ends) -> None:
        m = self.marks[node]
        m[0], m[2], m[3], m[4] = m[0] + members, m[2] + children, m[3] + leaves, m[4] + saved
        m[1] = least if m[1] is None else m[1] if least is None else min(m[1], least)
        m[5] = m[5] or ends

    def order(self) -> list[int]:
        """All nodes, each after the node above it."""
        out, stack = [], [0]
        while stack:
            at = stack.pop()
            out.append(at)
            first = [self.down[at]]
            while first:
                x = first.pop()
                if x:
                    stack.append(x)
                    first += [self.low[x], self.high[x]]
        return out


def medians(n: int) -> Iterator[int]:
    """0 to n - 1, the middle of each stretch before both its halves."""
    stack = [(0, n)]
    while stack:
        a, b = stack.pop()
        if a < b:
            yield (a + b) // 2
            stack += [((a + b) // 2 + 1, b), (a, (a + b) // 2)]


def path_keys(seq) -> list[bytes]:
    """A 16-byte name of every prefix of ``seq``, the empty one included."""
    out = [bytes(16)]
    for i in seq:
        out.append(hashlib.blake2b(out[-1] + int(i).to_bytes(8, "little", signed=True), digest_size=16).digest())
    return out


def shard(rows: list[tuple], inner: bool, last: bool) -> tuple[list[tuple], list[tuple]]:
    """The finished nodes and the open paths of neighbouring ``rows`` (seq, chars, marks); if ``last``, no path is open. Nodes
    that have been open before, all those of the rows if not ``inner``, are named."""
    tree = Tree()
    paths: dict[int, list[int]] = {}
    for i in medians(len(rows)):
        seq, chars, marks = rows[i]
        path = tree.insert(seq, chars)
        for m in marks:
            tree.add(path[m[0]], *m[1:])
        if i in (0, len(rows) - 1) or not inner:
            paths[i] = path
    names = {node: key for i, path in paths.items() for node, key in zip(path, path_keys(rows[i][0]))}
    ends = [] if last else sorted({0, len(rows) - 1})
    open_nodes = {node for i in ends for node in paths[i]}
    done, order = [], tree.order()
    for at in reversed(order):
        if at in open_nodes:
            continue
        members, least, children, leaves, saved, _ = m = tree.marks[at]
        m[3] = leaves = leaves + (children == 0)
        m[4] = saved = saved + (members - 1) * tree.chars[at]
        if at:
            tree.add(tree.above[at], members, least, 1, leaves, saved, None)
    for at in order:
        if at not in open_nodes:
            members, least, children, leaves, saved, digest = tree.marks[at]
            above = tree.above[at]
            known = at and above not in open_nodes
            done.append((least, tree.depth[at], tree.marks[above][1] if known else None, members, children, leaves, saved,
                         digest or NO_ENDS, names.get(at), names[above] if at and not known else None))
    out, given = [], set()
    for i in ends:
        marks = [(tree.depth[x], *tree.marks[x]) for x in paths[i] if x not in given and tree.marks[x] != NOTHING]
        given.update(paths[i])
        out.append((rows[i][0], rows[i][1], marks))
    return done, out


def _shards(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in rows:
        if len(held) >= SHARD_ROWS and size + len(r[0]) > SHARD_IDS:
            yield held
            held, size = [], 0
        held.append(r)
        size += len(r[0])
    if held:
        yield held


def _out(done: list[tuple], paths: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    names, marks = [f.name for f in schema.field("node").type], ("depth", "members", "least", "children", "leaves", "saved", "ends")
    for at in range(0, len(done), 5000):
        part = [dict(zip(names, r)) for r in done[at:at + 5000]]
        yield pa.RecordBatch.from_pylist([{"node": r, "path": None} for r in part], schema)
    for seq, chars, m in paths:
        row = {"seq": seq, "chars": chars, "marks": [dict(zip(marks, x)) for x in m]}
        yield pa.RecordBatch.from_pylist([{"node": None, "path": row}], schema)


def _step_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "int": pa.int32()}
    node = pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in _NODES.split(", ")])
    mark = pa.struct([("depth", pa.int32()), *[(c, pa.int64()) for c in ("members", "least", "children", "leaves", "saved")],
                      ("ends", pa.string())])
    path = pa.struct([("seq", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("marks", pa.list_(mark))])
    return pa.schema([("node", node), ("path", path)])


def _rows(batches, columns: tuple) -> Iterator[tuple]:
    for b in slices(batches, 1 << 20):
        yield from zip(*(b.column(c).to_pylist() for c in columns))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (seq, conv_id) to pieces (seq, chars, first member, number, joined ids)."""
    schema = pa.schema([("seq", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())), ("first", pa.int64()),
                        ("members", pa.int64()), ("joined", pa.string())])
    held, ready = None, []

    def piece():
        return {"seq": held[0], "chars": held[1], "first": held[2][0], "members": len(held[2]), "joined": ",".join(map(str, held[2]))}

    for seq, chars, conv in _rows(batches, ("seq", "chars", "conv_id")):
        if held and (held[0] != seq or len(held[2]) == PIECE):
            ready.append(piece())
            held = None
        held = held or (seq, chars, [])
        held[2].append(conv)
        if len(ready) == 500:
            yield pa.RecordBatch.from_pylist(ready, schema)
            ready = []
    if held:
        ready.append(piece())
    if ready:
        yield pa.RecordBatch.from_pylist(ready, schema)


def _sequences(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Distinct sequences with one mark each, from sorted pieces."""
    held = None
    for seq, chars, first, members, joined in pieces:
        if held and held[0] != seq:
            yield held[0], held[1], [(len(held[0]), held[3], held[2], 0, 0, 0, held[4].hexdigest())]
            held = None
        if held:
            held[3] += members
            held[4].update(b"," + joined.encode())
        else:
            held = [seq, chars, first, members, hashlib.sha256(joined.encode())]
    if held:
        yield held[0], held[1], [(len(held[0]), held[3], held[2], 0, 0, 0, held[4].hexdigest())]


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces to nodes and open paths."""
    schema = _step_schema()
    for rows in _shards(_sequences(_rows(batches, ("seq", "chars", "first", "members", "joined")))):
        yield from _out(*shard(rows, True, False), schema)


def _join_paths(last: bool):
    marks = ("depth", "members", "least", "children", "leaves", "saved", "ends")

    def tuples(rows: Iterator[tuple]) -> Iterator[tuple]:
        for seq, chars, m in rows:
            yield seq, chars, [tuple(x[c] for c in marks) for x in m]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _step_schema()
        for rows in _shards(tuples(_rows(batches, ("seq", "chars", "marks")))):
            yield from _out(*shard(rows, False, last), schema)

    return run


def trie(convs: DataFrame) -> DataFrame:
    """The nodes of the trie of ``convs`` (conv_id, seq, chars): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    spark = convs.sparkSession
    ship_package(spark)
    parts = partitions(spark)
    pieces = (convs.repartitionByRange(parts, "seq", "conv_id").sortWithinPartitions("seq", "conv_id")
              .mapInArrow(_pieces, "seq array<bigint>, chars array<bigint>, first long, members long, joined string"))
    pieces = materialize(pieces, "trie-pieces")
    dealt = pieces.repartitionByRange(parts, "seq").sortWithinPartitions("seq", "first")
    steps = [materialize(dealt.mapInArrow(_grow, _STEP), "trie-step")]
    discard(pieces)
    while True:
        paths = steps[-1].where("path is not null").select("path.*")
        size = paths.agg(F.count(F.lit(1)), F.sum(F.size("seq"))).first()
        if not size[0]:
            break
        last = size[0] <= SHARD_ROWS or size[1] <= SHARD_IDS
        if size[0] > FEW and not last:
            paths = paths.repartitionByRange(max(1, min(parts, size[0] // FEW)), "seq")
        else:  # one task takes them shard by shard
            paths = paths.coalesce(1)
        steps.append(materialize(paths.sortWithinPartitions("seq").mapInArrow(_join_paths(last), _STEP), "trie-step"))
    nodes = steps[0].where("node is not null").select("node.*")
    for s in steps[1:]:
        nodes = nodes.unionByName(s.where("node is not null").select("node.*"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    parents = nodes.where("node_key is not null").select(F.col("node_key").alias("key"), F.col("conv_id").alias("above"), salts.alias("salt"))
    salt = F.pmod(F.xxhash64("conv_id", "depth"), F.lit(SALTS)).cast("int")
    opened = nodes.where("open_parent is not null").withColumn("salt_of", salt).join(
        parents, (F.col("open_parent") == F.col("key")) & (F.col("salt_of") == F.col("salt")))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return (nodes.where("open_parent is null").select(names)
            .unionByName(opened.withColumn("parent_conv_id", F.col("above")).select(names)))
