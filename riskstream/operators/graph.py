"""Shared-resource graph as Spark jobs.

Vertices are (type, id) for users, devices and IPs; edges are the user-device, user-ip and device-ip
pairs of each transaction. Nothing is held in driver memory: rings come from a two-stage aggregate,
the best ring per user from a ``min`` over an ordering struct (partial aggregation, no window), and
connected components from iterative large-star / small-star rounds with reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskstream.config import EngineConfig
from riskstream.functions import money
from riskstream.session import discard, materialize

TYPE_RANK = {"user": 0, "device": 1, "ip": 2}


def ingest_seq(tx: DataFrame) -> Column:
    """Arrival order of a transaction (the reference graph's insertion order) as a long: the
    ``ingest_seq`` column when the table carries one (fixtures: the event id, which increases with
    time), else the event time in microseconds. A long keeps every order-based aggregate below on
    fixed-width buffers, i.e. hash aggregation instead of a map-side sort."""
    if "ingest_seq" in tx.columns:
        return F.col("ingest_seq").cast("bigint")
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("event_time"))


def _order(tx: DataFrame) -> DataFrame:
    return tx.select("transaction_id", "user_id", "device_id", "ip_address", "amount", "event_time",
                     ingest_seq(tx).alias("_seq"))


def graph_edges(tx: DataFrame) -> DataFrame:
    """Distinct edges with weight = amount of the latest transaction on that edge."""
    t = _order(tx)
    pairs = F.array(
        F.struct(F.lit("user").alias("src_type"), F.col("user_id").alias("src"),
                 F.lit("device").alias("dst_type"), F.col("device_id").alias("dst")),
        F.struct(F.lit("user").alias("src_type"), F.col("user_id").alias("src"),
                 F.lit("ip").alias("dst_type"), F.col("ip_address").alias("dst")),
        F.struct(F.lit("device").alias("src_type"), F.col("device_id").alias("src"),
                 F.lit("ip").alias("dst_type"), F.col("ip_address").alias("dst")),
    )
    e = t.select("amount", "_seq", F.inline(pairs)).where(F.col("src").isNotNull() & F.col("dst").isNotNull())
    return e.groupBy("src_type", "src", "dst_type", "dst").agg(
        F.max_by("amount", "_seq").alias("weight"),
        F.count(F.lit(1)).alias("n_txn"),
    )


def graph_vertices(tx: DataFrame) -> DataFrame:
    """Distinct (type, id) vertices with the transaction that first created them."""
    t = _order(tx)
    v = F.array(
        F.struct(F.lit("user").alias("type"), F.col("user_id").alias("id")),
        F.struct(F.lit("device").alias("type"), F.col("device_id").alias("id")),
        F.struct(F.lit("ip").alias("type"), F.col("ip_address").alias("id")),
    )
    x = t.select("_seq", F.inline(v)).where(F.col("id").isNotNull())
    return x.groupBy("type", "id").agg(F.min("_seq").alias("first_seen"))


def ring_id(rtype: Column, rid: Column) -> Column:
    """Deterministic ring id (reruns are idempotent)."""
    return F.md5(F.concat_ws(":", rtype, rid))


def resource_users(tx: DataFrame) -> DataFrame:
    """(resource_type, resource_id, user_id) with per-pair first use and amount; first stage of J2."""
    t = _order(tx)
    res = F.array(
        F.struct(F.lit("device").alias("resource_type"), F.col("device_id").alias("resource_id")),
        F.struct(F.lit("ip").alias("resource_type"), F.col("ip_address").alias("resource_id")),
    )
    x = t.select("user_id", "amount", "_seq", "event_time", F.inline(res)).where(
        F.col("resource_id").isNotNull() & F.col("user_id").isNotNull())
    return x.groupBy("resource_type", "resource_id", "user_id").agg(
        F.min("_seq").alias("first_use"),
        F.sum(money("amount")).alias("amount"),
        F.max("event_time").alias("last_use"),
    )


def fraud_rings(tx: DataFrame, cfg: EngineConfig, pairs: DataFrame | None = None) -> DataFrame:
    """device/IP shared by >= ``ring_min_users`` distinct users.

    Both stages aggregate with map-side partials, so a resource used by a third of all users still
    moves only one partial row per map task. Members are not collected into an array (unbounded);
    see :func:`ring_members` for the membership table."""
    p = pairs if pairs is not None else resource_users(tx)
    r = p.groupBy("resource_type", "resource_id").agg(
        F.count(F.lit(1)).alias("n_users"),
        F.sum("amount").alias("_amt"),
        F.min("first_use").alias("first_seen"),
        F.max("last_use").alias("last_seen"),
    ).where(F.col("n_users") >= cfg.ring_min_users)
    return r.select(
        ring_id(F.col("resource_type"), F.col("resource_id")).alias("ring_id"),
        F.col("resource_type").alias("shared_resource_type"),
        F.col("resource_id").alias("shared_resource_id"),
        "n_users",
        F.least(F.col("n_users") / F.lit(10.0), F.lit(1.0)).alias("risk_score"),
        F.col("_amt").alias("total_transaction_amount"),
        "first_seen", "last_seen",
    )


def ring_members(tx: DataFrame, cfg: EngineConfig, pairs: DataFrame | None = None,
                 rings: DataFrame | None = None) -> DataFrame:
    """Long membership table (ring_id, user_id, first_use): the ring's ``user_ids`` in member order."""
    p = pairs if pairs is not None else materialize(resource_users(tx), "resource-users")
    rg = rings if rings is not None else fraud_rings(tx, cfg, p)
    m = p.join(rg.select("ring_id", F.col("shared_resource_type").alias("resource_type"),
                         F.col("shared_resource_id").alias("resource_id"), "n_users", "risk_score", "first_seen"),
               ["resource_type", "resource_id"])
    return m


def user_best_ring(tx: DataFrame, cfg: EngineConfig, pairs: DataFrame | None = None) -> DataFrame:
    """The highest-risk ring of each member, one row per user. Risk is min(users / 10, 1), so the level is
    min(users, 10); ties go to the ring created first, device before IP, then to the smaller resource id, which decides
    where two rings were first used at the same time.

    Rings are numbered in that order, so a user's best ring is the ``min`` of a long: a hash aggregate over the membership
    table, which holds no texts. Only the rings are sorted, and joined back by their number."""
    # the pair table feeds both the ring aggregate and the membership join: written once to the
    # shared folder instead of scanning and shuffling the transactions twice
    p = pairs if pairs is not None else materialize(resource_users(tx), "resource-users")
    rings = fraud_rings(tx, cfg, p).select(
        F.col("shared_resource_type").alias("resource_type"), F.col("shared_resource_id").alias("resource_id"),
        "ring_id", "n_users", "risk_score", "first_seen")
    rings = dense_ids(rings.orderBy(F.desc(F.least("n_users", F.lit(10))), "first_seen",
                                    F.when(F.col("resource_type") == "device", 0).otherwise(1), "resource_id"), column="ring_no")
    members = p.select("resource_type", "resource_id", "user_id").join(
        rings.select("resource_type", "resource_id", "ring_no"), ["resource_type", "resource_id"])
    best = members.groupBy("user_id").agg(F.min("ring_no").alias("ring_no"))
    return best.join(rings, "ring_no").select(
        "user_id", "ring_id", F.col("resource_type").alias("ring_type"), F.col("resource_id").alias("ring_resource"),
        F.col("n_users").alias("ring_users"), F.col("risk_score").alias("ring_risk"))


def resource_amounts(tx: DataFrame) -> DataFrame:
    """Total amount per shared resource (device, IP)."""
    p = resource_users(tx)
    return p.groupBy("resource_type", "resource_id").agg(F.sum("amount").cast("double").alias("total_amount"))


# ---------------------------------------------------------------- connected components

def node_id(kind: Column, name: Column) -> Column:
    """A vertex as a long, so that the rounds move and compare fixed-width values."""
    return F.when(name.isNotNull(), F.xxhash64(kind, name))


def dense_ids(rows: DataFrame, start: int = 0, column: str = "node") -> DataFrame:
    """``rows`` with numbers from ``start`` on, no two alike and none left out; sorted rows are numbered in their order. The
    rows are written with their partition and their place in it; the driver gets the rows' number of each partition."""
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in the lower 33
    rows = materialize(rows.withColumn("_at", place), "dense-ids")
    part, bits = F.shiftright("_at", 33), F.lit((1 << 33) - 1)
    counts = rows.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
    before, offsets = start, []
    for r in counts:
        offsets.append((r["p"], before))
        before += r["n"]
    offset = rows.sparkSession.createDataFrame(offsets, "_p long, _before long")  # a row per partition
    out = rows.withColumn("_p", part).join(F.broadcast(offset), "_p")
    return out.withColumn(column, F.col("_before") + F.col("_at").bitwiseAND(bits)).drop("_p", "_before", "_at")


def undirected_edges(tx: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """(u, v), u < v: the distinct edges between user, device and address of a transaction. Vertices are hashes, or the numbers
    in ``ids`` (type, id, node)."""
    ends = (("user", "user_id", "a"), ("device", "device_id", "b"), ("ip", "ip_address", "c"))
    if ids is None:
        e = tx.select(*[node_id(F.lit(t), F.col(c)).alias(x) for t, c, x in ends])
    else:
        e = tx.select(*[c for _, c, _ in ends]).distinct()
        for t, c, x in ends:
            e = e.join(ids.where(F.col("type") == t).select(F.col("id").alias(c), F.col("node").alias(x)), c, "left")
    e = e.select(
        F.inline(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                         F.struct(F.col("a").alias("x"), F.col("c").alias("y")),
                         F.struct(F.col("b").alias("x"), F.col("c").alias("y")))))
    return (e.where("x is not null and y is not null and x <> y")
            .select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    m = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    out = both.where(F.col("v") > F.col("u")).join(m, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    # orient every edge from the larger to the smaller endpoint: (hi, lo)
    o = e.select(F.col("v").alias("hi"), F.col("u").alias("lo"))
    m = o.groupBy("hi").agg(F.min("lo").alias("m"))
    j = o.join(m, "hi")
    out = j.select(F.col("lo").alias("a"), F.col("m").alias("b")).unionByName(
        m.select(F.col("hi").alias("a"), F.col("m").alias("b")))
    return out.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()


def _is_star_forest(e: DataFrame) -> bool:
    """Converged when every node is either only a centre (u) or a leaf (v) attached to exactly one
    centre: then each component is one star whose centre is its smallest node (u < v). One aggregate."""
    roles = e.select(F.col("u").alias("n"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(
        e.select(F.col("v").alias("n"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
    bad = roles.groupBy("n").agg(F.max("as_u").alias("u"), F.sum("as_v").alias("v")).where(
        ((F.col("u") == 1) & (F.col("v") > 0)) | (F.col("v") > 1))
    return bad.isEmpty()


def connected_components(edges: DataFrame, pre_materialized: bool = False) -> DataFrame:
    """Label every node that has an edge with the smallest node of its component.

    ``edges`` has columns u < v. Alternating large-star / small-star (Kiveris et al., 2014) converges in O(log^2 n)
    rounds and is run until it has converged; each round is written to the shared checkpoint folder
    (:func:`materialize`) so lineage and recovery cost stay flat, and the round before it is removed.
    Returns (node, label)."""
    e = edges if pre_materialized else materialize(edges, "cc-edges")
    first = e
    while True:
        after = materialize(_small_star(_large_star(e)), "cc-round")
        if e is not first:
            discard(e)
        e = after
        if _is_star_forest(e):
            break
    # converged: every edge is (root, node)
    labels = e.select(F.col("v").alias("node"), F.col("u").alias("label"))
    roots = e.select(F.col("u").alias("node"), F.col("u").alias("label")).distinct()
    return labels.unionByName(roots).groupBy("node").agg(F.min("label").alias("label"))


def network_stats(tx: DataFrame) -> DataFrame:
    """Node count, edge count and number of connected components, one row.

    Vertices are 64-bit hashes as long as these are all different, which is counted; else they get dense numbers, so that
    two vertices never merge their components. The distinct undirected edge list is written once (its row count is the edge
    count); components come from :func:`connected_components`; vertices without any edge (a user whose device and IP are
    both missing) are their own components, so nodes are left-joined to labels and counted in one
    aggregate."""
    verts = materialize(graph_vertices(tx).select("type", "id", node_id(F.col("type"), F.col("id")).alias("node")), "cc-vertices")
    ids = None
    if not verts.groupBy("node").count().where("count > 1").isEmpty():
        ids = verts = materialize(dense_ids(verts.drop("node")), "cc-vertices")
    edges = materialize(undirected_edges(tx, ids), "cc-edges")
    comps = connected_components(edges, pre_materialized=True)
    nodes = verts.join(comps, "node", "left").agg(
        F.count(F.lit(1)).alias("node_count"),
        F.countDistinct(F.coalesce("label", "node")).alias("components"))
    return nodes.join(F.broadcast(edges.agg(F.count(F.lit(1)).alias("edge_count")))).select(  # one row each
        "node_count", "edge_count", "components")
