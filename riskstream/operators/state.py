"""Latest-state operators over event logs.

Each is an aggregate keyed by the entity with ``max_by`` / ``min_by`` over a sequence column, so the
work is a single shuffle with map-side partial aggregation; no per-key sort and no driver loops.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def set_from_log(ops: DataFrame, seq: str = "seq", op: str = "op", value: str = "value") -> DataFrame:
    """S3: members of a set given an add / remove / clear log: the latest op of each value after the
    last clear, kept when it is an add. The last clear is one scalar (a global max)."""
    last_clear = ops.where(F.col(op) == "clear").agg(F.max(seq)).first()[0]
    live = ops.where((F.col(op) != "clear") & F.col(value).isNotNull())
    if last_clear is not None:
        live = live.where(F.col(seq) > F.lit(last_clear))
    # the op is reduced to a 0/1 flag so the aggregate buffer is fixed-width (hash aggregation,
    # no map-side sort)
    is_add = F.when(F.col(op) == "add", F.lit(1)).otherwise(F.lit(0))
    latest = live.groupBy(value).agg(F.max_by(is_add, F.col(seq)).alias("_add"))
    return latest.where(F.col("_add") == 1).select(value)


def upsert_partial(changes: DataFrame, key: str | Sequence[str], update_cols: Sequence[str],
                   seq: str = "seq") -> DataFrame:
    """Upsert on the key where a duplicate changes only ``update_cols`` (latest wins) and every
    other column keeps the first inserted value (ON DUPLICATE KEY UPDATE a subset)."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in changes.columns if c not in keys and c not in update_cols and c != seq]
    aggs = [F.max_by(c, seq).alias(c) for c in update_cols] + [F.min_by(c, seq).alias(c) for c in others]
    out = changes.groupBy(*keys).agg(*aggs, F.count(F.lit(1)).alias("n_versions"))
    return out.select(*[c for c in changes.columns if c != seq], "n_versions")


def insert_ignore(existing: DataFrame, incoming: DataFrame, key: str | Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key is not present yet (INSERT ... no-op on duplicate), appended to ``existing``. Of
    incoming rows with one key the first by ``order`` (a column of ``incoming``) is inserted, then the one with the smallest
    values."""
    keys = [key] if isinstance(key, str) else list(key)
    others = [c for c in existing.columns if c not in keys]
    ranked = F.struct(*([F.col(order).alias("_order")] if order else []), *[F.col(c) for c in others])
    first = incoming.groupBy(*keys).agg(F.min(ranked).alias("_row"))
    new = first.select(*keys, *[F.col("_row")[c].alias(c) for c in others]).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def review_pending(events: DataFrame, key: str = "transaction_id", seq: str = "seq") -> DataFrame:
    """Items of a keyed queue that were not reviewed after they last arrived.

    ``events`` has (key, seq, kind in {item, review}, payload...). Position in the queue is the first
    arrival after the last review of the key (the reference's dict keeps the original slot on
    overwrite and drops it on review); the payload is the latest arrival."""
    reviews = events.where(F.col("kind") == "review").groupBy(key).agg(F.max(seq).alias("_last_review"))
    items = events.where(F.col("kind") == "item").join(reviews, key, "left").where(
        F.col("_last_review").isNull() | (F.col(seq) > F.col("_last_review")))
    payload = [c for c in events.columns if c not in (key, seq, "kind")]
    return items.groupBy(key).agg(
        F.min(seq).alias("position"),
        F.max(seq).alias("last_arrival"),
        F.count(F.lit(1)).alias("arrivals"),
        *[F.max_by(c, seq).alias(c) for c in payload],
    )
