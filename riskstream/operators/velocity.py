"""Tumbling-window velocity aggregates over four entity dimensions.

One scan feeds all four dimensions: each transaction is expanded to four (dimension, key) rows by a
generator, null/empty keys are dropped *before* the shuffle, and a single hash aggregate on
(window, dimension, key) computes count and exact decimal sums. Map-side partial aggregation
collapses hot keys (a merchant holding a third of all rows sends one partial row per map task).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskstream.config import EngineConfig
from riskstream.functions import epoch_ms, money
from riskstream.session import materialize

DIMENSIONS = (("IP", "ip_address"), ("USER", "user_id"), ("DEVICE", "device_id"), ("MERCHANT", "merchant_id"))
ALERT_COLS = ["dimension", "window_size", "dimension_key", "txn_count", "total_amount", "window_start", "window_end"]


def explode_dimensions(tx: DataFrame, time_col: str = "event_time", extra: tuple = ()) -> DataFrame:
    """(dimension, dimension_key) rows, four per transaction; null and empty keys removed."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("dimension_key")) for d, c in DIMENSIONS])
    out = tx.select(F.col(time_col).alias("_t"), F.col("amount"), *extra, F.inline(pairs))
    return out.where(F.col("dimension_key").isNotNull() & (F.col("dimension_key") != ""))


def _window_bounds(cfg: EngineConfig, t: str = "_t") -> list[Column]:
    w = F.window(F.col(t), cfg.window)
    return [epoch_ms(w.start).alias("window_start"), epoch_ms(w.end).alias("window_end")]


def threshold_for(cfg: EngineConfig, dim_col: str = "dimension") -> Column:
    c = F.col(dim_col)
    out = None
    for d, _ in DIMENSIONS:
        out = (F.when if out is None else out.when)(c == d, F.lit(cfg.alert_threshold(d)))
    return out


def velocity_windows(tx: DataFrame, cfg: EngineConfig, time_col: str = "event_time") -> DataFrame:
    """Count and sum per (window, dimension, key), all windows."""
    rows = explode_dimensions(tx, time_col).select("dimension", "dimension_key", "amount", *_window_bounds(cfg))
    agg = rows.groupBy("dimension", "dimension_key", "window_start", "window_end").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum(money("amount")).alias("_sum"),
    )
    return agg.select(
        "dimension", F.lit(cfg.window_label).alias("window_size"), "dimension_key", "txn_count",
        F.col("_sum").cast("double").alias("total_amount"), "window_start", "window_end",
    )


def alert_filter(windows: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Key present and count at or above the dimension's alert threshold."""
    key = F.col("dimension_key")
    return windows.where(key.isNotNull() & (key != "") & (F.col("txn_count") >= threshold_for(cfg)))


def velocity_alerts(tx: DataFrame, cfg: EngineConfig, time_col: str = "event_time") -> DataFrame:
    """Final alert per (dimension, key, window): D1 + B3 in one aggregate."""
    return alert_filter(velocity_windows(tx, cfg, time_col), cfg).select(*ALERT_COLS)


def fan_in(*streams: DataFrame) -> DataFrame:
    """UNION ALL of per-dimension alert streams (no single-partition funnel)."""
    out = streams[0].select(*ALERT_COLS)
    for s in streams[1:]:
        out = out.unionByName(s.select(*ALERT_COLS))
    return out


def dimension_alerts(tx: DataFrame, cfg: EngineConfig, dimension: str, time_col: str = "event_time") -> DataFrame:
    """One per-dimension alert stream: the aggregate reads only the time, amount and that dimension's key."""
    key = dict(DIMENSIONS)[dimension]
    rows = tx.select(F.col(time_col).alias("_t"), "amount", F.col(key).alias("dimension_key")).where(
        F.col("dimension_key").isNotNull() & (F.col("dimension_key") != ""))
    agg = rows.select("dimension_key", "amount", *_window_bounds(cfg)).groupBy(
        "dimension_key", "window_start", "window_end").agg(
        F.count(F.lit(1)).alias("txn_count"), F.sum(money("amount")).alias("_sum"))
    out = agg.select(F.lit(dimension).alias("dimension"), F.lit(cfg.window_label).alias("window_size"),
                     "dimension_key", "txn_count", F.col("_sum").cast("double").alias("total_amount"),
                     "window_start", "window_end")
    return out.where(F.col("txn_count") >= cfg.alert_threshold(dimension))


def per_dimension_alerts(tx: DataFrame, cfg: EngineConfig, time_col: str = "event_time") -> list[DataFrame]:
    """The four per-dimension alert streams (the reference's shape, fanned in by :func:`fan_in`);
    :func:`velocity_alerts` computes the same rows in a single pass."""
    return [dimension_alerts(tx, cfg, d, time_col) for d, _ in DIMENSIONS]


def alert_changelog(tx: DataFrame, cfg: EngineConfig, time_col: str = "event_time") -> DataFrame:
    """One row per transaction that updates a window already at/over its threshold, with the
    running count and sum at that point (the EMIT CHANGES stream, batch form), in the order of event time (in full
    resolution), then transaction id.

    A running count over (dimension, key, window) would put a hot key's whole window into one task, so the rows are cut into
    chunks (:func:`changelog_chunks`): running totals inside each, plus the totals of all chunks before it."""
    rows = changelog_chunks(tx, cfg, time_col)
    w_in = (Window.partitionBy(*CHUNK, "sub").orderBy("at", "transaction_id")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = rows.select(
        "dimension", F.lit(cfg.window_label).alias("window_size"), "dimension_key",
        (F.count(F.lit(1)).over(w_in) + F.col("c_off")).alias("txn_count"),
        (F.coalesce(F.sum("amt").over(w_in), F.lit(0).cast("decimal(30,2)")) + F.col("s_off")).cast("double")
        .alias("total_amount"),
        "window_start", "window_end", "transaction_id", F.col("_t_ms").alias("event_ms"),
    )
    return out.where(F.col("txn_count") >= threshold_for(cfg))


_WINDOW = ["dimension", "dimension_key", "window_start"]
CHUNK = [*_WINDOW, "chunk"]


def _offsets(totals: DataFrame, by: list[str], order: str) -> DataFrame:
    """Exclusive prefix sums of the counts and sums of ``totals``, and the count of the whole."""
    w = Window.partitionBy(*by).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(
        *by, order, "c", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"),
        F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c_off"),
        F.coalesce(F.sum("s").over(before), F.lit(0).cast("decimal(38,2)")).alias("s_off"))


def changelog_chunks(tx: DataFrame, cfg: EngineConfig, time_col: str = "event_time") -> DataFrame:
    """The rows of windows that reach their threshold, each in a chunk of its window with the count and sum before it.

    Chunks are cut by time. Their totals (windows x chunks, by one partially aggregated pass) give the prefix sums and the
    windows' final counts; running counts never exceed these, so the join that brings the offsets drops all windows that
    cannot emit. A chunk of more than ``changelog_chunk_rows`` rows, of a key that is hot in one minute or one microsecond, is
    cut again by rank: its rows are dealt by ranges of (time, id) and each range is a ``sub`` chunk with prefix sums of its own.
    So no window partition follows the share of a key."""
    base = explode_dimensions(tx, time_col, extra=("transaction_id",)).select(
        "dimension", "dimension_key", "transaction_id", money("amount").alias("amt"), F.col("_t").alias("at"),
        epoch_ms("_t").alias("_t_ms"), *_window_bounds(cfg),
    ).withColumn("chunk", F.floor((F.col("_t_ms") - F.col("window_start")) / F.lit(cfg.changelog_chunk_ms)))
    totals = base.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("c"), F.sum("amt").alias("s"))
    offsets = _offsets(totals, _WINDOW, "chunk").where(F.col("n") >= threshold_for(cfg)).drop("n")
    offsets = materialize(offsets, "changelog-offsets")
    hot = offsets.where(F.col("c") > cfg.changelog_chunk_rows)
    n_hot = hot.agg(F.sum("c")).first()[0]
    if not n_hot:
        return base.join(offsets.drop("c"), CHUNK).withColumn("sub", F.lit(0))
    cool = base.join(hot.select(*CHUNK), CHUNK, "left_anti").join(offsets.where(F.col("c") <= cfg.changelog_chunk_rows).drop("c"), CHUNK)
    ranges = -(-4 * int(n_hot) // cfg.changelog_chunk_rows)  # a quarter of the limit each: ranges are cut by a sample
    dealt = (base.join(hot.drop("c"), CHUNK).repartitionByRange(ranges, *CHUNK, "at", "transaction_id")
             .withColumn("sub", F.spark_partition_id()))
    dealt = materialize(dealt, "changelog-hot")
    subs = _offsets(dealt.groupBy(*CHUNK, "sub").agg(F.count(F.lit(1)).alias("c"), F.sum("amt").alias("s")), CHUNK, "sub").select(
        *CHUNK, "sub", F.col("c_off").alias("c_sub"), F.col("s_off").alias("s_sub"))
    rest = [c for c in base.columns if c not in CHUNK]
    hot_rows = dealt.join(subs, [*CHUNK, "sub"]).select(
        *CHUNK, *rest, (F.col("c_off") + F.col("c_sub")).alias("c_off"), (F.col("s_off") + F.col("s_sub")).alias("s_off"), "sub")
    return cool.withColumn("sub", F.lit(0)).unionByName(hot_rows)
