"""Dashboard aggregates.

All KPIs come from one scan of a narrow union (no joins of one-row aggregates); zero-filled outputs
are produced by equi-joins with fixed label tables or by exploding a fixed sequence, never by cross
joins. Top-k outputs order by a unique key tie-break so results are deterministic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskstream.config import EngineConfig
from riskstream.operators.quantiles import quantile

ACTIONS = ("Allow", "Block", "Challenge")


def action_of(routing) -> Column:
    """Both naming schemes (topics and scorer routings) to the dashboard action."""
    r = F.col(routing) if isinstance(routing, str) else routing
    return (F.when(r.isin("fraud-alerts", "block"), F.lit("Block"))
            .when(r.isin("human-review", "review"), F.lit("Challenge")).otherwise(F.lit("Allow")))


def tx_results(tx: DataFrame, results: DataFrame, how: str = "inner") -> DataFrame:
    """C2 (left) / C3 (inner): transactions with their result."""
    r = results.select("transaction_id", "score", "is_fraud", "routed_to", "model_version", "scored_at")
    return tx.join(r, "transaction_id", how)


def kpis(tx: DataFrame, results: DataFrame, feedback: DataFrame, metrics: DataFrame | None,
         cfg: EngineConfig) -> DataFrame:
    """D2 (+ D11, G14): one row. A single global aggregate over a tagged union of narrow projections; the percentile comes from
    :func:`riskstream.operators.quantiles.quantile`."""
    def part(df, tag, score=None, fraud=None, review=None):
        return df.select(
            F.lit(tag).alias("src"),
            (score if score is not None else F.lit(None)).cast("decimal(5,4)").alias("score"),
            (fraud if fraud is not None else F.lit(None)).cast("boolean").alias("fraud"),
            (review if review is not None else F.lit(None)).cast("boolean").alias("review"),
        )

    u = part(tx, "t").unionByName(part(
        results, "r", F.col("score"), F.col("is_fraud"), F.col("routed_to") == "human-review"
    )).unionByName(part(feedback, "f"))
    p95 = quantile(metrics, "latency_ms", 0.95) if metrics is not None else None
    src = F.col("src")
    a = u.agg(
        F.count_if(src == "t").alias("transactions_scanned"),
        F.count_if((src == "r") & F.col("fraud")).alias("fraud_count"),
        F.count_if((src == "r") & F.col("review")).alias("review_count"),
        F.sum(F.when(src == "r", F.col("score"))).alias("_ssum"),
        F.count(F.when(src == "r", F.col("score"))).alias("_sn"),
        F.count_if(src == "f").alias("feedback_count"),
    )
    total = F.col("transactions_scanned")
    return a.select(
        "transactions_scanned",
        F.round(F.when(total > 0, F.col("fraud_count").cast("double") / total * 100).otherwise(0.0), 2)
        .alias("high_risk_rate_pct"),
        F.round(F.when(F.col("_sn") > 0, F.col("_ssum").cast("double") / F.col("_sn")).otherwise(0.0), 4)
        .alias("avg_model_score"),
        F.round(F.lit(p95 or 0.0), 2).alias("p95_latency_ms"),
        F.round(F.when(total > 0, (F.col("review_count") + F.col("fraud_count")).cast("double") / total * 100)
                .otherwise(0.0), 2).alias("false_positive_proxy_pct"),
        F.lit(MODEL_ERRORS).cast("bigint").alias("model_error_count"),
        F.lit(cfg.risk_threshold).alias("risk_threshold"),
        "fraud_count", "review_count", "feedback_count",
    )


def score_histogram(results: DataFrame, faithful: bool = False) -> DataFrame:
    """Ten buckets floor(score*10), zero-filled, labels '0.0-0.1'. Score 1.0 lands in
    bucket 10: ``faithful`` drops it like the reference's display, default clamps it into 9."""
    spark = results.sparkSession
    b = F.floor(F.col("score") * 10).cast("bigint")
    if not faithful:
        b = F.least(b, F.lit(9).cast("bigint"))
    counts = results.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("count"))
    labels = spark.range(10).select(F.col("id").alias("bucket"))
    out = labels.join(counts, "bucket", "left")
    return out.select("bucket", bucket_label(F.col("bucket")).alias("bucket_label"),
                      F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def bucket_label(b: Column) -> Column:
    return F.format_string("%.1f-%.1f", b / F.lit(10.0), (b + 1) / F.lit(10.0))


def bucket_tier(label: Column) -> Column:
    """Label midpoint to colour tier (>= .7 high, >= .4 mid, else low; unparsable -> 0)."""
    parts = F.split(label, "-")
    lo, hi = F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")
    mid = F.when((F.size(parts) == 2) & lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).otherwise(F.lit(0.0))
    return F.when(mid >= 0.7, "high").when(mid >= 0.4, "mid").otherwise("low")


def decision_mix(spark: SparkSession, results: DataFrame) -> DataFrame:
    """Count per action over the three fixed actions, missing = 0."""
    counts = results.groupBy(action_of("routed_to").alias("action")).agg(F.count(F.lit(1)).alias("count"))
    fixed = spark.createDataFrame([(a,) for a in ACTIONS], "action string")
    return fixed.join(counts, "action", "left").select("action", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def decision_share(mix: DataFrame) -> DataFrame:
    """Percent of total per action; Block/Challenge >= 30 danger, >= 22 warn. ``mix`` has one
    row per action (3 rows), so the un-partitioned share window is bounded."""
    total = F.sum("count").over(Window.partitionBy())
    pct = F.when(total > 0, F.col("count").cast("double") / total * 100).otherwise(F.lit(0.0))
    out = mix.withColumn("pct", pct)
    alarm = (F.when(F.col("action").isin("Block", "Challenge") & (F.col("pct") >= 30), "danger")
             .when(F.col("action").isin("Block", "Challenge") & (F.col("pct") >= 22), "warn"))
    return out.select("action", "count", F.round("pct", 2).alias("pct"), alarm.alias("alarm"))


def minute_trend(tx: DataFrame, results: DataFrame, last: int = 20, label_only: bool = False) -> DataFrame:
    """Scanned and flagged per minute, the ``last`` latest minutes in ascending order.
    Default groups on the full minute (G15); ``label_only`` groups on 'HH:mm' like the reference."""
    j = tx_results(tx.select("transaction_id", "event_time"), results, "left")
    key = F.date_format("event_time", "HH:mm") if label_only else F.date_format(
        F.date_trunc("minute", "event_time"), "yyyy-MM-dd HH:mm")
    g = j.groupBy(key.alias("minute_label")).agg(
        F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("is_fraud")).alias("flagged"))
    return g.orderBy(F.col("minute_label").desc()).limit(last).orderBy("minute_label")


def location_matrix(tx: DataFrame, results: DataFrame, top: int = 10) -> DataFrame:
    """Per location counts by action plus total; top locations by total (location breaks ties)."""
    j = tx_results(tx.select("transaction_id", "location"), results, "inner")
    r = F.col("routed_to")
    g = j.groupBy(F.col("location").alias("channel")).agg(
        F.count_if(r == "approved-transactions").alias("Allow"),
        F.count_if(r == "fraud-alerts").alias("Block"),
        F.count_if(r == "human-review").alias("Challenge"),
        F.count(F.lit(1)).alias("total"),
    )
    return g.orderBy(F.col("total").desc(), F.col("channel")).limit(top)


def top_risky_merchants(tx: DataFrame, results: DataFrame, cfg: EngineConfig, top: int = 10) -> DataFrame:
    """Merchants by flagged count (score >= flagged cut) with avg score, high-risk % and band."""
    j = tx_results(tx.select("transaction_id", "merchant_id"), results.where(F.col("score") >= cfg.flagged_score))
    g = j.groupBy(F.col("merchant_id").alias("merchant")).agg(
        F.count(F.lit(1)).alias("flagged_count"),
        F.sum("score").alias("_s"),
        F.count_if(F.col("is_fraud")).alias("_f"),
    )
    pct = F.col("_f").cast("double") / F.col("flagged_count") * 100
    out = g.select(
        "merchant", "flagged_count",
        F.round(F.col("_s").cast("double") / F.col("flagged_count"), 4).alias("avg_score"),
        F.round(pct, 2).alias("high_risk_rate_pct"),
        risk_band(F.round(pct, 2)).alias("risk_band"),
    )
    return out.orderBy(F.col("flagged_count").desc(), F.col("merchant")).limit(top)


def risk_band(pct: Column) -> Column:
    """P5: >= 24 high, >= 14 medium, else low."""
    return F.when(pct >= 24, "high").when(pct >= 14, "medium").otherwise("low")


FLAGGED_COLUMNS = ["transaction_id", "event_time", "merchant_id", "location", "routed_to", "score"]


def newest_flagged(rows: DataFrame, cfg: EngineConfig, n: int = 20) -> DataFrame:
    """The ``n`` newest of joined transactions that are flagged (id breaks time ties). The newest of parts are the newest of
    the whole, so results of parts can be merged by another call."""
    flagged = rows.where(F.col("score") >= cfg.flagged_score).select(*FLAGGED_COLUMNS)
    return flagged.orderBy(F.col("event_time").desc(), F.col("transaction_id")).limit(n)


def flagged_table(top: DataFrame, cfg: EngineConfig) -> DataFrame:
    return top.select(
        F.date_format("event_time", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("event_time"),
        F.concat(F.substring("transaction_id", 1, 12), F.lit("...")).alias("tranID"),
        F.col("merchant_id").alias("merchant"), F.col("location").alias("channel"),
        action_of("routed_to").alias("action"),
        F.round(F.col("score").cast("double"), 4).alias("score"),
        (F.col("score") >= F.lit(cfg.risk_threshold)).alias("over_threshold"),
        F.lit(0).cast("bigint").alias("latency_ms"),
    )


def recent_flagged(tx: DataFrame, results: DataFrame, cfg: EngineConfig, n: int = 20) -> DataFrame:
    """The ``n`` newest flagged transactions (id breaks time ties)."""
    j = tx_results(tx.select("transaction_id", "event_time", "merchant_id", "location"),
                   results.where(F.col("score") >= cfg.flagged_score))
    return flagged_table(newest_flagged(j, cfg, n), cfg)


def system_metrics(tx: DataFrame, results: DataFrame, feedback: DataFrame, experiments: DataFrame) -> DataFrame:
    """Six totals from one aggregate over a tagged union."""
    u = (tx.select(F.lit("t").alias("src"), F.lit(None).cast("string").alias("v"))
         .unionByName(results.select(F.lit("r").alias("src"), F.col("routed_to").alias("v")))
         .unionByName(feedback.select(F.lit("f").alias("src"), F.lit(None).cast("string").alias("v")))
         .unionByName(experiments.select(F.lit("e").alias("src"), F.col("status").alias("v"))))
    s, v = F.col("src"), F.col("v")
    return u.agg(
        F.count_if(s == "t").alias("total_transactions"),
        F.count_if((s == "r") & (v == "fraud-alerts")).alias("fraud_detected"),
        F.count_if((s == "r") & (v == "human-review")).alias("pending_review"),
        F.count_if((s == "r") & (v == "approved-transactions")).alias("approved"),
        F.count_if(s == "f").alias("feedback_count"),
        F.count_if((s == "e") & (v == "active")).alias("active_experiments"),
    )


# ------------------------------------------------------------------ snapshot history (daily)

def _day(ts: str) -> Column:
    return F.date_format(F.date_trunc("day", ts), "yyyy-MM-dd")


def histogram_history(results: DataFrame) -> DataFrame:
    """The score histogram as of the end of each day (cumulative), with the previous day's
    count, the snapshot maximum and the spike class ('red' when a bucket crosses .84 x max, 'amber'
    when it crosses .68 x max but stays under .84 x max).

    The day x bucket grid is made by exploding the fixed bucket sequence per day (no join); running
    totals and lags are partitioned by bucket (rows = days) and maxima by day (rows = 10)."""
    b = F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("bigint")
    daily = results.groupBy(_day("scored_at").alias("day"), b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    grid = daily.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                                                              F.lit(9).cast("bigint"))).alias("bucket"))
    g = grid.join(daily, ["day", "bucket"], "left").fillna(0, ["n"])
    wb = Window.partitionBy("bucket").orderBy("day")
    g = g.withColumn("count", F.sum("n").over(wb.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    g = g.withColumn("prev", F.coalesce(F.lag("count").over(wb), F.lit(0)))
    g = g.withColumn("max_count", F.greatest(F.lit(1), F.max("count").over(Window.partitionBy("day"))))
    amber, red = F.col("max_count") * 0.68, F.col("max_count") * 0.84
    spike = (F.when((F.col("prev") < red) & (F.col("count") >= red), "red")
             .when((F.col("prev") < amber) & (F.col("count") >= amber) & (F.col("count") < red), "amber"))
    return g.select("day", "bucket", bucket_label(F.col("bucket")).alias("bucket_label"),
                    F.col("count").cast("bigint").alias("count"), F.col("prev").cast("bigint").alias("prev"),
                    F.col("max_count").cast("bigint").alias("max_count"), spike.alias("spike"),
                    bucket_tier(bucket_label(F.col("bucket"))).alias("tier"))


def channel_history(tx: DataFrame, results: DataFrame) -> DataFrame:
    """The location x action matrix as of the end of each day, against the previous snapshot
    (missing = 0) with 'increased' flags per cell. Rows exist for the days a channel changed; on other
    days its snapshot equals the previous one and raises no flag."""
    j = tx_results(tx.select("transaction_id", "location"), results)
    r = F.col("routed_to")
    daily = j.groupBy(F.col("location").alias("channel"), _day("scored_at").alias("day")).agg(
        F.count_if(r == "approved-transactions").alias("a"), F.count_if(r == "fraud-alerts").alias("b"),
        F.count_if(r == "human-review").alias("c"), F.count(F.lit(1)).alias("t"))
    w = Window.partitionBy("channel").orderBy("day")
    run = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = daily.select("channel", "day", *[F.sum(c).over(run).alias(c) for c in "abct"])
    out = s.select("channel", "day", *[F.col(c).alias(n) for c, n in zip("abct", ["Allow", "Block", "Challenge", "total"])],
                   *[F.coalesce(F.lag(c).over(w), F.lit(0)).alias("prev_" + n)
                     for c, n in zip("abct", ["Allow", "Block", "Challenge", "total"])])
    return out.select("channel", "day", "Allow", "Block", "Challenge", "total",
                      *[(F.col(n) > F.col("prev_" + n)).alias(n + "_increased") for n in ["Allow", "Block", "Challenge", "total"]],
                      *[F.col("prev_" + n).cast("bigint").alias("prev_" + n) for n in ["Allow", "Block", "Challenge", "total"]])


def melt(df: DataFrame, part: str, item: str | None, metrics: list[str]) -> DataFrame:
    """Long form (part, item, metric, value) of one dashboard part: one ``unpivot`` (Expand), so the
    part's plan is evaluated once whatever the number of metrics."""
    it = F.col(item).cast("string") if item else F.lit("")
    wide = df.select(it.alias("item"), *[F.col(m).cast("double").alias(m) for m in metrics])
    long = wide.unpivot(["item"], metrics, "metric", "value")
    return long.select(F.lit(part).alias("part"), "item", "metric", "value", F.lit(None).cast("string").alias("text"))


def melt_text(df: DataFrame, part: str, item: str, metrics: list[str]) -> DataFrame:
    """The same for metrics that are texts."""
    wide = df.select(F.col(item).cast("string").alias("item"), *[F.col(m).cast("string").alias(m) for m in metrics])
    long = wide.unpivot(["item"], metrics, "metric", "text")
    return long.select(F.lit(part).alias("part"), "item", "metric", F.lit(None).cast("double").alias("value"), "text")


KPI_METRICS = ["transactions_scanned", "high_risk_rate_pct", "avg_model_score", "p95_latency_ms",
               "false_positive_proxy_pct", "model_error_count", "risk_threshold"]
#: The reference reports no model errors and no latency of single transactions: both are the constant 0.
MODEL_ERRORS = 0


ROLLUP_KEYS = ["minute", "location", "merchant_id", "flagged", "bucket", "routed_to"]
ROLLUP_SUMS = ["n", "n_res", "n_fraud", "n_review", "n_allow", "n_block", "s_score"]


def shared_rollup(tx: DataFrame, results: DataFrame, cfg: EngineConfig) -> DataFrame:
    """All grouped dashboard counters in ONE pass: transactions left-joined to results (:func:`rollup`)."""
    j = tx_results(tx.select("transaction_id", "event_time", "location", "merchant_id"), results, "left")
    return rollup(j.withColumn("w", F.lit(1)), cfg)


def rollup(joined: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Joined transactions expanded into the grouping sets (), (minute), (location), (merchant, flagged), (bucket) and
    (routed_to) and aggregated with one shuffle. ``gid`` tells the sets apart; every part is a filter of this result,
    so Spark reuses the single exchange for all of them. A row counts ``w`` times among all transactions: -1 takes back one
    that was counted before it had a result. All measures are sums, so rollups of parts add up."""
    has = F.col("routed_to").isNotNull()
    base = joined.select(
        F.date_format(F.date_trunc("minute", "event_time"), "yyyy-MM-dd HH:mm").alias("minute"),
        "location", "merchant_id", "routed_to", "score", "is_fraud", "w",
        (F.col("score") >= F.lit(cfg.flagged_score)).alias("flagged"),
        F.least(F.floor(F.col("score") * 10), F.lit(9)).cast("bigint").alias("bucket"),
        has.alias("has_result"),
    )
    sets = [[], ["minute"], ["location"], ["merchant_id", "flagged"], ["bucket"], ["routed_to"]]
    r = F.col("routed_to")
    return base.groupingSets(sets, *ROLLUP_KEYS).agg(
        F.grouping_id().alias("gid"),
        F.sum("w").alias("n"),
        F.count_if(F.col("has_result")).alias("n_res"),
        F.count_if(F.col("is_fraud")).alias("n_fraud"),
        F.count_if(r == "human-review").alias("n_review"),
        F.count_if(r == "approved-transactions").alias("n_allow"),
        F.count_if(r == "fraud-alerts").alias("n_block"),
        F.sum("score").alias("s_score"),
    )


def added_rollups(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two rollups as one."""
    both = a.unionByName(b)
    return both.groupBy("gid", *ROLLUP_KEYS).agg(*[F.sum(c).cast(both.schema[c].dataType).alias(c) for c in ROLLUP_SUMS])


def _gid(*present: str) -> int:
    return sum(1 << (len(ROLLUP_KEYS) - 1 - i) for i, c in enumerate(ROLLUP_KEYS) if c not in present)


def snapshot(spark: SparkSession, tx: DataFrame, results: DataFrame, feedback: DataFrame, metrics: DataFrame,
             cfg: EngineConfig) -> DataFrame:
    """Every dashboard part in one long table plus the state note.

    The grouped parts are cut from :func:`shared_rollup` (one scan of each input, one join, one
    shuffle, checkpointed: its size is bounded by the number of distinct minutes, locations, merchants,
    buckets and routes, not by the row count); only the newest-flagged top-k reads the join again (a
    per-partition top-k). Empty inputs give zeros and empty parts by construction."""
    from riskstream.session import materialize

    # materialise the (small) rollup once in the shared checkpoint folder: every part reads it, and
    # without this each part's column pruning would specialise and recompute the scan + join
    g = materialize(shared_rollup(tx, results, cfg), "dashboard-rollup")
    j = tx_results(tx.select("transaction_id", "event_time", "merchant_id", "location"),
                   results.where(F.col("score") >= cfg.flagged_score))
    flagged = materialize(newest_flagged(j, cfg), "dashboard-flagged")  # 20 rows, read by two parts
    return snapshot_of(spark, g, flagged, quantile(metrics, "latency_ms", 0.95), feedback.count(), cfg)


def snapshot_of(spark: SparkSession, g: DataFrame, flagged: DataFrame, p95: float | None, feedback_count: int,
                cfg: EngineConfig) -> DataFrame:
    """The snapshot from a written rollup, the newest flagged transactions, and what was counted of the other tables."""
    gid = F.col("gid")
    tot = g.where(gid == _gid())
    k = tot.agg(F.max("n").alias("t"), F.max("n_fraud").alias("f"), F.max("n_review").alias("rv"), F.max("s_score").alias("ss"),
                F.max("n_res").alias("sn"))
    t = F.coalesce(F.col("t"), F.lit(0))
    kp = k.select(
        t.alias("transactions_scanned"),
        F.round(F.when(t > 0, F.col("f").cast("double") / t * 100).otherwise(0.0), 2).alias("high_risk_rate_pct"),
        F.round(F.when(F.col("sn") > 0, F.col("ss").cast("double") / F.col("sn")).otherwise(0.0), 4).alias("avg_model_score"),
        F.round(F.lit(p95 or 0.0), 2).alias("p95_latency_ms"),
        F.round(F.when(t > 0, (F.col("rv") + F.col("f")).cast("double") / t * 100).otherwise(0.0), 2)
        .alias("false_positive_proxy_pct"), F.lit(MODEL_ERRORS).alias("model_error_count"),
        F.lit(cfg.risk_threshold).alias("risk_threshold"), F.lit(feedback_count).cast("bigint").alias("feedback_count"))
    note = F.when(F.col("feedback_count") > 0,
                  F.format_string("%d analyst feedback entries recorded", F.col("feedback_count")))
    kp_rows = kp.select(F.inline(F.array(
        *[F.struct(F.lit("kpis").alias("part"), F.lit("").alias("item"), F.lit(m).alias("metric"),
                   F.col(m).cast("double").alias("value"), F.lit(None).cast("string").alias("text"))
          for m in KPI_METRICS],
        F.struct(F.lit("state").alias("part"), F.lit("").alias("item"), F.lit("state_note").alias("metric"),
                 F.lit(None).cast("double").alias("value"), note.alias("text")))))

    hist = g.where((gid == _gid("bucket")) & F.col("bucket").isNotNull()).select("bucket", F.col("n_res").alias("count"))
    hist = spark.range(10).select(F.col("id").alias("bucket")).join(hist, "bucket", "left").select(
        bucket_label(F.col("bucket")).alias("bucket_label"), F.coalesce("count", F.lit(0)).alias("count"))
    mix = g.where((gid == _gid("routed_to")) & F.col("routed_to").isNotNull()).groupBy(
        action_of("routed_to").alias("action")).agg(F.sum("n").alias("count"))
    mix = spark.createDataFrame([(a,) for a in ACTIONS], "action string").join(mix, "action", "left").select(
        "action", F.coalesce("count", F.lit(0)).alias("count"))
    trend = g.where(gid == _gid("minute")).select(F.col("minute").alias("minute_label"), F.col("n").alias("scanned"),
                                                  F.col("n_fraud").alias("flagged")).orderBy(F.col("minute_label").desc()).limit(20)
    chan = g.where((gid == _gid("location")) & (F.col("n_res") > 0)).select(
        F.col("location").alias("channel"), F.col("n_allow").alias("Allow"), F.col("n_block").alias("Block"),
        F.col("n_review").alias("Challenge"), F.col("n_res").alias("total")).orderBy(
        F.col("total").desc(), F.col("channel")).limit(10)
    mer = g.where((gid == _gid("merchant_id", "flagged")) & F.col("flagged") & (F.col("n_res") > 0)).select(
        F.col("merchant_id").alias("merchant"), F.col("n_res").alias("flagged_count"),
        F.round(F.col("s_score").cast("double") / F.col("n_res"), 4).alias("avg_score"),
        F.round(F.col("n_fraud").cast("double") / F.col("n_res") * 100, 2).alias("high_risk_rate_pct"),
    ).orderBy(F.col("flagged_count").desc(), F.col("merchant")).limit(10)
    flagged = flagged_table(flagged, cfg)
    parts = [
        kp_rows,
        melt(hist, "score_distribution", "bucket_label", ["count"]),
        melt(mix, "decision_mix", "action", ["count"]),
        melt(trend, "trend", "minute_label", ["scanned", "flagged"]),
        melt(chan, "channel_matrix", "channel", ["Allow", "Block", "Challenge", "total"]),
        melt(mer, "top_risky_merchants", "merchant", ["flagged_count", "avg_score", "high_risk_rate_pct"]),
        melt(flagged, "recent_flagged_transactions", "tranID", ["score", "latency_ms"]),
        melt_text(flagged, "recent_flagged_transactions", "tranID", ["event_time", "merchant", "channel", "action"]),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def newest_flagged_history(tx: DataFrame, results: DataFrame, cfg: EngineConfig) -> DataFrame:
    """The newest flagged transaction as of the end of each day (newest time, then smallest id)
    and whether it changed since the previous day's snapshot.

    Per day the newest time is a hash ``max`` over microseconds; only the rows at that time are
    joined back to pick the smallest id. Across days a running ``min_by`` over the per-day table
    (one row per day: bounded by the time span)."""
    j = tx_results(tx.select("transaction_id", "event_time"), results.where(F.col("score") >= cfg.flagged_score))
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("event_time"))
    j = j.select("transaction_id", _day("scored_at").alias("day"), us.alias("us"))
    newest = j.groupBy("day").agg(F.max("us").alias("us"))
    daily = j.join(newest, ["day", "us"]).groupBy("day", "us").agg(F.min("transaction_id").alias("d_id"))
    run = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = daily.select("day", F.min_by("d_id", F.struct((-F.col("us")).alias("nt"), F.col("d_id"))).over(run)
                       .alias("newest_id"))
    prev = F.lag("newest_id").over(Window.orderBy("day"))
    return out.select("day", F.concat(F.substring("newest_id", 1, 12), F.lit("...")).alias("tranID"),
                      (prev.isNull() | (prev != F.col("newest_id"))).alias("changed"))
