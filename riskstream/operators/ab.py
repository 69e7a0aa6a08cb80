"""A/B experiments.

Assignment is a stable md5 bucket of a key column (G8 fixed), so every executor and every rerun
agrees. The experiment and registry tables are configuration-sized; the one active experiment is read
as literals (its size is bounded by the one-active rule), never cross-joined with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskstream.config import EngineConfig
from riskstream.functions import ab_bucket
from riskstream.operators.quantiles import quantiles


def active_experiment(experiments: DataFrame):
    """The active experiment row (first by start date), or None. Bounded: at most one is active."""
    return experiments.where(F.col("status") == "active").orderBy("start_date", "experiment_id").first()


def ab_assign(tx: DataFrame, experiments: DataFrame, versions: list[str], cfg: EngineConfig,
              key: str = "transaction_id") -> DataFrame:
    """L1/L2: bucket < split x buckets -> challenger, else control; a version missing from the model
    set falls back (challenger -> control -> first/default model)."""
    exp = active_experiment(experiments)
    default = versions[0] if versions else None
    b = ab_bucket(F.col(key), cfg.ab_buckets)
    if exp is None:
        return tx.select(key, b.alias("bucket"), F.lit("default").alias("arm"),
                         F.lit(default).cast("string").alias("model_version"), F.lit(None).cast("string").alias("experiment_id"))
    control = exp["control_model_version"] if exp["control_model_version"] in versions else default
    challenger = exp["challenger_model_version"] if exp["challenger_model_version"] in versions else control
    to_ch = b < F.lit(int(round(exp["traffic_split"] * cfg.ab_buckets)))
    return tx.select(
        key, b.alias("bucket"),
        F.when(to_ch, F.lit("challenger")).otherwise(F.lit("control")).alias("arm"),
        F.when(to_ch, F.lit(challenger)).otherwise(F.lit(control)).alias("model_version"),
        F.lit(exp["experiment_id"]).alias("experiment_id"),
    )


def ab_metrics(metrics: DataFrame) -> DataFrame:
    """Per experiment and version: total, correct (null counts as not correct), mean latency."""
    return metrics.groupBy("experiment_id", "model_version").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.coalesce(F.col("was_correct"), F.lit(False))).alias("correct_count"),
        (F.sum("latency_ms").cast("double") / F.count(F.lit(1))).alias("avg_latency_ms"),
    )


def ab_report(metrics: DataFrame, experiments: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Per experiment one wide row {control, challenger}; versions matching neither arm are
    dropped; ``ready`` when both arms reached the minimum sample size. The arms join the aggregated metrics."""
    m = ab_metrics(metrics)
    arms = experiments.select("experiment_id", F.inline(F.array(
        F.struct(F.lit("control").alias("arm"), F.col("control_model_version").alias("model_version")),
        F.struct(F.lit("challenger").alias("arm"), F.col("challenger_model_version").alias("model_version")))))
    j = m.join(arms, ["experiment_id", "model_version"])
    w = j.groupBy("experiment_id").pivot("arm", ["control", "challenger"]).agg(
        F.first("model_version").alias("version"), F.first("total").alias("total"),
        F.first("correct_count").alias("correct"), F.first("avg_latency_ms").alias("avg_latency_ms"))
    return w.withColumn("ready", F.coalesce(F.least("control_total", "challenger_total"), F.lit(0)) >= cfg.min_sample_size)


def latency_p95(metrics: DataFrame) -> DataFrame:
    """Exact 95th percentile of latency per version (:mod:`riskstream.operators.quantiles`)."""
    p = quantiles(metrics, "latency_ms", 0.95, ["model_version"])
    n = metrics.groupBy("model_version").agg(F.count(F.lit(1)).alias("n"))
    p = p.select(F.col("model_version").alias("version"), F.round("quantile", 2).alias("p95_latency_ms"))
    return n.join(p, F.col("model_version").eqNullSafe(F.col("version")), "left").select("model_version", "p95_latency_ms", "n")


def model_registry(results: DataFrame, feedback: DataFrame, seed: DataFrame | None = None) -> DataFrame:
    """Versions with first use, result and feedback counts, the active flag on the latest.
    A seed row is kept on conflict (INSERT ... no-op on duplicate key)."""
    fb = feedback.select("transaction_id").join(results.select("transaction_id", "model_version"), "transaction_id")
    fbc = fb.groupBy("model_version").agg(F.count(F.lit(1)).alias("feedback_count"))
    v = results.groupBy(F.col("model_version").alias("version")).agg(
        F.min("scored_at").alias("trained_at"), F.count(F.lit(1)).alias("training_data_count"))
    v = v.join(fbc.withColumnRenamed("model_version", "version"), "version", "left").fillna(0, ["feedback_count"])
    v = v.select("version", F.date_format("trained_at", "yyyy-MM-dd HH:mm:ss").alias("trained_at"),
                 "training_data_count", "feedback_count", F.lit("derived").alias("notes"))
    if seed is not None:
        from riskstream.operators.state import insert_ignore

        v = insert_ignore(seed.select(*v.columns), v, "version")
    # the version table has one row per model version (tiny); a global window over it is bounded
    order = F.struct("trained_at", "version")
    return v.withColumn("is_active", order == F.max(order).over(Window.partitionBy()))


def apply_correctness(metrics: DataFrame, corrections: DataFrame, seq: str = "seq") -> DataFrame:
    """L3: set ``was_correct`` on every metric row of a transaction from its latest correction
    (UPDATE ... WHERE transaction_id = ?): a left join with the latest correction per key and
    ``coalesce(new, old)``. ``seq`` is an integer order (e.g. created-at microseconds); the pick is a
    hash ``max`` over seq * 2 + verdict bit, so equal sequences resolve to "correct"."""
    packed = F.col(seq).cast("bigint") * 2 + F.col("was_correct").cast("int")
    latest = corrections.groupBy("transaction_id").agg(F.max(packed).alias("_p")).select(
        "transaction_id", (F.col("_p") % 2 == 1).alias("_new"))
    j = metrics.join(latest, "transaction_id", "left")
    return j.select(*[F.coalesce("_new", "was_correct").alias("was_correct") if c == "was_correct" else F.col(c)
                      for c in metrics.columns])


def corrections_from_feedback(feedback: DataFrame) -> DataFrame:
    """Analyst verdicts as model correctness: only a confirmed fraud (true_positive) was right."""
    return feedback.select("transaction_id", (F.col("verdict") == "true_positive").alias("was_correct"),
                           F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                            F.col("created_at")).alias("seq"))


EXPERIMENT_EVENT = ("seq long, experiment_id string, action string, traffic_split double, status string, "
                    "control_model_version string, challenger_model_version string")
EXPERIMENT_STATE = ("experiment_id string, status string, traffic_split double, control_model_version string, "
                    "challenger_model_version string, last_seq long, rejected long")


def _replay(pdf, max_split: float):
    import pandas as pd

    state: dict[str, dict] = {}
    for r in pdf.sort_values("seq").itertuples(index=False):
        cur = state.get(r.experiment_id)
        active = [k for k, v in state.items() if v["status"] == "active"]
        ok = False
        if r.action == "create":
            ok = cur is None and r.traffic_split is not None and 0 <= r.traffic_split <= max_split and not active
            if ok:
                state[r.experiment_id] = {"status": "active", "traffic_split": r.traffic_split,
                                          "control_model_version": r.control_model_version,
                                          "challenger_model_version": r.challenger_model_version,
                                          "last_seq": r.seq, "rejected": 0}
        elif r.action == "status" and cur is not None:
            ok = r.status in ("active", "paused", "completed") and (
                r.status != "active" or not [a for a in active if a != r.experiment_id])
            if ok:
                cur["status"] = r.status
        elif r.action == "split" and cur is not None:
            ok = r.traffic_split is not None and 0 <= r.traffic_split <= max_split
            if ok:
                cur["traffic_split"] = r.traffic_split
        elif r.action == "promote" and cur is not None:
            ok = cur["status"] == "active"
            if ok:
                cur["status"] = "completed"
        if cur is not None or ok:
            s = state.get(r.experiment_id)
            if s is not None:
                s["last_seq"] = r.seq
                s["rejected"] += 0 if ok else 1
    rows = [{"experiment_id": k, **v} for k, v in state.items()]
    cols = ["experiment_id", "status", "traffic_split", "control_model_version", "challenger_model_version",
            "last_seq", "rejected"]
    return pd.DataFrame(rows, columns=cols)


def experiment_state(events: DataFrame, cfg: EngineConfig) -> DataFrame:
    """Replay the experiment lifecycle log with the manager's rules (split <= max, one active
    experiment, valid statuses, promote only from active -> completed); rejected commands are counted.

    The rules couple experiments (at most one active), so the replay is one ordered fold. The log is
    configuration-sized (one row per operator command), never data-sized, so a single group is bounded."""
    from riskstream.session import ship_package

    ship_package(events.sparkSession)
    max_split = cfg.max_traffic_split
    return events.groupBy(F.lit(0).alias("_g")).applyInPandas(lambda pdf: _replay(pdf, max_split), EXPERIMENT_STATE)


def score_by_version(df: DataFrame, scorers: dict, version_col: str = "model_version",
                     default: str | None = None) -> DataFrame:
    """Model plug-in by version: each ``scorers[v]`` (DataFrame -> DataFrame) scores the rows
    routed to ``v``; rows of an unknown version go to ``default`` (the first model when None).
    Every scorer must return the same schema; the parts are combined with ``unionByName``."""
    if not scorers:
        raise ValueError("no scorers")
    default = default if default is not None else next(iter(scorers))
    known = list(scorers)
    routed = df.withColumn("_v", F.when(F.col(version_col).isin(*known), F.col(version_col)).otherwise(F.lit(default)))
    out = None
    for v, fn in scorers.items():
        part = fn(routed.where(F.col("_v") == v).drop("_v"))
        out = part if out is None else out.unionByName(part)
    return out
