"""Fixture views derived from the driver's ``events`` table.

The driver has no payment tables, so transactions, fraud results, analyst feedback, A/B metrics and
the event logs of the blacklist and review queue are *derived* from ``events`` with deterministic
expressions. Their size grows with ``events``. The same definitions exist as SQL text in
:mod:`riskstream.plans.fixture_sql` for the DuckDB oracles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.functions import epoch_ms, to_ntz
from riskstream.sources.tables import load_table


def _k() -> Column:
    return F.regexp_extract("props", r"([0-9]+)", 1).cast("int")


def _txn_id(e="event_id") -> Column:
    return F.concat(F.lit("txn-"), F.col(e).cast("string"))


def _model_version() -> Column:
    return F.when(F.col("event_id") % 10 < 3, F.lit("v2.0")).otherwise(F.lit("v1.0"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "events")


def transactions_from_events(ev: DataFrame, keep: tuple = ()) -> DataFrame:
    """TRANSACTION rows (with ``event_time`` wall clock); 20 shared devices, IPs shared by user % 50.
    ``keep`` passes through source columns (``uid`` = the numeric user id)."""
    k = _k()
    loc = F.element_at(F.array(*[F.lit(x) for x in ("US", "IN", "UK", "CA", "AU", "DE", "JP")]),
                       (F.col("event_id") % 7 + 1).cast("int"))
    return ev.select(
        _txn_id().alias("transaction_id"),
        F.concat(F.lit("User_"), F.col("user_id").cast("string")).alias("user_id"),
        F.col("value").alias("amount"),
        F.lit("USD").alias("currency"),
        to_ntz("ts").alias("event_time"),
        F.concat(F.lit("Merch_"), F.col("event_type")).alias("merchant_id"),
        loc.alias("location"),
        F.when(k < 20, F.concat(F.lit("Dev_SHARED_"), k.cast("string")))
        .otherwise(F.concat(F.lit("Dev_User_"), F.col("user_id").cast("string"))).alias("device_id"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 50).cast("string"), F.lit("."), k.cast("string")).alias("ip_address"),
        F.col("event_id").alias("ingest_seq"),  # arrival order (event ids increase with time)
        *[(F.col("user_id") if c == "uid" else F.col(c)).alias(c) for c in keep],
    )


def fx_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_from_events(events(spark, sf_dir))


def fraud_results_from_events(ev: DataFrame) -> DataFrame:
    score = F.when(F.col("value") >= 250, F.lit(1.0)).otherwise(F.col("value") / F.lit(250.0)).cast("decimal(5,4)")
    r = ev.where(F.col("event_id") % 17 != 0).select(
        _txn_id().alias("transaction_id"), "event_id", to_ntz("ts").alias("scored_at"), score.alias("score")
    )
    return r.select(
        "transaction_id",
        "score",
        (F.col("score") >= F.lit(0.8)).alias("is_fraud"),
        F.when(F.col("score") >= 0.8, "fraud-alerts").when(F.col("score") >= 0.3, "human-review")
        .otherwise("approved-transactions").alias("routed_to"),
        _model_version().alias("model_version"),
        "scored_at",
    )


def fx_fraud_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fraud_results_from_events(events(spark, sf_dir))


def fx_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir).where(F.col("event_type") == "error")
    verdict = F.element_at(F.array(F.lit("true_positive"), F.lit("false_positive"), F.lit("false_negative")),
                           (F.col("event_id") % 3 + 1).cast("int"))
    return ev.select(
        F.concat(F.lit("fb-"), F.col("event_id").cast("string")).alias("feedback_id"),
        _txn_id().alias("transaction_id"),
        F.concat(F.lit("analyst_"), (F.col("user_id") % 5).cast("string")).alias("analyst_id"),
        verdict.alias("verdict"),
        F.lit("").alias("notes"),
        (to_ntz("ts") + F.expr("INTERVAL 1 DAY")).alias("created_at"),
    )


def fx_ab_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = events(spark, sf_dir)
    correct = F.when(F.col("event_type") != "error", F.lit(None).cast("boolean")).otherwise(
        (F.col("event_id") % 3 != 1) == (F.col("value") >= 200)
    )
    return ev.select(
        F.lit("exp-001").alias("experiment_id"),
        _model_version().alias("model_version"),
        _txn_id().alias("transaction_id"),
        F.col("value").cast("decimal(8,2)").alias("latency_ms"),
        correct.alias("was_correct"),
    )


def fx_blacklist_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blacklist event log (add / remove / clear) derived from events; seq = event_id."""
    ev = events(spark, sf_dir)
    k = _k()
    user = F.concat(F.lit("User_"), F.col("user_id").cast("string"))
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 50).cast("string"), F.lit("."), k.cast("string"))
    et = F.col("event_type")
    op = (F.when((et == "error") & (k % 10 == 0), "add")
          .when((et == "signup") & (k % 10 == 0), "remove")
          .when((et == "error") & (k % 10 == 5), "add")
          .when((et == "view") & (k == 3) & (F.col("user_id") % 25 == 0), "add")
          .when((et == "error") & (k == 42), "add")
          .when((et == "purchase") & (k == 99) & (F.col("user_id") % 10 == 0), "clear"))
    value = (F.when((et == "error") & (k % 10 == 0), user)
             .when((et == "signup") & (k % 10 == 0), user)
             .when((et == "error") & (k % 10 == 5), ip)
             .when((et == "view") & (k == 3) & (F.col("user_id") % 25 == 0), F.lit("Dev_SHARED_3"))
             .when((et == "error") & (k == 42), F.lit("Merch_error")))
    return ev.select(F.col("event_id").alias("seq"), op.alias("op"), value.alias("value")).where(F.col("op").isNotNull())


def fx_review_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review-queue event log: human-review results arrive as items (some arrive again two days
    later), analyst feedback arrives as reviews. seq = epoch ms."""
    res = fx_fraud_results(spark, sf_dir).where(F.col("routed_to") == "human-review")
    first = res.select("transaction_id", epoch_ms("scored_at").alias("seq"), F.lit("item").alias("kind"), "score")
    again = (res.where(F.regexp_extract("transaction_id", r"([0-9]+)", 1).cast("bigint") % 5 == 0)
             .select("transaction_id", (epoch_ms("scored_at") + F.lit(2 * 86_400_000)).alias("seq"),
                     F.lit("item").alias("kind"), "score"))
    reviews = fx_feedback(spark, sf_dir).select(
        "transaction_id", epoch_ms("created_at").alias("seq"), F.lit("review").alias("kind"),
        F.lit(None).cast("decimal(5,4)").alias("score"))
    return first.unionByName(again).unionByName(reviews)


def fx_transaction_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows for the transactions table (seq 1 = original insert): two generations of
    updates, which also try to change columns an upsert must keep, and some new keys."""
    ev = events(spark, sf_dir)
    t = transactions_from_events(ev, keep=("event_id", "uid", "value"))
    old = t.select(*_TX_COLS, F.lit(1).alias("seq"))

    def upd(mod, step, seq, location):
        return t.where(F.col("event_id") % mod == 0).select(
            "transaction_id",
            F.concat(F.lit("User_"), (F.col("uid") + step).cast("string")).alias("user_id"),
            (F.col("value") + step).alias("amount"), "currency", "event_time",
            F.lit("Merch_updated").alias("merchant_id"), location.alias("location"), "device_id", "ip_address",
            F.lit(seq).alias("seq"))

    new = t.where(F.col("event_id") % 10 == 3).select(
        F.concat(F.lit("txn-new-"), F.col("event_id").cast("string")).alias("transaction_id"),
        *[c for c in _TX_COLS if c != "transaction_id"], F.lit(2).alias("seq"))
    return old.unionByName(upd(4, 1, 2, F.col("location"))).unionByName(upd(8, 2, 3, F.lit("ZZ"))).unionByName(new)


def fx_result_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change rows for fraud results: a re-score (1 - score) of every sixth result (new score and routing,
    plus a model/time that an upsert must not take over)."""
    ev = events(spark, sf_dir)
    r = fraud_results_from_events(ev).withColumn("seq", F.lit(1))
    eid = F.regexp_extract("transaction_id", r"([0-9]+)", 1).cast("bigint")
    half = (F.lit(1).cast("decimal(5,4)") - F.col("score")).cast("decimal(5,4)")
    re = r.where(eid % 6 == 0).select(
        "transaction_id", half.alias("score"), (half >= F.lit(0.8)).alias("is_fraud"),
        F.when(half >= 0.8, "fraud-alerts").when(half >= 0.3, "human-review")
        .otherwise("approved-transactions").alias("routed_to"),
        F.lit("v3.0").alias("model_version"), (F.col("scored_at") + F.expr("INTERVAL 1 DAY")).alias("scored_at"),
        F.lit(2).alias("seq"))
    return r.unionByName(re)


_TX_COLS = ["transaction_id", "user_id", "amount", "currency", "event_time", "merchant_id", "location",
            "device_id", "ip_address"]


def experiments(spark: SparkSession) -> DataFrame:
    """Experiment configuration rows (EXPERIMENT schema): one active, one completed. Configuration,
    not data: joined to data-derived tables only."""
    rows = [
        ("exp-001", "Test Experiment", "v1.0", "v2.0", 0.20, "active", "2026-01-01", None),
        ("exp-000", "Earlier Experiment", "v0.9", "v1.0", 0.10, "completed", "2025-06-01", "2025-12-31"),
    ]
    return spark.createDataFrame(
        rows, "experiment_id string, name string, control_model_version string, challenger_model_version string, "
              "traffic_split double, status string, start_date string, end_date string")
