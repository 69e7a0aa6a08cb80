"""Data-quality checks (B13): declared constraints as one violations table (table, rule, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskstream.operators.feedback import VERDICTS
from riskstream.session import materialize

ROUTES = ("fraud-alerts", "human-review", "approved-transactions")
STATUSES = ("active", "paused", "completed", "draft")


def _flags(df: DataFrame, table: str, key: str, *flags: tuple) -> DataFrame:
    """(table_name, rule, key) for each rule that holds for a row; one scan for all of them."""
    found = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in flags]),
                     lambda r: r.isNotNull())
    return df.select(F.lit(table).alias("table_name"), F.explode(found).alias("rule"), F.col(key).cast("string").alias("key"))


#: Copies of a row that one generator gives at most; more come from several.
RUN = 100_000


def _repeated(df: DataFrame, *rules: tuple) -> DataFrame:
    """(table_name, rule, key) for each (table, rule, times) of a row, ``times`` times. A key that breaks a rule very often
    has no array of that length: runs of ``RUN`` are counted first."""
    each = F.array(*[F.struct(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                              F.coalesce(times, F.lit(0)).cast("long").alias("times")) for table, rule, times in rules])
    broken = df.select(F.col("transaction_id").cast("string").alias("key"), F.inline(each)).where("times > 0")
    runs = broken.withColumn("before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1, F.lit(RUN).cast("long"))))
    one = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(RUN), F.col("times") - F.col("before"))))
    return runs.select("table_name", "rule", "key", one.alias("one")).drop("one")


def constraint_violations(tx_log: DataFrame, results: DataFrame, feedback: DataFrame, experiments: DataFrame,
                          max_split: float = 0.5) -> DataFrame:
    """Enum, range, NOT NULL, primary-key and foreign-key checks.

    Each data table is read once. Transactions are reduced to a row a key, with how often a check failed, and written;
    results are reduced likewise, and one join of the two gives the checks of both and the foreign keys of results. Feedback
    meets the written keys in the same pass as its own check."""
    lost = F.col("user_id").isNull() | F.col("amount").isNull() | F.col("event_time").isNull()
    tx = materialize(tx_log.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("tx_rows"), F.count_if(lost).alias("lost")),
                     "transaction-keys")
    bad_route = F.col("routed_to").isNull() | ~F.col("routed_to").isin(*ROUTES)
    res = results.groupBy("transaction_id").agg(F.count(F.lit(1)).alias("res_rows"), F.count_if(bad_route).alias("routes"))
    both = tx.join(res, "transaction_id", "full")
    broken = _repeated(
        both, ("transactions", "pk_duplicate", F.when(F.col("tx_rows") > 1, 1)), ("transactions", "not_null", F.col("lost")),
        ("fraud_results", "pk_duplicate", F.when(F.col("res_rows") > 1, 1)),
        ("fraud_results", "routed_to_enum", F.col("routes")),
        ("fraud_results", "fk_transaction", F.when(F.col("tx_rows").isNull(), F.col("res_rows"))))
    verdict = F.col("verdict").isNull() | ~F.col("verdict").isin(*VERDICTS)
    known = feedback.join(tx.select("transaction_id", "tx_rows"), "transaction_id", "left")
    broken = broken.unionByName(_flags(known, "analyst_feedback", "feedback_id", ("verdict_enum", verdict),
                                       ("fk_transaction", F.col("tx_rows").isNull())))
    split = (F.col("traffic_split") < 0) | (F.col("traffic_split") > max_split)
    broken = broken.unionByName(_flags(experiments, "ab_experiments", "experiment_id",
                                       ("status_enum", ~F.col("status").isin(*STATUSES)), ("split_range", split)))
    active = experiments.where(F.col("status") == "active").agg(F.count(F.lit(1)).alias("n"),
                                                                F.min("experiment_id").alias("experiment_id"))
    return broken.unionByName(_flags(active, "ab_experiments", "experiment_id", ("one_active", F.col("n") > 1)))
