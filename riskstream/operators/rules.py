"""Rules as Column expressions.

A rule maps alert columns to a RULE_HIT struct or null. Rules stay Catalyst expressions, so scoring
is one projection inside whole-stage codegen; no per-row Python.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskstream.config import EngineConfig
from riskstream.functions import fmt_amount, py_round, tier_case

RULE_HIT = T.StructType([
    T.StructField("rule_id", T.StringType()),
    T.StructField("rule_name", T.StringType()),
    T.StructField("severity", T.LongType()),
    T.StructField("bucket_id", T.StringType()),
    T.StructField("reason", T.StringType()),
])


def hit(when: Column, rule_id: str, rule_name: str, severity: Column, bucket: Column, reason: Column) -> Column:
    s = F.struct(
        F.lit(rule_id).alias("rule_id"), F.lit(rule_name).alias("rule_name"),
        severity.cast("bigint").alias("severity"), bucket.alias("bucket_id"), reason.alias("reason"),
    )
    return F.when(when, s)


class Rule(Protocol):
    """User extension point: ``hit`` returns a RULE_HIT struct column, null when not triggered."""

    def hit(self) -> Column: ...


@dataclass(frozen=True)
class VelocityRule:
    cfg: EngineConfig

    def severity(self) -> Column:
        dim = F.upper(F.coalesce(F.col("dimension"), F.lit("")))
        n = F.coalesce(F.col("txn_count"), F.lit(0))
        out = None
        for d, tiers in self.cfg.velocity_tiers.items():
            for threshold, sev in tiers:
                cond = (dim == d) & (n >= threshold)
                out = (F.when if out is None else out.when)(cond, F.lit(sev))
        return out

    def threshold(self) -> Column:
        dim = F.upper(F.coalesce(F.col("dimension"), F.lit("")))
        n = F.coalesce(F.col("txn_count"), F.lit(0))
        out = None
        for d, tiers in self.cfg.velocity_tiers.items():
            for threshold, _ in tiers:
                cond = (dim == d) & (n >= threshold)
                out = (F.when if out is None else out.when)(cond, F.lit(threshold))
        return out

    def hit(self) -> Column:
        dim = F.upper(F.coalesce(F.col("dimension"), F.lit("")))
        n = F.coalesce(F.col("txn_count"), F.lit(0))
        sev = self.severity()
        reason = F.format_string("%s txn_count %d >= %d (sev %d)", dim, n.cast("bigint"),
                                 self.threshold().cast("bigint"), sev.cast("bigint"))
        return hit(sev.isNotNull(), "velocity_alert", "VelocityAlertRule", sev,
                   F.concat(F.lit("vel_"), F.lower(dim)), reason)


@dataclass(frozen=True)
class AmountRule:
    cfg: EngineConfig

    def _total(self) -> Column:
        return F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0))

    def severity(self) -> Column:
        return tier_case(self._total(), self.cfg.amount_tiers)

    def threshold(self) -> Column:
        return tier_case(self._total(), [(t, t) for t, _ in self.cfg.amount_tiers])

    def hit(self) -> Column:
        sev = self.severity()
        reason = F.format_string("total_amount %s >= %s (sev %d)", fmt_amount(self._total(), 2),
                                 fmt_amount(self.threshold(), 0), sev.cast("bigint"))
        return hit(sev.isNotNull(), "high_window_amount", "HighWindowAmountRule", sev, F.lit("amt"), reason)


def py_repr(text: Column) -> Column:
    """A string as Python's repr prints it: in double quotes if it holds single ones only, else in single quotes."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, escape in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(c), F.lit(escape))
    double = text.contains("'") & ~text.contains('"')
    return F.when(double, F.concat(F.lit('"'), out, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(out, F.lit("'"), F.lit("\\'")), F.lit("'")))


@dataclass(frozen=True)
class BlacklistRule:
    """Needs a boolean column ``_blacklisted`` (see :func:`flag_blacklisted`)."""

    cfg: EngineConfig

    def hit(self) -> Column:
        key = F.coalesce(F.col("dimension_key"), F.lit(""))
        return hit(F.coalesce(F.col("_blacklisted"), F.lit(False)), "blacklist", "BlacklistRule",
                   F.lit(self.cfg.blacklist_severity), F.lit("bl"),
                   F.concat(F.lit("dimension_key "), py_repr(key), F.lit(" is blacklisted")))


@dataclass(frozen=True)
class MlRule:
    """Needs a double column ``ml_score`` (0 when the model is absent or the row is an inlier)."""

    def hit(self) -> Column:
        s = F.coalesce(F.col("ml_score"), F.lit(0.0))
        sev = F.least(py_round(s * F.lit(100.0)), F.lit(100).cast("bigint"))
        return hit(s > 0, "ml_anomaly", "ML Anomaly", sev, F.lit("ml"),
                   F.format_string("ML anomaly score: %.2f", s))


@dataclass(frozen=True)
class RingRule:
    """Needs ring columns ``ring_users``, ``ring_risk``, ``ring_type``, ``ring_resource`` (null if none)."""

    def hit(self) -> Column:
        sev = F.least(py_round(F.col("ring_risk") * F.lit(100.0)), F.lit(100).cast("bigint"))
        reason = F.format_string("Fraud ring: %d members share %s '%s'", F.col("ring_users"),
                                 F.col("ring_type"), F.col("ring_resource"))
        return hit(F.col("ring_risk").isNotNull(), "fraud_ring", "FraudRing", sev, F.lit("ring"), reason)


def default_rules(cfg: EngineConfig) -> list:
    """Reference order: velocity, amount, blacklist, ml, ring."""
    return [VelocityRule(cfg), AmountRule(cfg), BlacklistRule(cfg), MlRule(), RingRule()]


def flag_blacklisted(alerts: DataFrame, blacklist: DataFrame | None, value_col: str = "value") -> DataFrame:
    """C4: membership of ``dimension_key`` in the blacklist, as a left join with a flag.

    The blacklist is data (it grows with the event log), so the join strategy is left to AQE, which
    turns it into a broadcast hash join only when the runtime size is under the broadcast threshold.
    """
    if blacklist is None:
        return alerts.withColumn("_blacklisted", F.lit(False))
    bl = blacklist.select(F.col(value_col).alias("_bl_key")).where(F.col("_bl_key").isNotNull()).distinct()
    joined = alerts.join(bl, F.coalesce(alerts["dimension_key"], F.lit("")) == bl["_bl_key"], "left")
    return joined.withColumn("_blacklisted", F.col("_bl_key").isNotNull()).drop("_bl_key")


def tier_table(spark: SparkSession, cfg: EngineConfig) -> DataFrame:
    """O2: velocity tiers as data (dimension, threshold, severity); size fixed by the config."""
    rows = [(d, int(t), int(s)) for d, tiers in cfg.velocity_tiers.items() for t, s in tiers]
    return spark.createDataFrame(rows, "dimension string, threshold long, severity long")


def tier_range_join(windows: DataFrame, tiers: DataFrame) -> DataFrame:
    """Highest tier with threshold <= count, as a broadcast range join (theta on count,
    equi on dimension) followed by max over the tier struct. The tier table has a config-fixed size,
    so broadcasting it is safe; the aggregate keys equal the windows' own keys."""
    t = F.broadcast(tiers.select(F.col("dimension").alias("_td"), "threshold", "severity"))
    keys = ["dimension", "dimension_key", "window_start"]
    j = windows.join(t, (F.upper(windows["dimension"]) == t["_td"]) & (windows["txn_count"] >= t["threshold"]), "left")
    # severity of the highest matching threshold: numeric max_by keeps the aggregate hash-based
    best = j.groupBy(*keys, "txn_count").agg(F.max_by("severity", "threshold").alias("velocity_severity"))
    return best.select(*keys, "txn_count", "velocity_severity")
