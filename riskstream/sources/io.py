"""Record encoding / decoding and typed coercion.

Decoding never fails the job: lines that are not valid JSON for the schema, or that lack a required
field, go to a dead-letter frame with a reason, and the stream continues with the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION_JSON = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("currency", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("merchant_id", T.StringType()),
    T.StructField("location", T.StringType()),
    T.StructField("device_id", T.StringType()),
    T.StructField("ip_address", T.StringType()),
])

CORRUPT = "_corrupt"


def encode_json(df: DataFrame, key: str | None = None) -> DataFrame:
    """(key, value) with the row as a JSON object; ``key`` gives partition affinity."""
    value = F.to_json(F.struct(*[F.col(c) for c in df.columns]))
    return df.select((F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("key"),
                     value.alias("value"))


def decode_json(lines: DataFrame, schema: T.StructType, value_col: str = "value",
                required: Sequence[str] = ("transaction_id",), keep: Sequence[str] = (),
                checks: Sequence[tuple] = ()) -> tuple[DataFrame, DataFrame]:
    """A3: parse JSON lines permissively; returns (good rows, dead letters with a reason). ``checks`` are (reason,
    function of the parsed struct that is true for a bad value)."""
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = lines.select(*keep, F.col(value_col).alias("_raw"),
                          F.from_json(F.col(value_col), full,
                                      {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("_j"))
    missing = None
    for r in required:
        cond = F.col(f"_j.{r}").isNull()
        missing = cond if missing is None else (missing | cond)
    reason = (F.when(F.col("_j").isNull() | F.col(f"_j.{CORRUPT}").isNotNull(), F.lit("malformed"))
              .when(missing, F.lit("missing_field")))
    for name, bad_value in checks:
        reason = reason.when(F.coalesce(bad_value(F.col("_j")), F.lit(False)), F.lit(name))
    tagged = parsed.withColumn("_reason", reason)
    good = tagged.where(F.col("_reason").isNull()).select(*keep, *[F.col(f"_j.{f.name}").alias(f.name) for f in schema.fields])
    bad = tagged.where(F.col("_reason").isNotNull()).select(*keep, F.col("_raw").alias("value"),
                                                             F.col("_reason").alias("reason"))
    return good, bad


def parse_iso(ts: Column) -> Column:
    """ISO-8601 text (with or without offset) to a wall-clock UTC timestamp_ntz; malformed text
    gives null (never an error, so a bad record cannot fail a decode job). A non-UTC offset is
    converted through the instant's epoch microseconds, independent of the session time zone."""
    from riskstream.functions import EPOCH_NTZ

    utc = F.regexp_replace(ts, r"(Z|[+-]00:?00)$", "").try_cast("timestamp_ntz")
    other = F.timestamp_add("MICROSECOND", F.unix_micros(F.try_to_timestamp(ts)), EPOCH_NTZ())
    # casting to timestamp_ntz would silently drop a non-zero offset, so such strings take the instant path
    shifted = ts.rlike(r"[+-][0-9]{2}:?[0-9]{2}$") & ~ts.rlike(r"[+-]00:?00$")
    return F.when(shifted, other).otherwise(utc)


def coerce_columns() -> list[Column]:
    """Casts and defaults of the TRANSACTION entity (currency defaults to USD)."""
    return [
        F.col("transaction_id").cast("string"), F.col("user_id").cast("string"),
        F.col("amount").try_cast("double").alias("amount"),
        F.coalesce(F.col("currency"), F.lit("USD")).alias("currency"),
        parse_iso(F.col("timestamp")).alias("event_time"),
        *[F.col(c).cast("string") for c in ["merchant_id", "location", "device_id", "ip_address"]],
    ]


def coerce_transactions(df: DataFrame) -> DataFrame:
    return df.select(*coerce_columns())


#: What an amount column can hold (see :func:`riskstream.functions.money`).
AMOUNT_LIMIT = 1e18

TRANSACTION_CHECKS = (
    ("bad_amount", lambda j: F.isnan(j["amount"]) | (F.abs(j["amount"]) >= AMOUNT_LIMIT)),
    ("bad_timestamp", lambda j: j["timestamp"].isNotNull() & parse_iso(j["timestamp"]).isNull()),
)


def transactions_of(lines: DataFrame, value_col: str = "value", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Transactions and dead letters of JSON lines, in a batch or a stream: malformed text, missing ids, amounts
    that are NaN, infinite or too large, and times that cannot be read do not end the job."""
    good, bad = decode_json(lines, TRANSACTION_JSON, value_col, keep=keep, checks=TRANSACTION_CHECKS)
    return good.select(*keep, *coerce_columns()), bad


ALERT_TYPES = {"dimension": "string", "window_size": "string", "dimension_key": "string", "txn_count": "bigint",
               "total_amount": "double", "window_start": "bigint", "window_end": "bigint"}


def alerts_of(lines: DataFrame, value_col: str = "value", keep: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A2: velocity alerts and dead letters of JSON lines whose field names may be in either case, as the streaming SQL
    engine emits them in capitals; of names that differ in case only the last counts."""
    fields = F.map_entries(F.from_json(F.col(value_col), "map<string,string>"))
    parsed = lines.select(*keep, F.col(value_col).alias("_raw"), fields.alias("_f"))

    def text(name):
        mine = F.filter("_f", lambda e: F.lower(e["key"]) == name)
        return F.try_element_at(mine, F.lit(-1))["value"]

    typed = {c: text(c).try_cast(t) for c, t in ALERT_TYPES.items()}
    lost = [text(c).isNotNull() & v.isNull() for c, v in typed.items() if ALERT_TYPES[c] != "string"]
    bad_value = lost[0]
    for x in lost[1:]:
        bad_value = bad_value | x
    reason = (F.when(F.col("_f").isNull(), F.lit("malformed"))
              .when(text("dimension").isNull() | text("dimension_key").isNull(), F.lit("missing_field"))
              .when(F.coalesce(bad_value, F.lit(False)), F.lit("bad_value")))
    tagged = parsed.withColumn("_reason", reason)
    return (tagged.where("_reason is null").select(*keep, *[v.alias(c) for c, v in typed.items()]),
            tagged.where("_reason is not null").select(*keep, F.col("_raw").alias("value"), F.col("_reason").alias("reason")))


FRAUD_RESULT_JSON = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("is_fraud", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("reasons", T.ArrayType(T.StringType())),
    T.StructField("rule_triggered", T.StringType()),
    T.StructField("model_version", T.StringType()),
    T.StructField("fraud_ring_id", T.StringType()),
    T.StructField("llm_summary", T.StringType()),
    T.StructField("routed_to", T.StringType()),
    T.StructField("scored_at", T.StringType()),
])


def unit_score(score: Column, scale: float = 1.0) -> Column:
    """A score on the 0..1 scale of stored results, from one on the scale 0..``scale`` (100 for a scorer's). Nothing in a value
    tells its scale, so the caller has to; what lies outside the scale is null."""
    s = score / F.lit(float(scale))
    return F.when(s.between(0, 1), s.try_cast("decimal(5,4)"))


def coerce_results(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """A15 for FRAUD_RESULT: reasons default to [], score from 0..``scale`` to decimal(5,4) on the 0..1 scale
    (:func:`unit_score`)."""
    return df.select(
        "transaction_id", F.coalesce(F.col("is_fraud"), F.lit(False)).alias("is_fraud"),
        unit_score(F.col("score"), scale).alias("score"),
        F.coalesce(F.col("reasons"), F.array().cast("array<string>")).alias("reasons"),
        "rule_triggered", "model_version", "fraud_ring_id", "llm_summary", "routed_to",
        parse_iso(F.col("scored_at")).alias("scored_at"))


def append(df: DataFrame, path: str, partition_by: Sequence[str] = (), batch_id: int | None = None) -> None:
    """Append-only insert into a table path. With a ``batch_id`` the rows go to folders of their own, which an insert of
    the same id replaces, so one that is done again after a failure counts once; the table has the id as a column."""
    w = df.write.mode("append" if batch_id is None else "overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path if batch_id is None else f"{path}/batch_id={batch_id}")


# Declared casts and defaults of the remaining entities (column -> (type, default or None))
ENTITY_SPECS = {
    "analyst_feedback": {"feedback_id": ("string", None), "transaction_id": ("string", None),
                         "analyst_id": ("string", None), "verdict": ("string", None), "notes": ("string", ""),
                         "original_score": ("double", 0.0), "original_model_version": ("string", "unknown")},
    "ab_experiment": {"experiment_id": ("string", None), "name": ("string", None),
                      "control_model_version": ("string", None), "challenger_model_version": ("string", None),
                      "traffic_split": ("double", None), "status": ("string", None), "start_date": ("string", None),
                      "end_date": ("string", None)},
    "fraud_ring": {"ring_id": ("string", None), "shared_resource_type": ("string", None),
                   "shared_resource_id": ("string", None), "risk_score": ("double", 0.0),
                   "total_transaction_amount": ("decimal(14,2)", 0)},
}


def coerce(df: DataFrame, entity: str) -> DataFrame:
    """Cast every declared column (``try_cast``: bad values become null instead of failing the
    job) and fill the entity's defaults; missing columns appear as their default."""
    out = []
    for c, (t, default) in ENTITY_SPECS[entity].items():
        v = F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)
        if default is not None:
            v = F.coalesce(v, F.lit(default).cast(t))
        out.append(v.alias(c))
    return df.select(*out)
