"""Column-level building blocks. All are built-in Spark expressions (whole-stage codegen),
no Python UDFs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def EPOCH_NTZ() -> Column:  # noqa: N802  (a Column needs an active session, so build lazily)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_ntz(ts) -> Column:
    """Wall-clock timestamp (timestamp_ntz); all time math is done on wall clock, TZ independent."""
    return _c(ts).cast("timestamp_ntz")


def epoch_ms(ts) -> Column:
    """Milliseconds since the epoch of a wall-clock timestamp, independent of the session TZ."""
    return F.timestamp_diff("MILLISECOND", EPOCH_NTZ(), to_ntz(ts))


def py_round(x) -> Column:
    """Round half to even to an integer (Python ``round``), as bigint."""
    return F.rint(_c(x).cast("double")).cast("bigint")


def prob_union(severities: Sequence) -> Column:
    """Probabilistic union 1 - prod(1 - s/100) of severities in rule order, on 0..100.

    Null severities are skipped (factor 1.0 is exact). Result is rounded half-even and capped at 100.
    Folded left in the given order so the floating result is reproducible.
    """
    prod = F.lit(1.0)
    for s in severities:
        prod = prod * (F.lit(1.0) - F.coalesce(_c(s).cast("double"), F.lit(0.0)) / F.lit(100.0))
    return F.least(py_round((F.lit(1.0) - prod) * F.lit(100.0)), F.lit(100).cast("bigint"))


def tier_case(value, tiers: Iterable[tuple]) -> Column:
    """Highest tier wins: tiers are (threshold, severity) ordered from the highest threshold."""
    v = _c(value)
    out = None
    for threshold, severity in tiers:
        cond = v >= F.lit(threshold)
        out = F.when(cond, F.lit(severity)) if out is None else out.when(cond, F.lit(severity))
    return out


AMOUNT = "decimal(20,2)"


def money(x) -> Column:
    """An amount as an exact decimal; null where it is NaN, infinite or beyond the type, so that one bad value neither
    ends a job nor turns a sum into NaN. Such messages are dead letters where they are decoded."""
    return _c(x).try_cast(AMOUNT)


def ab_bucket(key, buckets: int = 10000) -> Column:
    """Stable hash bucket: first 8 hex digits of md5(key) as an integer, modulo ``buckets``."""
    return F.conv(F.substring(F.md5(_c(key).cast("string")), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)


def fmt_amount(x, decimals: int = 2) -> Column:
    """Thousands-separated fixed-point text, like Python ``format(x, ',.2f')``."""
    return F.format_number(_c(x).cast("double"), decimals)
