"""Exact quantiles by refining histograms.

A buffer of all distinct values grows with the data. Here every round counts the rows of ``CELLS`` equal parts of the value
range that holds the rank, one partially aggregated pass, and goes on with the part that holds it, between the smallest and
the largest value found in that part. The range's ends are in different parts, so each round leaves fewer distinct values,
usually a thousandth; when one is left it is the value at the rank. Nothing but ``CELLS`` counts a group meets in a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskstream.session import discard, materialize

CELLS = 1024


def quantiles(df: DataFrame, value: str, q: float, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by..., n, quantile): the number of values and the ``q`` quantile of each group, between ranks linearly as
    ``percentile`` does. A row counts as ``weight`` rows (a whole number), if given. Null, NaN and infinite values don't count; a
    group without values has no row. Null groups are groups.

    ``df`` is read once for the ranges and once a round."""
    v = F.col(value).cast("double")
    w = (F.col(weight) if weight else F.lit(1)).cast("long")
    rows = df.select(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)], F.lit(0).alias("g"), v.alias("v"), w.alias("w"))
    rows = rows.where((F.col("w") > 0) & F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    keys = [*[f"g{i}" for i in range(len(by))], "g"]
    rank = F.lit(q) * (F.col("n") - 1)
    state = rows.groupBy(*keys).agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # rank: of the lower of the two rows that the quantile lies between; above: the value after it, once it is known
    state = materialize(state.select(*keys, "n", F.floor(rank).alias("rank"), (rank - F.floor(rank)).alias("part"), "lo", "hi",
                                     F.lit(0).cast("long").alias("before"), F.col("n").alias("inside"),
                                     F.lit(None).cast("double").alias("above")), "quantile-range")
    while not state.where("lo < hi").isEmpty():
        before, state = state, materialize(_narrowed(rows, state, keys), "quantile-range")
        discard(before)
    last = F.col("rank") + 1 < F.col("before") + F.col("inside")  # the next row has the same value
    upper = F.when(last | F.col("above").isNull(), F.col("lo")).otherwise(F.col("above"))
    return state.select(*[F.col(f"g{i}").alias(c) for i, c in enumerate(by)], "n",
                        ((1 - F.col("part")) * F.col("lo") + F.col("part") * upper).alias("quantile"))


def _narrowed(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Each open range cut to the part that holds its rank."""
    open_ranges = state.where("lo < hi").select(*[F.col(k).alias("s_" + k) for k in keys], "lo", "hi")
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col("s_" + k))
        same = c if same is None else same & c
    width = F.col("hi") / 2 - F.col("lo") / 2  # halves: the difference of the largest values is no double
    at = F.floor(F.try_divide(F.col("v") / 2 - F.col("lo") / 2, width) * CELLS)  # null if the range is two neighbouring doubles
    cell = (F.when(F.col("v") == F.col("lo"), 0).when(F.col("v") == F.col("hi"), CELLS - 1)
            .otherwise(F.greatest(F.lit(0), F.least(F.lit(CELLS - 1), at))).cast("int"))
    inside = rows.join(open_ranges, same).where(F.col("v").between(F.col("lo"), F.col("hi")))
    counts = inside.groupBy(*keys, cell.alias("cell")).agg(F.sum("w").alias("c"), F.min("v").alias("c_lo"), F.max("v").alias("c_hi"))
    order = Window.partitionBy(*keys).orderBy("cell")
    counts = counts.select(*[F.col(k).alias("c_" + k) for k in keys], "c", "c_lo", "c_hi",
                           F.sum("c").over(order).alias("upto"), F.lead("c_lo").over(order).alias("next"))
    same = None
    for k in keys:
        c = F.col(k).eqNullSafe(F.col("c_" + k))
        same = c if same is None else same & c
    inner = F.col("rank") - F.col("before")
    found = state.where("lo < hi").join(counts, same & (F.col("upto") - F.col("c") <= inner) & (inner < F.col("upto")))
    found = found.select(*keys, "n", "rank", "part", F.col("c_lo").alias("lo"), F.col("c_hi").alias("hi"),
                         (F.col("before") + F.col("upto") - F.col("c")).alias("before"), F.col("c").alias("inside"),
                         F.coalesce("next", "above").alias("above"))
    return found.unionByName(state.where("lo = hi"))


def quantile(df: DataFrame, value: str, q: float, weight: str | None = None) -> float | None:
    """The ``q`` quantile of a column, None if it has no value."""
    row = quantiles(df, value, q, weight=weight).first()
    return None if row is None else row["quantile"]
