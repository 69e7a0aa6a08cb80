"""Mixing sources to target weights with hash-threshold histograms.

Every document has a 24-bit hash key. The sizes are summed by source and the upper 12 bits of the key; the running sum
of at most 4,096 buckets a source shows the bucket in which a budget ends. Only the documents of that boundary bucket
are summed again, by the lower 12 bits. The result is one threshold per source and pass, and a document takes part in
pass ``j`` when its key is below threshold ``j``: no documents are sorted, and the selections of smaller budgets are
subsets of those of larger ones.

Defined results: a null source is a source of its own and comes last; a null text has size 0; a null ``doc_id`` is
hashed by its text; repeated rows have equal keys and are taken together; a source without words has target 0 and its
documents are kept once; an empty table gives an empty result. Other columns pass through ``apply_mix`` untouched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskstream.llm.common import materialize, packed, unpacked, word_count

HEX_DIGITS, SPLIT = 6, 3  # of the key, and of its coarse bucket
ALL = 16 ** HEX_DIGITS


def mix_key(doc_id: Column, text: Column) -> Column:
    """24 bits as an integer, the same on every run."""
    seed = F.coalesce(doc_id.cast("string"), text, F.lit(""))
    return F.conv(F.substring(F.md5(seed), 1, HEX_DIGITS), 16, 10).cast("int")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) of each document."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"),
                       mix_key(F.col("doc_id"), F.col("text")).alias("key"))


def targets(totals: DataFrame, weights: Sequence[int], share: float, max_repeats: int) -> DataFrame:
    """Water filling over (source, source_size), one row per source.

    Each source gets ``level * weight`` up to its cap, ``max_repeats`` times its size. In the order of cap / weight the
    capped sources come first, so the level is the largest of the levels that each prefix of capped sources leaves."""
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_source = Window.orderBy(F.col("source").asc_nulls_last())
    filled = (Window.orderBy("ratio", F.col("source").asc_nulls_last())
              .rowsBetween(Window.unboundedPreceding, -1))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    at = (F.row_number().over(by_source) - 1) % len(weights)
    t = (totals.withColumn("weight", F.get(cycle, at))
         .withColumn("cap", F.col("source_size") * max_repeats)
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(filled), F.lit(0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(filled), F.lit(0))
    return (t.withColumn("level", left / open_weight)
            .withColumn("target", F.least(F.col("cap").cast("double"),
                                          F.max("level").over(everything) * F.col("weight")))
            .select("source", "source_size", "target"))


def _boundary(hist: DataFrame, keys: list[str], bucket: str, budget: str) -> DataFrame:
    """The bucket of each ``keys`` in which the running sum passes ``budget``; before: the sum of the buckets below."""
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    return (hist.withColumn("upto", F.sum("s").over(w)).withColumn("before", F.col("upto") - F.col("s"))
            .where((F.col("before") <= F.col(budget)) & (F.col(budget) < F.col("upto"))))


def thresholds(keyed: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
               max_repeats: int = 2) -> DataFrame:
    """(source, source_size, target, cuts) from (source, size, key): ``cuts[j]`` is the key below which a document takes
    part in pass ``j + 1``."""
    low = 16 ** (HEX_DIGITS - SPLIT)
    k = F.col("key")
    hist = materialize(keyed.groupBy("source", F.floor(k / low).cast("int").alias("b1"))
                       .agg(F.sum("size").alias("s")), "mix-hist")
    goal = materialize(targets(hist.groupBy("source").agg(F.sum("s").alias("source_size")), weights, share,
                               max_repeats), "mix-goal")
    budgets = (goal.select("source", "source_size", "target",
                           F.explode(F.sequence(F.lit(1), F.lit(max_repeats))).alias("pass"))
               .withColumn("budget", F.col("target") - (F.col("pass") - 1) * F.col("source_size")))
    part = budgets.where("budget > 0 and budget < source_size").select(
        F.col("source").alias("src"), "pass", "budget")
    coarse = materialize(_boundary(hist.join(part, F.col("source").eqNullSafe(F.col("src"))), ["src", "pass"], "b1",
                                   "budget").select("src", "pass", "b1", (F.col("budget") - F.col("before"))
                                                    .alias("rest")), "mix-coarse")
    fine = (keyed.select("source", "size", F.floor(k / low).cast("int").alias("kb"), (k % low).alias("b2"))
            .join(coarse, F.col("source").eqNullSafe(F.col("src")) & (F.col("kb") == F.col("b1")))
            .groupBy("src", "pass", "b1", "rest", "b2").agg(F.sum("size").alias("s")))
    cut = _boundary(fine, ["src", "pass"], "b2", "rest").select(
        F.col("src").alias("c_src"), F.col("pass").alias("c_pass"),
        (F.col("b1") * low + F.col("b2")
         + F.when(F.col("upto") - F.col("rest") < F.col("rest") - F.col("before"), 1).otherwise(0)).alias("cut"))
    whole = F.when((F.col("source_size") == 0) & (F.col("pass") > 1), 0).when(
        F.col("budget") >= F.col("source_size"), ALL).otherwise(0)
    return (budgets.join(cut, F.col("source").eqNullSafe(F.col("c_src")) & (F.col("pass") == F.col("c_pass")), "left")
            .groupBy("source", "source_size", "target")
            .agg(F.array_sort(F.collect_list(F.coalesce("cut", whole).cast("int"))).alias("cuts")))


def apply_mix(docs: DataFrame, cuts: DataFrame, key: Column) -> DataFrame:
    """``docs`` with mix_source_size, mix_target and mix_copies, how often the mix takes the row."""
    c = cuts.select(F.col("source").alias("mix_source"), F.col("source_size").alias("mix_source_size"),
                    F.col("target").alias("mix_target"), F.col("cuts").alias("mix_cuts"))
    return (docs.withColumn("mix_key", key).join(c, F.col("source").eqNullSafe(F.col("mix_source")))
            .withColumn("mix_copies", F.expr("size(filter(mix_cuts, c -> mix_key < c))"))
            .drop("mix_source", "mix_cuts", "mix_key"))


def mix(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_repeats: int = 2) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document; the texts are read once."""
    keyed = materialize(sizes(docs), "mix-sizes")
    cuts = materialize(thresholds(keyed, weights, share, max_repeats), "mix-cuts")
    return apply_mix(keyed, cuts, F.col("key")).select(
        "doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"),
        (F.col("size") * F.col("mix_copies")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5,
                    max_repeats: int = 2) -> DataFrame:
    """The rows of the mix with the columns of ``docs``: a document taken twice is there twice."""
    keyed = materialize(sizes(docs), "mix-sizes")
    cuts = materialize(thresholds(keyed, weights, share, max_repeats), "mix-cuts")
    needed = ["doc_id", "source", "text"]
    taken = (apply_mix(packed(docs, needed), cuts, mix_key(F.col("doc_id"), F.col("text"))).where("mix_copies > 0")
             .withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))))
    return unpacked(taken, docs, needed)
