"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every distinct shingle hash below a fixed fraction of the hash range (``FRACTION``, a prefix of the hex
digits of an md5), so its size follows the text's, the sketch of a union is the union of the sketches, and the share of
one sketch that lies in another estimates containment, also between texts of very unequal length. The rule is the same at
every length: of a text of a few shingles few hashes are kept, or none.

Defined results: a null text counts as empty; a text without words, or none of whose hashes lies below the fraction, has
the empty fingerprint, like 1 to another empty one and 0 to any other; with fewer than five words the whole sequence is
one shingle. Rows with equal ids are ordered by
text, descending; null ids come after all others. Of an empty table the result is empty; other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskstream.llm.common import SPACES, materialize, partitions

SHINGLE = 5
#: Hashes below this hex digit are kept: one in 4.
FRACTION = "4"
DIGITS = 16


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add the sketch of column ``text``: sorted 64-bit hashes as hex strings."""
    words, sh = f"{out}_w", f"{out}_s"
    return (df.withColumn(words, F.expr(rf"filter(split(lower({text}), r'{SPACES}'), w -> w != '')"))
            .withColumn(sh, F.expr(
                f"CASE WHEN size({words}) = 0 THEN array() "
                f"WHEN size({words}) < {SHINGLE} THEN array(left(md5(array_join({words}, ' ')), {DIGITS})) "
                f"ELSE transform(slice({words}, 1, size({words}) - {SHINGLE - 1}), (w, i) -> "
                f"left(md5(concat_ws(' ', w, "
                + ", ".join(f"get({words}, i + {j})" for j in range(1, SHINGLE)) + f")), {DIGITS})) END"))
            .drop(words)
            .withColumn(out, F.expr(f"sort_array(array_distinct(filter({sh}, x -> x < '{FRACTION}')))"))
            .drop(sh))


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """Add the estimated share of ``a``'s shingles that ``b`` has."""
    return df.withColumn(out, F.expr(f"CASE WHEN size({a}) = 0 THEN IF(size({b}) = 0, 1.0D, 0.0D) "
                                     f"ELSE size(array_intersect({a}, {b})) / size({a}) END"))


def merge_sketches(a: str, b: str) -> str:
    """SQL of the sketch of the union of two texts' shingles, from their sketches."""
    return f"sort_array(array_union({a}, {b}))"


def _ranges(docs: DataFrame) -> tuple[list[int], bool]:
    """The largest id of each of at most 4 x shuffle partitions ranges of the ids, ascending, and whether there are null ids.

    Spark's range partitioner picks the ranges; what comes to the driver is one row for each."""
    tops = (docs.select(F.col("doc_id").cast("long").alias("doc_id"))
            .repartitionByRange(4 * partitions(docs.sparkSession), "doc_id").groupBy(F.spark_partition_id())
            .agg(F.max("doc_id").alias("top"), F.count_if(F.col("doc_id").isNull()).alias("lost")).collect())
    return sorted({r.top for r in tops if r.top is not None}), any(r.lost for r in tops)


def _range_of(doc_id: str, cuts: list[int]) -> tuple[str, str]:
    """SQL of the number of ``cuts`` below the id, and of the cut that it lies up to.

    The cuts are one constant, in lists of about the root of their number: a row compares with one cut of each list, then
    with those of its own list."""
    step = max(1, round(len(cuts) ** 0.5))
    lists = [cuts[i:i + step] for i in range(0, len(cuts), step)]
    last, each = (f"from_json('{json.dumps(x)}', '{t}')" for x, t in (([x[-1] for x in lists], "array<bigint>"),
                                                                     (lists, "array<array<bigint>>")))
    at = f"size(filter({last}, c -> c < {doc_id}))"
    mine = f"get({each}, {at})"
    below = f"size(filter({mine}, c -> c < {doc_id}))"
    return f"({at} * {step} + {below})", f"get({mine}, {below})"


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """(doc_id, text, ``carried``) with next_* of the row that follows in descending ``doc_id``, of the last the first.

    The ids are cut into ranges of about equal counts, null ids are one more; a window runs within each, and each range also
    gets a copy of the first row of the range after it. The texts are shuffled once."""
    cuts, nulls = _ranges(docs)
    part, top = _range_of("doc_id", cuts)
    d = docs.select("doc_id", "text", F.expr(f"CASE WHEN doc_id IS NULL THEN -1 ELSE {part} END").alias("part"))
    firsts = (d.where(F.expr(f"doc_id IS NULL OR doc_id = {top}"))
              .groupBy("part", "doc_id").agg(F.max("text").alias("text")))
    before = F.when(F.col("part") == len(cuts) - 1, -1 if nulls else 0).otherwise(F.col("part") + 1)  # the highest follows the last
    copies = firsts.select("doc_id", "text", before.alias("part"), F.lit(1).alias("copy"))
    rows = with_sketch(d.withColumn("copy", F.lit(0)).unionByName(copies), "text", "fp")
    w = Window.partitionBy("part").orderBy("copy", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return (rows.select("*", F.lead("text").over(w).alias("next_text"),
                        *[F.lead(c).over(w).alias(f"next_{c}") for c in carried])
            .where("copy = 0").drop("copy", "part"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each document.

    The edited text has the last floor(n_chars / 2) code points replaced by the next document's first as many."""
    d = with_next(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), ["fp"])
    d = (d.withColumn("n_chars", F.length("text").cast("long"))
         .withColumn("edited", F.expr("concat(left(text, CAST(n_chars - n_chars DIV 2 AS INT)), "
                                      "left(next_text, CAST(n_chars DIV 2 AS INT)))")).drop("text", "next_text"))
    d = with_sketch(d, "edited", "efp").withColumn("edited_sha256", F.sha2("edited", 256))
    d = with_likeness(with_likeness(d, "fp", "efp", "near_edited"), "fp", "next_fp", "near_next")
    return d.select("doc_id", "n_chars", "edited_sha256", F.array_join("fp", ",").alias("fingerprint"),
                    F.array_join("efp", ",").alias("edited_fingerprint"), "near_edited", "near_next")
