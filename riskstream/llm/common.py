"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.session import checkpoint_dir, discard, materialize, ship_package
from riskstream.sources.tables import load_table

__all__ = ["WORD", "SPACES", "ascii_lower", "discard", "documents", "given_back", "materialize", "ship_package", "word_count", "partitions", "checkpoint_path", "packed", "unpacked", "slices", "small_batches", "fewer_rows", "table", "trim"]

#: A word, and what separates words: the six ASCII white-space characters only.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_table(spark, sf_dir, "documents")


def word_count(text: Column) -> Column:
    """Number of words; null counts as a text without words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share."""
    return f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"


def packed(docs: DataFrame, needed: list[str]) -> DataFrame:
    """The ``needed`` columns of ``docs`` and one struct of all others, so that no added column meets theirs."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in needed]
    return docs.select(*needed, F.struct(*(others or [F.lit(0).alias("none")])).alias("packed_row"))


def unpacked(df: DataFrame, docs: DataFrame, needed: list[str]) -> DataFrame:
    """The columns of ``docs`` from what was ``packed``."""
    return df.select(*[F.col(c) if c in needed else F.col("packed_row").getField(c).alias(c) for c in docs.columns])


def slices(batches, size: int):
    """Arrow record batches cut to about ``size`` bytes, so that what a task holds at once does not follow Spark's batches."""
    for b in batches:
        step = max(1, b.num_rows * size // (b.nbytes + 1))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


#: Rows that go to a Python worker at once where a table of whole texts is written.
BATCH_ROWS = 3000


BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def fewer_rows(spark: SparkSession, rows: int = BATCH_ROWS) -> str:
    """Let Arrow batches have at most ``rows`` rows from now on. Returns the setting before."""
    before = spark.conf.get(BATCH_SETTING)
    spark.conf.set(BATCH_SETTING, str(min(rows, int(before)) if int(before) > 0 else rows))
    return before


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """Small Arrow batches: the texts that the JVM and a worker hold at once stay few. The session's own setting is put back."""
    before = fewer_rows(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_SETTING, before)


def table(df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
    """``materialize`` with small Arrow batches."""
    with small_batches(df.sparkSession, rows):
        return materialize(df, name)


def trim() -> None:
    """Return unused memory of this process to the machine."""
    pa.default_memory_pool().release_unused()
    of_c = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if of_c:
        of_c(0)


def given_back(work, drop=None):
    """``work`` on a task's batches; at the end of the task ``drop`` empties its caches and the worker returns what it no
    longer uses to the machine. Spark keeps workers for later tasks, also of stages that need the memory for something else."""

    def run(batches):
        try:
            yield from work(batches)
        finally:
            if drop:
                drop()
            trim()

    return run
