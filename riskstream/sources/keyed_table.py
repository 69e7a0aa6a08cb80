"""A parquet table with a primary key that batches of changes are merged into.

Rows lie in hash buckets of the key, sorted by key within a bucket. A merge reads and rewrites only the buckets that its
changes fall into; all other buckets keep their files. What the table consists of is one small commit file with the folder of
each bucket. A commit file is created under a new number and never changed, so a reader has either the old table or the new
one, a job that dies before its commit leaves the old one, and of two writers from one state the second fails and can merge
again. Batch ids, where given, have to increase: a merge with one not above the last does nothing, so a replayed micro-batch
is merged once.

A key keeps the first inserted value of every column but the ``update`` columns, which take the latest (``INSERT ... ON
DUPLICATE KEY UPDATE`` of a subset; with no update column, of which duplicates change nothing). First and latest follow the
sequence column over all merges, also when batches arrive out of order. Of rows with one key and one sequence number, the one
with the largest values counts. Rows with a null key are not merged.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskstream.sources import files

#: Columns that a stored row has besides the table's own.
FIRST, LAST, VERSIONS, BUCKET = "_first_seq", "_last_seq", "n_versions", "_bucket"
#: Keys that are looked up with a filter on the files' statistics and Bloom filters; more are joined with their buckets.
FILTERED_KEYS = 1000


class MergeConflict(RuntimeError):
    """Another writer has committed since this table was read."""


class KeyedTable:
    """The table at ``path`` as of one commit; ``merge`` moves it to the next."""

    def __init__(self, spark: SparkSession, path: str, version: int, state: dict):
        self.spark, self.path, self.version = spark, path, version
        self.keys, self.update, self.buckets = state["keys"], state["update"], state["buckets"]
        self.folders: dict[int, str] = {int(b): f for b, f in state["folders"].items()}
        self.batch: int | None = state["batch"]  # the last batch id
        self.row_group = state["row_group"]
        self.schema = StructType.fromJson(state["schema"])

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], update: Sequence[str] = (),
               buckets: int = 64, row_group: int = 32 << 20) -> KeyedTable:
        """A new table without rows. ``schema`` has the table's columns, without the sequence; ``buckets`` should make them of
        about 1 GB; ``row_group`` is the size in bytes of what a lookup reads at least."""
        missing = [c for c in (*keys, *update) if c not in schema.names]
        if missing or not keys or set(keys) & set(update):
            raise ValueError(f"keys and update columns have to be different columns of the table: {missing or keys}")
        state = {"keys": list(keys), "update": list(update), "buckets": buckets, "row_group": row_group, "folders": {},
                 "batch": None, "schema": json.loads(schema.json())}
        if not files.create_text(spark, f"{path}/commits/{0:012d}", json.dumps(state) + "\n"):
            raise MergeConflict(f"there is a table at {path}")
        return cls(spark, path, 0, state)

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> KeyedTable:
        """The table as of its last commit, or of an older one that has not been vacuumed."""
        for name in reversed(files.names(spark, f"{path}/commits")):
            if version is None or int(name) == version:
                text = files.read_text(spark, f"{path}/commits/{name}")
                if text.endswith("\n"):  # else its writer died in the middle of it
                    return cls(spark, path, int(name), json.loads(text))
        raise FileNotFoundError(f"no table at {path}")

    def bucket(self, n: int | None = None) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(n or self.buckets)).cast("int")

    def _stored(self) -> StructType:
        return StructType(list(self.schema.fields)).add(FIRST, "long").add(LAST, "long").add(VERSIONS, "long")

    def _read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{f}/{BUCKET}={b}" for b, f in sorted(self.folders.items()) if buckets is None or b in set(buckets)]
        if not paths:
            return self.spark.createDataFrame([], self._stored())
        return self.spark.read.schema(self._stored()).parquet(*paths)

    def read(self) -> DataFrame:
        """The table's columns and ``n_versions``, the number of rows merged into each."""
        return self._read().drop(FIRST, LAST)

    def _states(self, rows: DataFrame, first: str, last: str, versions: Column, *by: str) -> DataFrame:
        """One row a key: the latest update columns, the first of the others."""
        update = F.struct(*[F.col(c) for c in (last, *self.update)])
        others = [c for c in self.schema.names if c not in self.keys and c not in self.update]
        kept = F.struct((-F.col(first)).alias("s"), *[F.col(c) for c in others])
        merged = rows.groupBy(*by, *self.keys).agg(F.max(update).alias("_u"), F.max(kept).alias("_k"), versions.alias(VERSIONS))
        columns = {k: F.col(k) for k in self.keys} | {c: F.col("_u")[c] for c in self.update} | {c: F.col("_k")[c] for c in others}
        return merged.select(*by, *[columns[c].alias(c) for c in self.schema.names], (-F.col("_k")["s"]).alias(FIRST),
                             F.col("_u")[last].alias(LAST), VERSIONS)

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: as many values as there are buckets at most."""
        return sorted(r[0] for r in rows.select(self.bucket().alias("b")).distinct().collect())

    def merge(self, changes: DataFrame, seq: str = "seq", batch_id: int | None = None) -> KeyedTable:
        """The table with ``changes`` (its columns and ``seq``) merged. Changes are reduced to one row a key before they are
        dealt out, so a key with many changes in a batch is one row by then."""
        if batch_id is not None and self.batch is not None and batch_id <= self.batch:
            return self
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in self.keys])
        rows = changes.where(known).select(*self.schema.names, F.col(seq).cast("long").alias("_seq"))
        batch = self._states(rows, "_seq", "_seq", F.count(F.lit(1)))
        buckets = self.touched(rows)
        folder = uuid.uuid4().hex[:16]
        if buckets:
            both = self._read(buckets).unionByName(batch).withColumn(BUCKET, self.bucket())
            dealt = both.repartition(min(len(buckets), 20_000), BUCKET)
            merged = self._states(dealt, FIRST, LAST, F.sum(VERSIONS), BUCKET)
            writer = merged.sortWithinPartitions(BUCKET, *self.keys).write.partitionBy(BUCKET)
            for k in self.keys:
                writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
            writer.option("parquet.block.size", self.row_group).parquet(f"{self.path}/data/{folder}")
        return self._commit({**self.folders, **{b: folder for b in buckets}}, self.batch if batch_id is None else batch_id)

    def _commit(self, folders: dict[int, str], batch: int | None) -> KeyedTable:
        latest = KeyedTable.open(self.spark, self.path).version
        if latest != self.version:
            raise MergeConflict(f"{self.path}: read at version {self.version}, now at {latest}")
        number = 1 + max(int(n) for n in files.names(self.spark, f"{self.path}/commits"))  # passes over a dead writer's file
        state = {"keys": self.keys, "update": self.update, "buckets": self.buckets, "row_group": self.row_group, "folders": folders,
                 "batch": batch, "schema": json.loads(self.schema.json())}
        if not files.create_text(self.spark, f"{self.path}/commits/{number:012d}", json.dumps(state) + "\n"):
            raise MergeConflict(f"{self.path}: version {number} was committed by another writer")
        return KeyedTable(self.spark, self.path, number, state)

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """The rows of the keys in ``wanted``. Only their buckets are read, and of up to ``FILTERED_KEYS`` keys only the row
        groups whose statistics and Bloom filters let one of them be there."""
        keys = wanted.select(*self.keys).distinct()
        rows = self._read(self.touched(keys)).drop(FIRST, LAST)
        some = keys.limit(FILTERED_KEYS + 1).collect()
        if not some:
            return rows.where("false")
        if len(some) <= FILTERED_KEYS:
            one = [reduce(lambda a, b: a & b, [F.col(k) == F.lit(r[k]) for k in self.keys]) for r in some
                   if all(r[k] is not None for k in self.keys)]
            return rows.where(_any(one)) if one else rows.where("false")
        return rows.join(keys, self.keys, "left_semi")

    def vacuum(self) -> None:
        """Delete commits and folders that this version, the last one, does not use. For a time without readers of older ones."""
        if KeyedTable.open(self.spark, self.path).version != self.version:
            raise MergeConflict(f"{self.path} has moved on from version {self.version}")
        used = set(self.folders.values())
        for name in files.names(self.spark, f"{self.path}/commits"):
            if int(name) < self.version:
                files.delete(self.spark, f"{self.path}/commits/{name}")
        for name in files.names(self.spark, f"{self.path}/data"):
            if name not in used:
                files.delete(self.spark, f"{self.path}/data/{name}")


def _any(conditions: list[Column]) -> Column:
    """A balanced tree of ORs: a chain of a thousand is too deep for the optimizer."""
    while len(conditions) > 1:
        conditions = [reduce(lambda a, b: a | b, conditions[i:i + 2]) for i in range(0, len(conditions), 2)]
    return conditions[0]
