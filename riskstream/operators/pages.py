"""Pages deep in an ordered table without sorting all of it.

The rows are written once in ranges of their order, each sorted, with the number of rows and the first key of every range.
A page at any offset is then found by the prefix sums of the counts and read from the one or two ranges it lies in; the page
after a given key, which stays right when rows before it come or go, from the range that the key falls into."""

from __future__ import annotations

import bisect
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from riskstream.session import checkpoint_dir

RANGE = "_range"


def _comparable(key: Sequence) -> tuple:
    """A key that sorts as Spark does: nulls first."""
    return tuple((v is not None, v) if v is not None else (False,) for v in key)


@dataclass
class OrderedPages:
    """A written, ordered copy of a table. ``order`` has to be unique for pages to be; ranges are of about ``rows`` rows."""

    spark: SparkSession
    path: str
    schema: StructType
    order: list[str]
    ranges: list[int]
    upto: list[int]  # rows up to the end of each range
    first: list[tuple]

    @classmethod
    def write(cls, df: DataFrame, order: Sequence[str], path: str | None = None, rows: int = 1_000_000) -> OrderedPages:
        """The driver keeps a count and a key of each range: one of each per ``rows`` rows."""
        spark = df.sparkSession
        path = path or f"{checkpoint_dir(spark).rstrip('/')}/pages/{uuid.uuid4().hex[:16]}"
        n = max(1, -(-df.count() // rows))
        (df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(RANGE, F.spark_partition_id())
         .write.partitionBy(RANGE).parquet(path))
        return cls.open(spark, path, order, df.schema)

    @classmethod
    def open(cls, spark: SparkSession, path: str, order: Sequence[str], schema: StructType) -> OrderedPages:
        """A written copy; ``schema`` is that of its rows."""
        key = F.struct(*order)
        schema = StructType([*schema.fields, StructField(RANGE, IntegerType())])
        index = (spark.read.schema(schema).parquet(path).groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first"))
                 .orderBy(RANGE).collect())
        upto, total = [], 0
        for r in index:
            total += r["n"]
            upto.append(total)
        return cls(spark, path, schema, list(order), [r[RANGE] for r in index], upto, [_comparable(r["first"]) for r in index])

    @property
    def count(self) -> int:
        return self.upto[-1] if self.upto else 0

    def _read(self, a: int, z: int) -> DataFrame:
        df = self.spark.read.schema(self.schema).parquet(self.path)
        return df.where(F.col(RANGE).isin(self.ranges[a:z])).drop(RANGE)  # a filter on folders

    def page(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit`` in order."""
        a = bisect.bisect_right(self.upto, offset)
        z = bisect.bisect_left(self.upto, offset + limit) + 1
        before = self.upto[a - 1] if a else 0
        return self._read(a, z).orderBy(*self.order).offset(offset - before).limit(limit)

    def after(self, key: Row | Sequence, limit: int) -> DataFrame:
        """The ``limit`` rows after the one with ``key`` (the values of ``order``), which need not be there any more."""
        key = tuple(key)
        a = max(0, bisect.bisect_right(self.first, _comparable(key)) - 1)
        passed = self.upto[a - 1] if a else 0
        inside = self.upto[a] - passed if self.upto else 0
        z = bisect.bisect_left(self.upto, passed + inside + limit) + 1
        larger = F.lit(False)
        for i in reversed(range(len(self.order))):
            c, v = F.col(self.order[i]), F.lit(key[i])
            if key[i] is None:
                larger = c.isNotNull() | (c.isNull() & larger)
            else:
                larger = F.coalesce(c > v, F.lit(False)) | (F.coalesce(c == v, F.lit(False)) & larger)
        return self._read(a, z).where(larger).orderBy(*self.order).limit(limit)
