"""Deep pages: right rows from the ranges they lie in."""

import pytest
from pyspark.sql import functions as F

from riskstream.operators.pages import OrderedPages


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.range(10_000).select(F.expr("case when id % 500 = 0 then null else pmod(xxhash64(id), 700) end").alias("position"),
                                    F.concat(F.lit("t"), "id").alias("transaction_id"), (F.col("id") * 2).alias("x"))
    want = df.collect()
    want.sort(key=lambda r: (r.position is not None, r.position or 0, r.transaction_id))
    return OrderedPages.write(df, ["position", "transaction_id"], rows=1000), want


def read_rows(df):
    """Rows that the scan of a query gave."""
    df.collect()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_pages_at_any_offset(pages):
    p, want = pages
    assert p.count == len(want) and len(p.ranges) == 10
    for offset, limit in ((0, 50), (990, 40), (5000, 50), (9_980, 50), (20_000, 5), (3, 2500)):
        assert p.page(offset, limit).collect() == want[offset:offset + limit]


def test_a_page_reads_one_or_two_ranges(pages, spark):
    p, want = pages
    most = max(z - a for a, z in zip([0, *p.upto], p.upto))
    assert most < 2500
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        inside = p.upto[5] - 200
        assert read_rows(p.page(inside, 50)) == p.upto[5] - p.upto[4] and p.page(inside, 50).collect() == want[inside:inside + 50]
        assert read_rows(p.page(p.upto[5] - 20, 50)) == p.upto[6] - p.upto[4]
        key = want[inside]
        assert read_rows(p.after((key.position, key.transaction_id), 50)) <= 2 * most
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_the_page_after_a_key(pages):
    p, want = pages
    for i in (0, 5, 19, 20, 999, 5432, 9_990, 9_999):
        assert p.after((want[i].position, want[i].transaction_id), 30).collect() == want[i + 1:i + 31]
    gone = (want[700].position, want[700].transaction_id + "!")  # a row that is not there
    assert p.after(gone, 3).collect() == want[701:704]


def test_an_empty_table(spark):
    p = OrderedPages.write(spark.createDataFrame([], "position long, transaction_id string"), ["position", "transaction_id"])
    assert p.count == 0 and p.page(0, 50).collect() == [] and p.after((1, "a"), 5).collect() == []
