"""The incremental dashboard: equal to the snapshot of all rows, from the batch and the last state only."""

import shutil

import pytest
from pyspark.sql import functions as F

from riskstream.config import DAILY
from riskstream.operators import dashboard as D
from riskstream.sources import fixtures as fx
from riskstream.streaming import velocity_stream as vs
from riskstream.streaming.dashboard_view import DashboardView, refresh_sink, tagged

from conftest import SF_SMALL


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in
                   df.select("part", "item", "metric", "value", "text").collect()), key=repr)


@pytest.fixture()
def tables(spark):
    n = lambda c: F.regexp_extract(c, "([0-9]+)", 1).cast("long")
    t, r = fx.fx_transactions(spark, SF_SMALL), fx.fx_fraud_results(spark, SF_SMALL)
    f, m = fx.fx_feedback(spark, SF_SMALL), fx.fx_ab_metrics(spark, SF_SMALL)
    # a result comes with its transaction, a batch later, two later, or before it; some never come
    return (t.withColumn("b", n("transaction_id") % 3), r.withColumn("b", F.hash("transaction_id") % 2 + 1),
            f.withColumn("b", n("feedback_id") % 3), m.withColumn("b", n("transaction_id") % 3))


def batch(tables, b):
    return [x.where(F.col("b") == b).drop("b") for x in tables]


def test_equals_the_snapshot_and_reads_no_history(spark, workdir, tables):
    view = DashboardView(f"{workdir}/view", DAILY)
    want = rows(D.snapshot(spark, *[x.drop("b") for x in tables], DAILY))
    for b in range(3):
        if b == 2:  # neither the first state nor its snapshot is read again
            shutil.rmtree(f"{workdir}/view/state/batch_id=0")
            shutil.rmtree(f"{workdir}/view/snapshot/batch_id=0")
        got = view.refresh(spark, *batch(tables, b), b)
    assert rows(got) == want
    again = DashboardView(f"{workdir}/view", DAILY).refresh(spark, *batch(tables, 2), 2)  # replayed by a restarted driver
    assert rows(again) == want


def test_an_interrupted_trigger_does_not_count(spark, workdir, tables):
    view = DashboardView(f"{workdir}/view", DAILY)
    first = rows(view.refresh(spark, *batch(tables, 0), 0))
    spark.range(3).write.parquet(f"{workdir}/view/state/batch_id=1/rollup")  # died before its meta
    everything = [x.where(F.col("b") == 0).drop("b") for x in tables]
    assert first == rows(D.snapshot(spark, *everything, DAILY))
    for b in (1, 2):
        got = view.refresh(spark, *batch(tables, b), b)
    assert rows(got) == rows(D.snapshot(spark, *[x.drop("b") for x in tables], DAILY))


def test_nothing_yet(spark, workdir, tables):
    empty = [x.where("false").drop("b") for x in tables]
    assert rows(DashboardView(f"{workdir}/view", DAILY).refresh(spark, *empty, 0)) == rows(D.snapshot(spark, *empty, DAILY))


def test_as_a_stream(spark, workdir, tables):
    for b in range(3):
        tagged(*batch(tables, b)).coalesce(1).write.parquet(f"{workdir}/src/events_{b}.parquet")
    schema = spark.read.parquet(f"{workdir}/src/events_0.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{workdir}/src/events_*.parquet")
    vs.run_available(stream, refresh_sink(DashboardView(f"{workdir}/view", DAILY)), f"{workdir}/ck", "append")
    last = vs.batch_ids(spark, f"{workdir}/view/state", "meta/_SUCCESS")
    assert len(last) == 3
    got = spark.read.parquet(f"{workdir}/view/snapshot/batch_id={last[-1]}")
    assert rows(got) == rows(D.snapshot(spark, *[x.drop("b") for x in tables], DAILY))
