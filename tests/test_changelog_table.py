"""The compacted changelog table and the bounded model state of the streams."""

import pytest
from pyspark.sql import functions as F

from riskstream.config import DAILY, REFERENCE
from riskstream.operators import iforest, velocity
from riskstream.sources import files
from riskstream.sources import fixtures as fx
from riskstream.sources.keyed_table import KeyedTable
from riskstream.streaming import velocity_stream as vs

ROW = "k string, n long, v string"


def batch(spark, b, keys):
    return spark.createDataFrame([(f"k{i}", b, f"{b}.{i}") for i in keys], ROW)


def rows(df):
    return sorted(tuple(r) for r in df.select("k", "n", "v").collect())


def test_reading_costs_the_base_and_the_last_batches(spark, workdir):
    t = vs.ChangelogTable(f"{workdir}/t", ["k"], every=3, buckets=4)
    assert t.read(spark) is None
    want = {}
    for b in range(8):
        keys = [b % 4, b + 10, 99]
        t.write(batch(spark, b, keys), b)
        want.update({f"k{i}": (f"k{i}", b, f"{b}.{i}") for i in keys})
        assert rows(t.read(spark)) == sorted(want.values())
        assert len(t._open_batches(spark, t._base(spark))) == (b + 1) % 3
        assert len(vs.batch_ids(spark, f"{workdir}/t/log")) <= 5
    base = KeyedTable.open(spark, f"{workdir}/t/base")
    assert base.batch == 5 and len(files.names(spark, f"{workdir}/t/base/commits")) == 2
    for b in (4, 7):  # replays of a merged and of an open batch
        t.write(batch(spark, b, [b % 4, b + 10, 99]), b)
    assert rows(t.read(spark)) == sorted(want.values())


@pytest.mark.parametrize("step", ["merge", "vacuum", "delete"])
def test_a_crash_while_compacting_loses_nothing(spark, workdir, monkeypatch, step):
    t = vs.ChangelogTable(f"{workdir}/t", ["k"], every=2, buckets=2)
    for b in (0, 1, 2):
        t.write(batch(spark, b, [0, b]), b)

    def die(*a, **k):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "delete":
            m.setattr(vs.files, "delete", die)
        else:
            m.setattr(KeyedTable, step, die)
        with pytest.raises(KeyboardInterrupt):
            t.write(batch(spark, 3, [0, 3]), 3)
    want = sorted([("k0", 3, "3.0"), ("k1", 1, "1.1"), ("k2", 2, "2.2"), ("k3", 3, "3.3")])
    assert rows(t.read(spark)) == want
    t.write(batch(spark, 3, [0, 3]), 3)  # the replay
    assert rows(t.read(spark)) == want


def test_the_streams_current_table_does_not_depend_on_compaction(spark, workdir):
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("event_id < 400")
    for i in range(5):
        ev.where(F.col("event_id") % 5 == i).coalesce(1).write.parquet(f"{workdir}/src/events_{i}.parquet")
    cfg = DAILY.with_(watermark="3000 days")
    got = vs.stream_velocity_windows(spark, f"{workdir}/src", cfg, max_files=1, every=2, work=f"{workdir}/w")
    want = velocity.velocity_windows(fx.transactions_from_events(ev), cfg)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert KeyedTable.open(spark, f"{workdir}/w/sink/base").batch >= 3


ALERT = ("dimension string, window_size string, dimension_key string, txn_count bigint, total_amount double, "
         "window_start bigint, window_end bigint")


def test_pools_give_the_forest_of_the_whole_history(spark, workdir):
    cfg = REFERENCE.with_(n_trees=3, max_samples=8, retrain_interval=300)
    state = vs.ModelState(cfg, f"{workdir}/f", f"{workdir}/m")
    alerts = [spark.range(b * 300, (b + 1) * 300).selectExpr(
        "'USER' dimension", "'1h' window_size", "concat('u', id) dimension_key", "30 + pmod(xxhash64(id), 90) txn_count",
        "cast(pmod(xxhash64(id, 1), 9000) as double) total_amount", "id * 3600000L window_start", "(id + 1) * 3600000L window_end")
        for b in range(4)]
    whole = None
    for b, a in enumerate(alerts):
        state.observe(spark, a, b)
        part = iforest.alert_features(a).select(F.concat_ws("|", *[F.col(c).cast("string") for c in vs.ALERT_KEYS], F.lit(str(b)))
                                                .alias("_k"), *iforest.FEATURES)
        whole = part if whole is None else whole.unionByName(part)
    assert state.seen(spark, 3) == 1200 and state.samples(spark, 1, 2) == 600
    kept = state.pool(spark, 3)
    want = iforest.pool_of(whole, "_k", cfg, 1200)
    assert 100 < kept.count() < 400 and sorted(map(tuple, kept.collect())) == sorted(map(tuple, want.collect()))
    full = iforest.model_version(iforest._trees(whole, cfg, "_k", 1200).toPandas())
    assert state.model_before(spark, 4).version == full
    state.observe(spark, alerts[2], 2)  # a replay of an older batch changes no later state
    assert sorted(map(tuple, state.pool(spark, 3).collect())) == sorted(map(tuple, kept.collect()))
