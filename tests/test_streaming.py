"""Structured Streaming: update = batch, append holds open windows, late rows dropped, restart
without duplicates, routed scoring sink, dead letters."""

import os

from pyspark.sql import functions as F

from riskstream.config import DAILY, REFERENCE
from riskstream.operators import velocity
from riskstream.sources import fixtures as fx
from riskstream.sources import io
from riskstream.streaming import velocity_stream as vs

from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.select(*velocity.ALERT_COLS).collect())


def test_update_equals_batch(spark, workdir):
    got = vs.stream_velocity_windows(spark, SF_SMALL, DAILY, work=os.path.join(workdir, "u"))
    want = velocity.velocity_windows(fx.fx_transactions(spark, SF_SMALL), DAILY)
    assert _rows(got) == _rows(want)


def test_append_holds_open_windows(spark, workdir):
    got = vs.stream_velocity_windows(spark, SF_SMALL, DAILY, mode="append", work=os.path.join(workdir, "a"))
    want = set(_rows(velocity.velocity_windows(fx.fx_transactions(spark, SF_SMALL), DAILY)))
    g = _rows(got)
    assert 0 < len(g) < len(want) and set(g) <= want


def _split_source(spark, workdir):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = os.path.join(workdir, "src")
    late = ev.where(F.col("ts") < F.lit("2024-01-02").cast("timestamp_ntz")).limit(5)
    ev.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).coalesce(1).write.parquet(f"{src}/events.parquet")
    return ev, src, late


def test_late_rows_dropped(spark, workdir):
    """Rows more than the 24 h watermark behind are dropped. Spark checks late rows against the
    watermark of the previous batch, so the late file is the third micro-batch."""
    ev, src, late = _split_source(spark, workdir)
    ev.where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz")).limit(3).coalesce(1) \
        .write.parquet(f"{src}/events_b.parquet")
    late.coalesce(1).write.parquet(f"{src}/events_c.parquet")
    work = os.path.join(workdir, "w")
    tx = fx.transactions_from_events(vs.events_stream(spark, src, max_files=1))
    q = vs.run_available(vs.velocity_updates(tx, DAILY), vs.batch_sink(f"{work}/sink"), f"{work}/ck")
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for s in p["stateOperators"])
    assert len(q.recentProgress) == 3 and dropped > 0
    cur = vs.latest_by_key(spark, f"{work}/sink", vs.ALERT_KEYS)
    assert cur.where(F.col("window_start") == 1704067200000).count() == 0  # 2024-01-01 never aggregated


def test_restart_no_duplicates(spark, workdir):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    src = os.path.join(workdir, "src")
    ts = F.col("ts")
    ev.where((ts >= F.lit("2024-01-20").cast("timestamp_ntz")) & (ts < F.lit("2024-01-29").cast("timestamp_ntz"))) \
        .coalesce(1).write.parquet(f"{src}/events.parquet")
    work = os.path.join(workdir, "r")
    vs.stream_velocity_windows(spark, src, DAILY, work=work)
    first = spark.read.parquet(f"{work}/sink").count()
    vs.stream_velocity_windows(spark, src, DAILY, work=work)  # restart, nothing new: no batch, no duplicates
    assert spark.read.parquet(f"{work}/sink").count() == first
    # on-time data after the restart continues the same windows from the checkpointed state
    ev.where(ts >= F.lit("2024-01-28").cast("timestamp_ntz")).where(ts >= F.lit("2024-01-29").cast("timestamp_ntz")) \
        .coalesce(1).write.parquet(f"{src}/events_more.parquet")
    got = vs.stream_velocity_windows(spark, src, DAILY, work=work)
    want = velocity.velocity_windows(fx.transactions_from_events(ev.where(ts >= F.lit("2024-01-20").cast("timestamp_ntz"))),
                                     DAILY)
    assert _rows(got) == _rows(want)


def test_scoring_sink_routes(spark, workdir):
    tx = fx.fx_transactions(spark, SF_SMALL)
    alerts = velocity.velocity_alerts(tx, DAILY)
    out = os.path.join(workdir, "scored")
    vs.scoring_sink(spark, out, DAILY)(alerts, 0)
    vs.scoring_sink(spark, out, DAILY)(alerts, 0)  # replay of the same batch: overwritten, not duplicated
    back = spark.read.parquet(out)
    assert back.count() == alerts.count()
    assert {r[0] for r in back.select("routing").distinct().collect()} <= {"block", "review", "allow"}


def test_dead_letters(spark):
    lines = spark.createDataFrame(
        [('{"transaction_id":"t1","user_id":"u","amount":1.5,"timestamp":"2026-01-15T10:30:00+00:00"}',),
         ('{"transaction_id":"t2","amount":"abc"}',), ('{"transaction_id":"t3"',), ("{}",)], "value string")
    good, bad = io.decode_json(lines, io.TRANSACTION_JSON)
    g = io.coerce_transactions(good).collect()
    assert [r["transaction_id"] for r in g] == ["t1"] and g[0]["currency"] == "USD"
    assert str(g[0]["event_time"]) == "2026-01-15 10:30:00"
    assert sorted(r["reason"] for r in bad.collect()) == ["malformed", "malformed", "missing_field"]


def test_review_queue_stream_handler(spark, workdir):
    log = os.path.join(workdir, "rq")
    h = vs.review_queue_sink(spark, log)
    schema = "transaction_id string, seq long, kind string, score double"
    h(spark.createDataFrame([("t1", 1, "item", 0.5), ("t2", 2, "item", 0.4)], schema), 0)
    h(spark.createDataFrame([("t2", 3, "review", None), ("t3", 4, "item", 0.3)], schema), 1)
    h(spark.createDataFrame([("t2", 3, "review", None), ("t3", 4, "item", 0.3)], schema), 1)  # replay
    got = [r["transaction_id"] for r in vs.pending_reviews(spark, log).orderBy("position").collect()]
    assert got == ["t1", "t3"]


def test_result_coercion_keeps_scores_on_one_scale(spark):
    lines = spark.createDataFrame([('{"transaction_id":"t1","score":0.42,"routed_to":"human-review"}',),
                                   ('{"transaction_id":"t2","score":84.0}',), ('{"transaction_id":"t3","score":1e9}',), ('{"transaction_id":"t5","score":1}',),
                                   ('{"transaction_id":"t4","score":-1}',)], "value string")
    good, _ = io.decode_json(lines, io.FRAUD_RESULT_JSON)
    r = {x["transaction_id"]: x for x in io.coerce_results(good).collect()}
    assert r["t1"]["reasons"] == [] and float(r["t1"]["score"]) == 0.42 and r["t1"]["is_fraud"] is False
    assert r["t2"]["score"] is None and r["t3"]["score"] is None and r["t4"]["score"] is None and float(r["t5"]["score"]) == 1
    r = {x["transaction_id"]: x["score"] for x in io.coerce_results(good, scale=100).collect()}
    assert float(r["t2"]) == 0.84 and float(r["t5"]) == 0.01 and r["t3"] is None and r["t4"] is None


def test_alert_messages_in_either_case(spark):
    lines = spark.createDataFrame([
        ('{"DIMENSION":"IP","DIMENSION_KEY":"1.2.3.4","TXN_COUNT":3,"TOTAL_AMOUNT":12.5,"WINDOW_START":0,"WINDOW_END":9}',),
        ('{"dimension":"USER","Dimension_Key":"u","txn_count":"x"}',), ('{"dimension":"USER"}',), ("not json",), (None,),
        ('{"DIMENSION":"IP","dimension":"USER","dimension_key":"u","txn_count":1}',)], "value string")
    good, bad = io.alerts_of(lines)
    assert [(r["dimension"], r["dimension_key"], r["txn_count"], r["total_amount"]) for r in good.collect()] == \
        [("IP", "1.2.3.4", 3, 12.5), ("USER", "u", 1, None)]
    assert sorted(r["reason"] for r in bad.collect()) == ["bad_value", "malformed", "malformed", "missing_field"]


def test_stream_survives_bad_messages(spark, workdir):
    """One impossible amount, one unreadable time and one broken line: the windows hold the others, the rest is kept."""
    src = os.path.join(workdir, "lines")
    body = '{"transaction_id":"t%d","user_id":"u","amount":%s,"timestamp":"%s"}'
    lines = [body % (i, "10.0", "2026-01-15T10:00:0%d" % i) for i in range(4)]
    lines += [body % (9, "1e300", "2026-01-15T10:00:00"), body % (8, "5.0", "soon"), "{broken", body % (7, "1e12", "2026-01-15T10:00:00")]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    tx, dead = io.transactions_of(spark.readStream.schema("value string").text(src))
    out, letters = os.path.join(workdir, "out"), os.path.join(workdir, "dead")
    vs.run_available(vs.velocity_updates(tx, REFERENCE), vs.batch_sink(out), os.path.join(workdir, "ck1"))
    vs.run_available(dead, vs.json_sink(letters, "reason"), os.path.join(workdir, "ck2"), "append")
    got = vs.latest_by_key(spark, out, vs.ALERT_KEYS).where("dimension = 'USER'").first()
    assert got["txn_count"] == 5 and got["total_amount"] == 40.0 + 1e12
    assert sorted(r["key"] for r in spark.read.json(letters).collect()) == ["bad_amount", "bad_timestamp", "malformed"]


def test_json_sink_keeps_keys_and_is_idempotent(spark, workdir):
    out = os.path.join(workdir, "topic")
    write = vs.json_sink(out, "transaction_id")
    rows = spark.createDataFrame([("t1", 0.5), ("t2", None)], "transaction_id string, score double")
    write(rows, 0)
    write(rows, 0)  # replay
    got = {r["key"]: r["value"] for r in spark.read.json(out).collect()}
    assert got == {"t1": '{"transaction_id":"t1","score":0.5}', "t2": '{"transaction_id":"t2"}'}
    assert spark.read.json(out).count() == 2


def test_online_model_across_batches(spark, workdir):
    """I8/K5: the scorer fits after min_training_samples alerts and scores later batches with it; a replayed batch or a
    restarted driver gives equal models, counts and rows."""
    cfg = REFERENCE.with_(min_training_samples=50, retrain_interval=100, n_trees=10)
    rows = [("USER", "1h", f"u{i}", 30 + i % 7, 100.0 + i, 0, 3_600_000) for i in range(180)]
    schema = ("dimension string, window_size string, dimension_key string, txn_count bigint, total_amount double, "
              "window_start bigint, window_end bigint")
    feat, models, out = (os.path.join(workdir, x) for x in ("feat", "m", "scored"))
    batches = [spark.createDataFrame(rows[i:i + 60], schema) for i in (0, 60, 120)]
    model = vs.ModelState(cfg, feat, models)
    sink = vs.scoring_sink(spark, out, cfg, model=model)
    assert model.model_before(spark, 0) is None

    def scored(b):
        return sorted(map(tuple, spark.read.parquet(f"{out}/batch_id={b}").collect()), key=repr)

    for b, df in enumerate(batches):
        sink(df, b)
    first = model.model_before(spark, 1).version
    assert {r[0] for r in spark.read.parquet(f"{out}/batch_id=1").select("model_version").distinct().collect()} == {first}
    assert vs.batch_ids(spark, models, "meta/_SUCCESS") == [0, 2]  # 60, then 120 since the first fit
    assert model.model_before(spark, 2).version == first != model.model_before(spark, 3).version
    before = [scored(b) for b in range(3)]
    again = vs.ModelState(cfg, feat, models)  # a restarted driver, and every batch once more
    sink = vs.scoring_sink(spark, out, cfg, model=again)
    for b in (2, 0, 1, 2):
        sink(batches[b], b)
    assert [scored(b) for b in range(3)] == before
    assert again.samples(spark, 0, 2) == 180 and vs.batch_ids(spark, models, "meta/_SUCCESS") == [0, 2]


def test_model_folder_without_meta_is_ignored(spark, workdir):
    models = os.path.join(workdir, "m")
    spark.range(1).write.parquet(f"{models}/batch_id=4/nodes")
    assert vs.ModelState(REFERENCE, os.path.join(workdir, "f"), models).model_before(spark, 9) is None


def test_retrain_trigger(spark, workdir):
    import datetime as dt

    cfg = REFERENCE.with_(feedback_retrain_threshold=3)
    fb, ev = os.path.join(workdir, "fb"), os.path.join(workdir, "ev")
    t, fits = dt.datetime(2024, 1, 1), []
    mk = lambda ids: spark.createDataFrame(
        [(f"f{i}", t + dt.timedelta(minutes=i)) for i in ids], "feedback_id string, created_at timestamp_ntz")

    def refit(labels):
        fits.append(sorted(r["feedback_id"] for r in labels.collect()))
        return "model" if len(fits) != 1 else None

    h = vs.retrain_trigger(spark, cfg, fb, ev, refit)
    h(mk([10, 20]), 0)
    assert fits == []
    h(mk([30]), 1)  # the first fit fails: no event
    assert fits == [["f10", "f20", "f30"]] and vs.batch_ids(spark, ev) == []
    h(mk([5]), 2)  # a late label, older than all others, counts
    assert fits[1] == ["f10", "f20", "f30", "f5"]
    e = spark.read.parquet(ev).first()
    assert e["event"] == "model_retrained" and e["feedback_count"] == e["samples_used"] == 4
    h(mk([40]), 3)
    h(mk([5]), 2)  # a replay: the same decision and one event
    assert len(fits) == 3 and fits[2] == fits[1] and spark.read.parquet(ev).count() == 1
    vs.retrain_trigger(spark, cfg, fb, ev, refit)(mk([1, 2]), 4)  # a restarted driver goes on from the event's batch
    assert fits[3] == ["f1", "f2", "f40"] and spark.read.parquet(ev).count() == 2


def test_refit_uses_the_labels_windows(spark, workdir):
    tx_path = os.path.join(workdir, "tx")
    fx.fx_transactions(spark, SF_SMALL).write.parquet(tx_path)
    cfg = DAILY.with_(min_training_samples=20, n_trees=5)
    forest = vs.refit_on_labels(spark, tx_path, cfg, os.path.join(workdir, "m"))(fx.fx_feedback(spark, SF_SMALL))
    assert forest is not None and forest.nodes["tree"].nunique() == 5
    assert vs.iforest.Forest.load(os.path.join(workdir, "m", forest.version), spark).version == forest.version


def test_review_queue_stateful_equals_batch(spark, workdir):
    """The stateful streaming queue (events arriving in two micro-batches, one replayed) ends in the
    same pending set, positions and payloads as the batch operator."""
    from riskstream.operators.state import review_pending

    ev = fx.fx_review_events(spark, SF_SMALL).select(
        "transaction_id", "seq", "kind", F.col("score").cast("double").alias("score"))
    src = os.path.join(workdir, "rq-src")
    cut = ev.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    ev.where(F.col("seq") <= cut).coalesce(1).write.parquet(f"{src}/events_a.parquet")
    ev.where(F.col("seq") > cut).coalesce(1).write.parquet(f"{src}/events_b.parquet")
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{src}/events_*.parquet")
    out = os.path.join(workdir, "rq-out")
    q = vs.run_available(vs.review_queue_stateful(stream), vs.batch_sink(out), os.path.join(workdir, "rq-ck"))
    assert len([p for p in q.recentProgress if p["numInputRows"] > 0]) == 2
    cur = vs.latest_by_key(spark, out, ["transaction_id"]).where("pending")
    got = sorted((r["transaction_id"], r["position"], r["score"]) for r in cur.collect())
    want = sorted((r["transaction_id"], r["position"], float(r["score"]) if r["score"] is not None else None)
                  for r in review_pending(ev).collect())
    assert got == want


class _State:
    hasTimedOut = False
    timeout = None

    def __init__(self):
        self.value = None

    def setTimeoutTimestamp(self, ms):
        self.timeout = ms

    def getCurrentWatermarkMs(self):
        return 0

    def remove(self):
        self.value = None

    @property
    def exists(self):
        return self.value is not None

    @property
    def get(self):
        return self.value

    def update(self, v):
        self.value = v


def test_review_state_order_insensitive():
    import pandas as pd

    def step(state, rows):
        pdf = pd.DataFrame(rows, columns=["transaction_id", "seq", "kind", "score"])
        pdf["at_ms"] = pdf["seq"]
        return next(vs._review_step(("t1",), iter([pdf]), state)).iloc[0]

    st = _State()
    out = step(st, [("t1", 30, "item", 0.7)])                        # re-arrival seen first
    assert out["pending"] and out["position"] == 30
    out = step(st, [("t1", 10, "item", 0.5), ("t1", 30, "item", 0.7)])  # original arrives late + replay
    assert out["position"] == 10 and out["score"] == 0.7
    out = step(st, [("t1", 20, "review", None)])                     # late review between the two
    assert out["pending"] and out["position"] == 30 and out["score"] == 0.7
    st.hasTimedOut = True  # nobody looked at it for long: it stays
    assert list(vs._review_step(("t1",), iter([]), st)) == [] and st.exists and st.timeout == vs.REVIEW_TTL_MS
    st.hasTimedOut = False
    out = step(st, [("t1", 40, "review", None)])
    assert not out["pending"] and out["position"] is None
    st.hasTimedOut = True
    assert list(vs._review_step(("t1",), iter([]), st)) == [] and not st.exists


def test_review_states_of_a_group():
    """A call handles all transactions of a group, each with its own status and its own timeout."""
    import pandas as pd

    st, now = _State(), 0
    st.getCurrentWatermarkMs = lambda: now

    def step(*rows):
        pdf = pd.DataFrame(rows, columns=["transaction_id", "seq", "kind", "score"])
        out = [p for p in vs._review_step((0,), iter([pdf.assign(at_ms=pdf["seq"])] if rows else []), st)]
        return {r["transaction_id"]: (r["pending"], r["position"], r["score"]) for p in out for _, r in p.iterrows()}

    assert step(("a", 10, "item", 0.5), ("b", 11, "item", 0.4), ("a", 12, "item", 0.6), (None, 13, "item", None)) == {
        "a": (True, 10, 0.6), "b": (True, 11, 0.4), None: (True, 13, None)}
    assert step(("b", 20, "review", None)) == {"b": (False, None, None)} and st.timeout == 13
    now, st.hasTimedOut = 14, True  # a waits and stays, b has until 21
    assert step() == {} and sorted(st.value[0], key=str) == [None, "a", "b"] and st.timeout == 14
    now, st.hasTimedOut = 30, False  # b goes though the group is called for another one
    assert step(("c", 31, "item", 0.9)) == {"c": (True, 31, 0.9)} and sorted(st.value[0], key=str) == [None, "a", "c"]
    assert step(("a", 40, "review", None), ("c", 40, "review", None), (None, 40, "review", None)).keys() == {"a", "c", None}
    now, st.hasTimedOut = 50, True
    assert step() == {} and not st.exists


def test_review_query_replays_two_batches(spark, workdir, monkeypatch):
    """However many files a half has."""
    from riskstream.plans.q_feedback import q_review_pending
    from riskstream.plans.q_stream import q_stream_review_pending

    rows = [(i, 3_600 * i, i % 7, "error" if i % 4 == 0 else "view", float(i * 13 % 300), '{"k": 1}') for i in range(400)]
    ev = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double, props string")
    ev = ev.select("event_id", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, s)").alias("ts"),
                   "user_id", "event_type", "value", "props")
    for i in range(3):
        ev.where(F.col("event_id") % 3 == i).coalesce(1).write.mode("append").parquet(f"{workdir}/events.parquet")
    batches, run = [], vs.run_available

    def counted(*args, **kw):
        q = run(*args, **kw)
        batches.extend(p["numInputRows"] for p in q.recentProgress if p["numInputRows"] > 0)
        return q

    monkeypatch.setattr(vs, "run_available", counted)
    got = sorted(map(tuple, q_stream_review_pending(spark, workdir).collect()))
    want = sorted(map(tuple, q_review_pending(spark, workdir).select("transaction_id", "position", "score").collect()))
    assert got == want and len(want) > 20
    assert len(batches) == 2


def test_parse_iso_variants(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2026-01-15T10:30:00+00:00",), ("2026-01-15T10:30:00Z",), ("2026-01-15T10:30:00",),
                                ("2026-01-15 10:30:00.250000",), ("not a time",)], "s string")
    got = [None if r[0] is None else str(r[0]) for r in df.select(io.parse_iso(F.col("s"))).collect()]
    assert got == ["2026-01-15 10:30:00", "2026-01-15 10:30:00", "2026-01-15 10:30:00", "2026-01-15 10:30:00.250000", None]


def test_parse_iso_offset(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2026-01-15T12:30:00+02:00",)], "s string")
    assert str(df.select(io.parse_iso(F.col("s"))).first()[0]) == "2026-01-15 10:30:00"


def test_a_message_that_comes_again_counts_once(spark, workdir):
    """Copies in one batch, in later batches and after a restart."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").where("event_id < 60")
    src, cfg = os.path.join(workdir, "src"), DAILY.with_(watermark="3000 days")
    ev.unionByName(ev.where("event_id % 7 = 0")).coalesce(1).write.parquet(f"{src}/events_a.parquet")
    ev.where("event_id % 2 = 0").coalesce(1).write.parquet(f"{src}/events_b.parquet")

    def run():
        tx = vs.distinct_transactions(fx.transactions_from_events(vs.events_stream(spark, src, max_files=1)), cfg)
        out = tx.select("transaction_id", "event_time", "_at")
        vs.run_available(out, vs.batch_sink(f"{workdir}/out"), f"{workdir}/ck", "append")

    run()
    ev.where("event_id % 3 = 0").coalesce(1).write.parquet(f"{src}/events_c.parquet")
    run()
    got = [r[0] for r in spark.read.parquet(f"{workdir}/out").select("transaction_id").collect()]
    assert len(got) == len(set(got)) == ev.count()


def test_windows_of_distinct_messages(spark, workdir):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").where("event_id < 60")
    src, cfg = os.path.join(workdir, "src"), DAILY.with_(watermark="1 days")
    for x in "ab":
        ev.coalesce(1).write.parquet(f"{src}/events_{x}.parquet")
    # a message behind the watermark closes nothing again; one far ahead closes all windows
    ahead = ev.limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 900 DAYS")).withColumn("event_id", F.lit(99_999).cast("long"))
    ahead.coalesce(1).write.parquet(f"{src}/events_c.parquet")
    tx = vs.distinct_transactions(fx.transactions_from_events(vs.events_stream(spark, src)), cfg)
    vs.run_available(vs.velocity_updates(tx, cfg), vs.batch_sink(f"{workdir}/out"), f"{workdir}/ck", "append")
    cols = ["dimension", "dimension_key", "window_start", "txn_count", "total_amount"]
    want = velocity.velocity_windows(fx.transactions_from_events(ev), cfg).select(*cols).collect()
    assert sorted(map(tuple, spark.read.parquet(f"{workdir}/out").select(*cols).collect())) == sorted(map(tuple, want))


def test_review_states_follow_an_event_time_column(spark, workdir):
    """A sequence that is no time: states live by the column."""
    rows = [("t1", 1, "item", 0.5, 1_700_000_000), ("t2", 2, "item", 0.4, 1_700_000_100), ("t1", 3, "review", None, 1_700_000_200),
            ("t2", 2, "item", 0.4, 1_700_000_100)]
    df = spark.createDataFrame(rows, "transaction_id string, seq long, kind string, score double, s long").withColumn(
        "at", F.timestamp_seconds("s")).drop("s")
    for i in range(4):
        df.where(F.col("seq") == rows[i][1]).limit(1).coalesce(1).write.parquet(f"{workdir}/src/events_{i}.parquet")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{workdir}/src/events_*.parquet")
    vs.run_available(vs.review_queue_stateful(stream, "at"), vs.batch_sink(f"{workdir}/out"), f"{workdir}/ck")
    cur = vs.latest_by_key(spark, f"{workdir}/out", ["transaction_id"]).where("pending")
    assert [(r["transaction_id"], r["position"], r["score"]) for r in cur.collect()] == [("t2", 2, 0.4)]


def test_messages_of_a_key_are_in_order(spark, workdir):
    import glob
    import json

    df = spark.range(3000).selectExpr("case when id % 3 = 0 then 'hot' else concat('k', id % 40) end k", "pmod(xxhash64(id), 100000) at", "id")
    vs.json_sink(f"{workdir}/out", "k", "at")(df, 0)
    seen, files_of = {}, {}
    for f in sorted(glob.glob(f"{workdir}/out/batch_id=0/part-*")):
        for line in open(f):
            m = json.loads(line)
            seen.setdefault(m["key"], []).append(json.loads(m["value"])["at"])
            files_of.setdefault(m["key"], set()).add(f)
    assert sum(map(len, seen.values())) == 3000 and all(v == sorted(v) for v in seen.values())


def test_inserts_count_once(spark, workdir):
    path = f"{workdir}/metrics"
    sink = vs.append_sink(path, ("arm",))
    rows = lambda a, n: spark.range(n).selectExpr(f"'{a}' arm", "id")
    sink(rows("a", 5), 0)
    sink(rows("b", 3), 1)
    sink(rows("b", 3), 1)  # a replay
    assert sorted((r["arm"], r["count"]) for r in spark.read.parquet(path).groupBy("arm").count().collect()) == [("a", 5), ("b", 3)]
    io.append(rows("c", 2), f"{workdir}/plain")
    io.append(rows("c", 2), f"{workdir}/plain")
    assert spark.read.parquet(f"{workdir}/plain").count() == 4
