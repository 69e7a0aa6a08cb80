"""Registered queries: the Structured Streaming twins (run to completion on the available files)."""

from __future__ import annotations

from riskstream.plans.fixture_sql import with_fx
from riskstream.plans.q_feedback import _PENDING
from riskstream.plans.q_velocity import CFG, WA, W
from riskstream.plans.registry import query
from riskstream.streaming.velocity_stream import stream_velocity_windows


@query("stream_velocity", with_fx("SELECT * FROM windows", "fx_transactions", extra=W))
def q_stream_velocity(spark, sf):
    """Update-mode streaming aggregate; the current table equals the batch windows."""
    return stream_velocity_windows(spark, sf, CFG)


@query("stream_alerts", with_fx("SELECT * FROM alerts", "fx_transactions", extra=WA))
def q_stream_alerts(spark, sf):
    """Threshold filter on the update stream; the latest row per window equals the final alert."""
    return stream_velocity_windows(spark, sf, CFG, alerts_only=True)


@query("stream_alerts_final", with_fx(f"""
SELECT * FROM alerts
WHERE window_end <= (SELECT epoch_us(max(event_time)) // 1000 FROM fx_transactions) - {24 * 3_600_000}""",
                                      "fx_transactions", extra=WA))
def q_stream_alerts_final(spark, sf):
    """Append mode emits each alert once, when its window has closed behind the 24 h watermark
    (max event time - 24 h); windows still open at the end of the input are held in state."""
    return stream_velocity_windows(spark, sf, CFG, mode="append", alerts_only=True)


@query("stream_review_pending", with_fx("""
SELECT transaction_id, position, score FROM (""" + _PENDING + ") p", "fx_review_events"))
def q_stream_review_pending(spark, sf):
    """I6 streaming: review-queue events replayed in two micro-batches (split at the median sequence)
    through the ``applyInPandasWithState`` queue; the pending items equal the batch queue. Each half is one batch however many
    files it has: the second is written when the stream has read the first, and the stream goes on from its checkpoint."""
    import uuid

    from pyspark.sql import functions as F

    from riskstream.session import checkpoint_dir, materialize
    from riskstream.sources import fixtures as fx
    from riskstream.streaming import velocity_stream as vs

    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-review-{uuid.uuid4().hex[:12]}"
    ev = materialize(fx.fx_review_events(spark, sf).select("transaction_id", "seq", "kind", F.col("score").cast("double")),
                     "review-events")
    cut, n = ev.agg(F.percentile_approx("seq", F.lit(0.5)), F.count("*")).first()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n // 1000)
    for half, rows in ("a", F.col("seq") <= cut), ("b", F.col("seq") > cut):
        ev.where(rows).write.parquet(f"{base}/src/events_{half}.parquet")
        stream = spark.readStream.schema(ev.schema).parquet(f"{base}/src/events_*.parquet")
        vs.run_available(vs.review_queue_stateful(stream, groups=groups), vs.batch_sink(f"{base}/out"), f"{base}/ck")
    cur = vs.latest_by_key(spark, f"{base}/out", ["transaction_id"])
    return cur.where("pending").select("transaction_id", "position", "score")
