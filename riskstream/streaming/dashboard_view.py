"""The dashboard as a view that each trigger adds its batch to.

A trigger reads its batch of each table and the state of the trigger before it, never the history: the rollup of all grouped
counters (sums, which add up), the 20 newest flagged transactions (the newest of parts are the newest of the whole), the number
of metrics at each latency (from which the exact percentile is refined), the number of feedback rows, and the transactions and
results that still wait for each other. A transaction without a result is counted at once; when its result comes, in whatever
batch, it is taken back and counted with it.

The state of trigger ``b`` is a folder that is valid once its ``meta``, written last, is there. It is made from the newest valid
state before ``b``, so a replayed or interrupted trigger gives the same state and snapshot. Older states can be removed.

Transactions, results, feedback and metrics come once each, as from tables with a primary key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskstream.config import EngineConfig
from riskstream.operators import dashboard as D
from riskstream.operators.quantiles import quantile
from riskstream.session import discard, materialize
from riskstream.streaming.velocity_stream import batch_ids

TX = ["transaction_id", "event_time", "merchant_id", "location"]
RESULT = ["transaction_id", "score", "is_fraud", "routed_to"]


@dataclass
class DashboardView:
    """The view kept under ``path``: ``state/batch_id=N`` and ``snapshot/batch_id=N``."""

    path: str
    cfg: EngineConfig

    def refresh(self, spark: SparkSession, tx: DataFrame, results: DataFrame, feedback: DataFrame, metrics: DataFrame,
                batch_id: int) -> DataFrame:
        """Add one batch of each table, write the snapshot and return it."""
        before = [b for b in batch_ids(spark, f"{self.path}/state", "meta/_SUCCESS") if b < batch_id]
        old = {p: spark.read.parquet(f"{self.path}/state/batch_id={before[-1]}/{p}") for p in
               ("rollup", "flagged", "latency", "waiting_tx", "waiting_results", "meta")} if before else None
        here = f"{self.path}/state/batch_id={batch_id}"

        t = tx.select(*TX, F.lit(False).alias("counted"))
        r = results.select(*RESULT, F.lit(True).alias("has"))
        if old:
            t = t.unionByName(old["waiting_tx"].withColumn("counted", F.lit(True)))
            r = r.unionByName(old["waiting_results"].withColumn("has", F.lit(True)))
        joined = materialize(t.join(r, "transaction_id", "full_outer"), "dashboard-joined")
        here_tx = joined.where("counted is not null")
        matched = here_tx.where("has")
        rows = matched.withColumn("w", F.lit(1)).unionByName(
            here_tx.where("has is null and not counted").withColumn("w", F.lit(1)))
        taken_back = matched.where("counted").select(*TX, "counted", *[F.lit(None).cast(matched.schema[c].dataType).alias(c)
                                                                      for c in (*RESULT[1:], "has")], F.lit(-1).alias("w"))
        rollup = D.rollup(rows.unionByName(taken_back), self.cfg)
        flagged = D.newest_flagged(matched, self.cfg)
        latency = metrics.where("latency_ms is not null").groupBy("latency_ms").agg(F.count(F.lit(1)).alias("n"))
        n_feedback = feedback.count()
        if old:
            rollup = D.added_rollups(old["rollup"], rollup)
            flagged = D.newest_flagged(flagged.unionByName(old["flagged"]), self.cfg)
            latency = latency.unionByName(old["latency"]).groupBy("latency_ms").agg(F.sum("n").alias("n"))
            n_feedback += old["meta"].first()["n_feedback"]
        meta = spark.createDataFrame([(n_feedback,)], "n_feedback long")
        parts = {"rollup": rollup, "flagged": flagged, "latency": latency,
                 "waiting_tx": here_tx.where("has is null").select(*TX),
                 "waiting_results": joined.where("counted is null").select(*RESULT), "meta": meta}
        for name, part in parts.items():
            part.write.mode("overwrite").parquet(f"{here}/{name}")
        discard(joined)
        g, top, counts = (spark.read.parquet(f"{here}/{p}") for p in ("rollup", "flagged", "latency"))
        snap = D.snapshot_of(spark, g, top, quantile(counts, "latency_ms", 0.95, "n"), n_feedback, self.cfg)
        snap.write.mode("overwrite").parquet(f"{self.path}/snapshot/batch_id={batch_id}")
        return spark.read.parquet(f"{self.path}/snapshot/batch_id={batch_id}")


def refresh_sink(view: DashboardView):
    """foreachBatch writer (e.g. ``processingTime='10 seconds'``) for a stream of tagged rows: ``kind`` is one of ``tx``,
    ``result``, ``feedback`` and ``metric``, and a column of each name holds the row of its table."""

    def handle(events: DataFrame, batch_id: int) -> None:
        part = lambda kind: events.where(F.col("kind") == kind).select(f"{kind}.*")
        view.refresh(events.sparkSession, part("tx"), part("result"), part("feedback"), part("metric"), batch_id)

    return handle


def tagged(tx: DataFrame, results: DataFrame, feedback: DataFrame, metrics: DataFrame) -> DataFrame:
    """The rows of the four tables as one, for :func:`refresh_sink`."""
    tables = {"tx": tx.select(*TX), "result": results.select(*RESULT), "feedback": feedback.select("feedback_id"),
              "metric": metrics.select("latency_ms")}
    out = None
    for kind, df in tables.items():
        rows = df.select(F.lit(kind).alias("kind"), *[
            (F.struct(*d.columns) if k == kind else F.lit(None).cast(d.schema)).alias(k) for k, d in tables.items()])
        out = rows if out is None else out.unionByName(rows)
    return out
