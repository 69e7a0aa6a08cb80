"""Batch job: compute and write the core tables for one input folder.

    python scripts/daily_job.py <input_dir> <output_dir> [--profile daily|reference] [--cores N]

Writes (parquet, overwrite):
  alerts/          velocity alerts, partitioned by window day
  scored_alerts/   scored alerts (reasons as text), partitioned by routing
  rings/           shared-resource rings;  ring_members/  membership;  user_best_ring/
  fraud_results/   one result per transaction inside an alerting window
  dashboard/       the dashboard snapshot (long form)
With ``--cores`` the session is sized by ``cluster_conf`` from ``--input-bytes``.
"""

from __future__ import annotations

import argparse
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from riskstream.config import DAILY, REFERENCE  # noqa: E402
from riskstream.operators import dashboard, graph, scoring, state, velocity  # noqa: E402
from riskstream.session import build_session, checkpoint_dir, cluster_conf, materialize  # noqa: E402
from riskstream.sources import fixtures as fx  # noqa: E402


def run(spark, src: str, out: str, cfg) -> dict:
    tx = fx.fx_transactions(spark, src)
    alerts = materialize(velocity.velocity_alerts(tx, cfg), "job-alerts")  # read by scoring and the write
    alerts.withColumn("day", F.to_date(F.timestamp_millis("window_start"))).write.mode("overwrite") \
        .partitionBy("day").parquet(f"{out}/alerts")
    pairs = materialize(graph.resource_users(tx), "job-pairs")
    rings = graph.fraud_rings(tx, cfg, pairs)
    rings.drop("first_seen", "last_seen").write.mode("overwrite").parquet(f"{out}/rings")
    graph.ring_members(tx, cfg, pairs, rings).select("ring_id", "user_id", "first_use") \
        .write.mode("overwrite").parquet(f"{out}/ring_members")
    best = graph.user_best_ring(tx, cfg, pairs)
    best.write.mode("overwrite").parquet(f"{out}/user_best_ring")
    bl = state.set_from_log(fx.fx_blacklist_ops(spark, src))
    scored = scoring.score_alerts(alerts, cfg, blacklist=bl, user_rings=spark.read.parquet(f"{out}/user_best_ring"))
    scored = materialize(scored, "job-scored")  # read by the write and the results
    scored.select(*velocity.ALERT_COLS, "score", "routing", F.array_join("reasons", " | ").alias("reasons")) \
        .write.mode("overwrite").partitionBy("routing").parquet(f"{out}/scored_alerts")
    results = scoring.fraud_results(tx, scored, cfg, spark.read.parquet(f"{out}/user_best_ring"))
    results.write.mode("overwrite").parquet(f"{out}/fraud_results")
    results = spark.read.parquet(f"{out}/fraud_results")
    dashboard.snapshot(spark, tx, results, fx.fx_feedback(spark, src),
                       fx.fx_ab_metrics(spark, src), cfg).write.mode("overwrite").parquet(f"{out}/dashboard")
    return {name: spark.read.parquet(f"{out}/{name}").count()
            for name in ["alerts", "scored_alerts", "rings", "ring_members", "user_best_ring", "fraud_results", "dashboard"]}


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("input_dir")
    ap.add_argument("output_dir")
    ap.add_argument("--profile", choices=["daily", "reference"], default="daily")
    ap.add_argument("--cores", type=int, default=0)
    ap.add_argument("--input-bytes", type=int, default=0, help="size of the input, for --cores")
    a = ap.parse_args()
    conf = {}
    if a.cores:
        conf = cluster_conf(a.input_bytes, a.cores)
    spark = build_session(None if a.cores else "local[*]", app="riskstream-daily-job", **conf)
    checkpoint_dir(spark)
    print(run(spark, a.input_dir, a.output_dir, DAILY if a.profile == "daily" else REFERENCE))
    spark.stop()


if __name__ == "__main__":
    main()
