"""The batch job writes every core table and its outputs agree with the registered queries."""

import importlib.util
import os

from riskstream.config import DAILY

from conftest import SF_SMALL


def _job():
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts", "daily_job.py")
    spec = importlib.util.spec_from_file_location("daily_job", path)
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    return mod


def test_daily_job(spark, workdir):
    import __spark_entry__ as E

    counts = _job().run(spark, SF_SMALL, os.path.join(workdir, "out"), DAILY)
    assert counts["alerts"] == E.queries()["velocity_alerts"](spark, SF_SMALL).count()
    assert counts["scored_alerts"] == counts["alerts"]
    assert counts["rings"] == E.queries()["fraud_rings"](spark, SF_SMALL).count()
    assert counts["user_best_ring"] == E.queries()["user_best_ring"](spark, SF_SMALL).count()
    routes = {r[0] for r in spark.read.parquet(os.path.join(workdir, "out", "scored_alerts"))
              .select("routing").distinct().collect()}
    assert routes <= {"block", "review", "allow"}
