"""Every registered query against its DuckDB oracle on the smallest tables (the driver's gate runs
the same comparison at sf0.01)."""

import hashlib
import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from riskstream.config import DAILY
from riskstream.sources.tables import TABLES

from conftest import SF_SMALL


def _norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if hasattr(v, "as_tuple"):
        return repr(round(float(v), 6))
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def _digest(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return hashlib.sha256("\n".join(sorted("|".join(_norm(r[i]) for i in order) for r in rows)).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(n for n in E.oracle_sql() if not n.startswith(("op", "pipeline"))))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(rows) == len(orows)
    assert _digest(df.columns, rows) == _digest(ocols, orows)


ROWS_ONLY = sorted(n for n in set(E.queries()) - set(E.oracle_sql()) if not n.startswith(("op", "pipeline")))


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_model_queries_against_their_alerts(spark, name):
    """No SQL gives a fitted forest: its queries are held against the alerts that they score (see test_iforest too)."""
    df = E.queries()[name](spark, SF_SMALL)
    alerts = E.queries()["alert_features"](spark, SF_SMALL)
    if name == "iforest_fit":
        trees = df.groupBy("tree").agg(
            F.count_if(F.col("feature") < 0).alias("leaves"), F.count_if(F.col("feature") >= 0).alias("inner"),
            F.sum(F.when(F.col("feature") < 0, F.col("size"))).alias("rows"), F.max("depth").alias("depth")).collect()
        psi = min(DAILY.max_samples, alerts.count())
        assert len(trees) == DAILY.n_trees
        assert all(t["leaves"] == t["inner"] + 1 and t["rows"] == psi and t["depth"] <= math.ceil(math.log2(psi)) for t in trees)
    elif name == "ml_hits":
        assert 0 < df.count() < alerts.count() and df.where("not ml_score > 0 or ml_severity is null").isEmpty()
    else:
        keys = ["dimension", "dimension_key", "window_start"]
        assert df.count() == alerts.count() == df.select(keys).distinct().count()
        assert df.select(keys).exceptAll(alerts.select(keys)).isEmpty()


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "score" in df.columns
