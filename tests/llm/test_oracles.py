"""Each query of the subpackage that SQL can express against its DuckDB oracle."""

import duckdb
import pytest

from riskstream.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in cur.description)
    want = [dict(zip([d[0] for d in cur.description], r)) for r in cur.fetchall()]
    got = [r.asDict() for r in QUERIES[name](spark, SF).collect()]
    assert sorted(got[0]) == columns
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got), key=repr) == \
        sorted((tuple(plain(r[c]) for c in columns) for r in want), key=repr)
