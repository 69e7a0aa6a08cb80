"""Keyed tables: merges of partial updates, crashes, conflicts, replays and lookups."""

import pytest
from pyspark.sql import functions as F

from riskstream.operators import state
from riskstream.sources import files, keyed_table
from riskstream.sources.keyed_table import KeyedTable, MergeConflict

CHANGES = "k string, name string, amount double, place string, seq long"


@pytest.fixture()
def table(spark, workdir):
    schema = spark.createDataFrame([], CHANGES).drop("seq").schema
    return KeyedTable.create(spark, f"{workdir}/t", schema, ["k"], ["amount"], buckets=8)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def data_files(table):
    return {b: f for b, f in table.folders.items()}


def changes(spark, keys, seq, amount=1.0, name="n", place="p"):
    return spark.createDataFrame([(f"k{i}", f"{name}{seq}", amount + seq, f"{place}{seq}", seq) for i in keys], CHANGES)


def test_duplicates_change_only_the_update_columns(spark, table):
    t = table.merge(changes(spark, range(5), 1)).merge(changes(spark, [2, 9], 2))
    assert rows(t.read().where("k = 'k2'")) == [("k2", "n1", 3.0, "p1", 2)]
    assert rows(t.read().where("k = 'k9'")) == [("k9", "n2", 3.0, "p2", 1)]
    assert t.read().count() == 6 and KeyedTable.open(spark, t.path).version == t.version == 2


def test_equals_one_aggregate_over_the_whole_log_in_any_order(spark, table):
    log = [changes(spark, range(0, 40, s), s, amount=s * 10.0) for s in (1, 2, 3, 4)]
    whole = log[0].unionByName(log[1]).unionByName(log[2]).unionByName(log[3])
    want = rows(state.upsert_partial(whole, "k", ["amount"]).select("k", "name", "amount", "place", "n_versions"))
    t = table
    for i in (2, 0, 3, 1):
        t = t.merge(log[i])
    assert rows(t.read()) == want


def test_a_merge_rewrites_only_the_buckets_of_its_keys(spark, table):
    t = table.merge(changes(spark, range(1000), 1))
    before = data_files(t)
    some = changes(spark, [3], 2)
    hit = t.touched(some)
    after = t.merge(some)
    assert len(hit) == 1 and {b for b in before if before[b] != after.folders[b]} == set(hit)
    written = files.names(spark, f"{t.path}/data/{after.folders[hit[0]]}")
    assert [n for n in written if n.startswith("_bucket=")] == [f"_bucket={hit[0]}"]
    assert t.read().where("n_versions > 1").count() == 0  # the older version is still what it was


def test_a_job_that_dies_before_its_commit_leaves_the_old_table(spark, table, monkeypatch):
    t = table.merge(changes(spark, range(20), 1))
    want = rows(t.read())

    def die(*a):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_commit", die)
        with pytest.raises(KeyboardInterrupt):
            t.merge(changes(spark, range(20), 2))
    assert rows(KeyedTable.open(spark, t.path).read()) == want
    files.create_text(spark, f"{t.path}/commits/{t.version + 1:012d}", '{"keys": ["k"')  # died while it wrote the commit
    again = KeyedTable.open(spark, t.path)
    assert again.version == t.version and rows(again.read()) == want
    done = again.merge(changes(spark, range(20), 2))
    assert rows(KeyedTable.open(spark, t.path).read()) == rows(done.read()) and {r[4] for r in rows(done.read())} == {2}
    done.vacuum()
    assert set(files.names(spark, f"{t.path}/data")) == set(done.folders.values())
    assert rows(KeyedTable.open(spark, t.path).read()) == rows(done.read())


def test_the_second_of_two_writers_fails_and_can_merge_again(spark, table):
    one, two = KeyedTable.open(spark, table.path), KeyedTable.open(spark, table.path)
    one.merge(changes(spark, [1], 1))
    with pytest.raises(MergeConflict):
        two.merge(changes(spark, [1], 2))
    t = KeyedTable.open(spark, table.path).merge(changes(spark, [1], 2))
    assert rows(t.read()) == [("k1", "n1", 3.0, "p1", 2)]


def test_a_replayed_batch_is_merged_once(spark, table):
    t = table.merge(changes(spark, range(5), 1), batch_id=0).merge(changes(spark, range(5), 2), batch_id=1)
    assert t.merge(changes(spark, range(5), 2), batch_id=1) is t
    assert {r[4] for r in rows(KeyedTable.open(spark, t.path).read())} == {2}


def test_ties_nulls_and_empty_batches(spark, table):
    t = table.merge(spark.createDataFrame([("a", "x", 1.0, "p", 1), ("a", "y", 2.0, None, 1), (None, "z", 3.0, "p", 1),
                                           ("b", None, None, None, 1)], CHANGES))
    assert rows(t.read()) == [("a", "y", 2.0, None, 2), ("b", None, None, None, 1)]
    assert rows(t.merge(spark.createDataFrame([], CHANGES)).read()) == rows(t.read())
    assert table.read().collect() == [] and table.lookup(spark.createDataFrame([("a",)], "k string")).collect() == []


def test_no_update_column_is_insert_ignore(spark, workdir):
    schema = spark.createDataFrame([], "v string, note string").schema
    t = KeyedTable.create(spark, f"{workdir}/versions", schema, ["v"], buckets=2)
    t = t.merge(spark.createDataFrame([("v1", "seed", 0)], "v string, note string, seq long"))
    t = t.merge(spark.createDataFrame([("v1", "later", 1), ("v2", "b", 3), ("v2", "a", 2)], "v string, note string, seq long"))
    assert rows(t.read().drop("n_versions")) == [("v1", "seed"), ("v2", "a")]
    seed = spark.createDataFrame([("v1", "seed")], "v string, note string")
    new = spark.createDataFrame([("v1", "later", 1), ("v2", "b", 3), ("v2", "a", 2)], "v string, note string, at long")
    assert rows(state.insert_ignore(seed, new, "v", "at")) == [("v1", "seed"), ("v2", "a")]


def read_rows(df):
    """Rows that the scans of an executed query gave."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        m = leaves.apply(i).metrics()
        if m.contains("numOutputRows"):
            total += m.apply("numOutputRows").value()
    return total


def test_a_lookup_reads_a_small_share_of_the_table(spark, workdir, monkeypatch):
    monkeypatch.setattr(keyed_table, "FILTERED_KEYS", 150)
    big = spark.range(200_000).select(F.concat(F.lit("k"), F.lpad("id", 9, "0")).alias("k"), F.rand(1).alias("x"),
                                      F.lit(1).alias("seq"))
    t = KeyedTable.create(spark, f"{workdir}/big", big.drop("seq").schema, ["k"], ["x"], buckets=4, row_group=16 << 10).merge(big)
    wanted = spark.createDataFrame([(f"k{i:09d}",) for i in [*range(0, 200_000, 2020), 999_999]], "k string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = t.lookup(wanted)
        assert got.count() == 100 and read_rows(got) < 0.2 * 200_000 and t.read().count() == 200_000
        few = t.lookup(wanted.limit(1))
        assert read_rows(few) < 0.05 * 200_000 and few.count() == 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    many = t.lookup(spark.range(0, 200_000, 1000).select(F.concat(F.lit("k"), F.lpad("id", 9, "0")).alias("k")))
    assert many.count() == 200


def test_two_keys(spark, workdir):
    schema = spark.createDataFrame([], "a string, b long, x string").schema
    t = KeyedTable.create(spark, f"{workdir}/two", schema, ["a", "b"], ["x"], buckets=4)
    t = t.merge(spark.createDataFrame([("p", i, "x", 1) for i in range(50)], "a string, b long, x string, seq long"))
    t = t.merge(spark.createDataFrame([("p", 7, "y", 2)], "a string, b long, x string, seq long"))
    assert rows(t.lookup(spark.createDataFrame([("p", 7), ("q", 7), ("p", None)], "a string, b long"))) == [("p", 7, "y", 2)]
    with pytest.raises(ValueError):
        KeyedTable.create(spark, f"{workdir}/bad", schema, ["a"], ["a"])
