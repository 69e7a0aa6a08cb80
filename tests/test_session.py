"""Session helpers: shared checkpoint folder, materialisation, path checks, scale sizing."""

import pytest

from riskstream.session import checkpoint_dir, cluster_conf, discard, materialize, path_exists


def test_materialize_under_checkpoint_dir(spark):
    base = checkpoint_dir(spark)
    df = spark.range(100).selectExpr("id", "id * 2 AS x")
    m = materialize(df, "unit")
    files = m.inputFiles()
    assert files and all(base.rstrip("/").split(":")[-1] in f for f in files)
    assert m.count() == 100 and not path_exists(spark, base.rstrip("/") + "/tables/does-not-exist")


def test_discard_removes_the_files(spark):
    m = materialize(spark.range(5), "gone")
    discard(m)
    assert not path_exists(spark, m.materialized_path)


def test_no_private_folder_on_a_cluster():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {"spark.checkpoint.dir": None}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_cluster_conf_sizes():
    c = cluster_conf(100 * 2**40, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 20_480  # 20 TiB shuffled, 1 GiB each
    small = cluster_conf(1 << 20, 8)
    assert int(small["spark.sql.shuffle.partitions"]) == 16  # at least 2 x cores
    assert c["spark.sql.adaptive.enabled"] == "true" and c["spark.sql.adaptive.skewJoin.enabled"] == "true"


def test_written_tables_leave_no_shuffle_files(spark):
    """The shuffle of a write is removed when it ends, and frames that were written can be used again."""
    from riskstream.session import SHUFFLE_CLEANUP, materialize

    def files():
        env = spark._jvm.org.apache.spark.SparkEnv.get()
        names = env.blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {n for n in names if "/shuffle_" in n}

    old = files()
    df = spark.range(50_000).selectExpr("id % 7000 AS k").groupBy("k").count()
    assert materialize(df, "counted").count() == 7000
    assert not {n for n in files() - old if n.endswith(".data") and "shuffle_" in n and _rows_of(n)}
    assert df.where("k < 10").count() == 10 and materialize(df, "again").count() == 7000
    assert spark.conf.get(SHUFFLE_CLEANUP) == "false"


def _rows_of(path):
    import os

    return os.path.exists(path) and os.path.getsize(path) > 50_000
