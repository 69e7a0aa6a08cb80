"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.ui.enabled": "false",
    # streaming state (keys x open windows) lives off-heap in RocksDB, not in executor JVM heaps
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(master: str | None = None, app: str = "riskstream", **conf) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only in local mode, where driver and executors are one machine, a private folder is created when the session
    names none; on a cluster executors would write to disks of their own, so that raises.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="riskstream-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Spark's setting that removes an execution's shuffle files at its end.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df, name: str):
    """Cut lineage by writing ``df`` as a parquet table under the shared checkpoint folder and reading
    it back. One job (an RDD ``checkpoint()`` recomputes its input in a second job), columnar on read,
    and the files survive executor loss. The shuffle files of the write are removed as soon as it has ended, not when the
    driver next collects garbage, so that what a long job leaves on the executors' disks is that of one step."""
    import uuid

    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    out = spark.read.parquet(path)
    out.materialized_path = path
    return out


def discard(df) -> None:
    """Delete the files of a :func:`materialize` result that no later query reads."""
    spark = df.sparkSession
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.materialized_path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``riskstream`` importable in executor Python workers (pandas UDFs pickle functions by module
    reference): zip the package once per application and register it with ``addPyFile``, which
    distributes it to every executor."""
    import os
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import riskstream

    root = os.path.dirname(os.path.abspath(riskstream.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="riskstream-pkg-"), "riskstream.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def cluster_conf(input_bytes: int, total_cores: int, shuffled_share: float = 0.2,
                 partition_bytes: int = 1 << 30, split_bytes: int = 256 << 20) -> dict:
    """Settings sized for a job over ``input_bytes`` on ``total_cores`` executor cores.

    Shuffle partitions follow the bytes that reach a shuffle after map-side aggregation (``shuffled_share`` of the
    input), about ``partition_bytes`` each and at least 2 x cores; AQE coalesces smaller stages. The driver keeps an
    entry per map task and shuffle partition, so the count stays in the tens of thousands at 100 TB (20,000 partitions
    for 8000 cores), not one per input split; skew handling splits any partition over 5 x the median and 2 GiB."""
    parts = max(2 * total_cores, -(-int(input_bytes * shuffled_share) // partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(split_bytes),
        "spark.sql.files.maxPartitionBytes": str(split_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 << 30),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists, through the Hadoop file system of the path (local, HDFS, object store)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
