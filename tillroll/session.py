"""Session construction and the few runtime settings the library relies on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Runtime SQL settings the plans are designed around. They are all
# session-scoped and can be changed on a live session.
PLAN_SETTINGS = {
    # Values are zone-less (TIMESTAMP_NTZ); pin the zone anyway so that any
    # TIMESTAMP input is interpreted the same on every executor.
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: coalesce small shuffle partitions, switch joins to
    # broadcast when the *measured* side is small, split skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # An aggregate or window keyed on (CustomerID, InvoiceNo) must be hash
    # partitioned on *both* keys. Without this, Spark reuses an existing
    # partitioning on CustomerID alone, which puts one hot customer (possibly
    # a third of all rows) into a single task.
    "spark.sql.requireAllClusterKeysForDistribution": "true",
}


# Sizes for a cluster, applied only where the user has set nothing. Scan
# splits of 256 MB keep a 100 TB scan at a few hundred thousand tasks. Every
# shuffle starts with at least 4 partitions per core (and no fewer than
# MIN_SHUFFLE_PARTITIONS, since executors may still be joining), and AQE
# coalesces them towards 16 MB (compressed; the sorts and hash tables of a task
# that joins the lines take some 30 times that), so that a task's memory does not
# grow with the input: a large shuffle is never squeezed into a few hundred spilling
# partitions, and a small one does not run as thousands of tiny tasks.
CLUSTER_SIZING = {
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}
# What a cluster of executors on one machine (local-cluster) gets of it.
TASK_SIZING = ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)
SHUFFLE_PARTITIONS_PER_CORE = 4
MIN_SHUFFLE_PARTITIONS = 2000


def cluster_sizing(master: str, default_parallelism: int, user_set: set[str]) -> dict[str, str]:
    """Settings to add for ``master`` (none in local mode, none the user set)."""
    if master.startswith("local-cluster"):
        return {k: CLUSTER_SIZING[k] for k in TASK_SIZING if k not in user_set}
    if master.startswith("local"):
        return {}
    out = {k: v for k, v in CLUSTER_SIZING.items() if k not in user_set}
    partitions = str(max(SHUFFLE_PARTITIONS_PER_CORE * default_parallelism, MIN_SHUFFLE_PARTITIONS))
    for key in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"):
        if not user_set & {"spark.sql.shuffle.partitions", key}:
            out[key] = partitions
    return out


def tune(spark: SparkSession) -> SparkSession:
    """Apply :data:`PLAN_SETTINGS` to an existing session (idempotent), and
    on a cluster the :func:`cluster_sizing` the user has not set."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    sc = spark.sparkContext
    watched = set(CLUSTER_SIZING) | {
        "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"}
    user_set = {k for k in watched if spark.conf.get(k, None) is not None}
    if not getattr(sc, "_tillroll_sized", False):
        for key, value in cluster_sizing(sc.master, sc.defaultParallelism, user_set).items():
            spark.conf.set(key, value)
        sc._tillroll_sized = True
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint folder of the session.

    On a cluster this is the shared folder named by ``spark.checkpoint.dir``
    and is only read, never replaced. Only a session without one (local
    tests) gets a fresh private folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="tillroll-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def _has_master() -> bool:
    """Whether a master is set by a running context, spark-submit, its arguments or the configuration file."""
    if SparkContext._active_spark_context is not None:
        return True
    if "PYSPARK_GATEWAY_PORT" in os.environ:  # under spark-submit the JVM has the configuration
        return SparkConf().contains("spark.master")
    # before the JVM starts (starting it here would lose the driver memory that a caller asks for)
    if "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or "spark.master" in os.environ.get("PYSPARK_SUBMIT_ARGS", ""):
        return True
    folder = os.environ.get("SPARK_CONF_DIR") or os.path.join(os.environ.get("SPARK_HOME", ""), "conf")
    defaults = os.path.join(folder, "spark-defaults.conf")
    if os.path.isfile(defaults):
        with open(defaults) as f:
            return any(line.split("=")[0].split()[:1] == ["spark.master"] for line in f)
    return False


def build_session(
    master: str | None = None,
    app_name: str = "tillroll",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session configured for the library.

    Without ``master`` the master that was submitted (or configured, or runs
    already) is kept. Only where there is none it becomes
    ``local[$BENCH_CPUS]`` / ``local[*]``, for tests and the benchmark.
    """
    builder = SparkSession.builder.appName(app_name)
    if master is None and not _has_master():
        cpus = os.environ.get("BENCH_CPUS", "*")
        master = f"local[{cpus}]"
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if shuffle_partitions is not None:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in PLAN_SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return tune(spark)


def materialize(df, name: str | None = None, partition_by: list[str] | None = None):
    """Cut the lineage of ``df`` by writing it as a Parquet table under the
    session's checkpoint folder (shared on a cluster) and reading it back.

    Used where a result feeds several later steps (the line rollup, the
    customer table), so the transaction joins run once and a lost executor
    recomputes from the written table rather than from the raw inputs.
    Compared with ``Dataset.checkpoint`` the data is computed once (no
    second pass for the checkpoint write), stored columnar and compressed,
    and read back with exact file statistics for the planner.
    """
    spark = df.sparkSession
    path = new_path(spark, name or "table")
    df.write.mode("error").parquet(path, partitionBy=partition_by)
    # an empty partitioned table has no file that would name the columns
    return (spark.read.schema(df.schema) if partition_by else spark.read).parquet(path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new place under the session's checkpoint folder, which
    :func:`release_tables` deletes with the tables."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    _written(spark).append(path)
    return path


def _written(spark: SparkSession) -> list[str]:
    sc = spark.sparkContext
    if not hasattr(sc, "_tillroll_tables"):
        sc._tillroll_tables = []
    return sc._tillroll_tables


def release_tables(spark: SparkSession) -> int:
    """Delete the tables :func:`materialize` wrote in this session (through
    the Hadoop FileSystem of the checkpoint folder, so any shared store
    works). DataFrames that read them must not be used afterwards. Returns
    the number of tables removed."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    written = _written(spark)
    removed = 0
    while written:
        path = jvm.org.apache.hadoop.fs.Path(written.pop())
        removed += bool(path.getFileSystem(conf).delete(path, True))
    return removed
