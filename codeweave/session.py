"""Session helpers: a configured local session for tests/bench and the
checkpoint folder lookup used to cut lineage on a cluster."""

from __future__ import annotations

import os
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", shuffle_partitions: int = 8,
              app: str = "codeweave") -> SparkSession:
    """Local session for tests and the benchmark (UI off, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        # a call site for each column expression costs more than the planning of the large extraction plans
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("CW_DRIVER_MEM", "8g"))
        # whole source files travel in Arrow batches to the Python extractor
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_LOCAL_DIRS: dict[str, str] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this setting must name storage that the driver and every
    executor share; it is read as is and a missing value is an error.  Only a
    local master without the setting (tests) gets a scratch folder of its own.
    """
    sc = spark.sparkContext
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not conf:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that all executors share")
        conf = _LOCAL_DIRS.setdefault(sc.applicationId, "")
        if not conf:
            conf = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="codeweave-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(conf)
    return conf


@contextmanager
def _with_conf(spark: SparkSession, conf: str, value: str):
    before = spark.conf.get(conf, None)
    spark.conf.set(conf, value)
    try:
        yield
    finally:
        spark.conf.unset(conf) if before is None else spark.conf.set(conf, before)


def shuffles_freed(spark: SparkSession):
    """Inside, the shuffle files of a query go when it has ended, instead of when
    the driver collects garbage: for a query whose result is written whole."""
    return _with_conf(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def methods_compiled(spark: SparkSession):
    """Inside, operators whose joint generated code has a method above 8000 bytes,
    which the JVM never compiles but interprets for every row, run one by one."""
    return _with_conf(spark, "spark.sql.codegen.hugeMethodLimit", "8000")


def written_in_order(spark: SparkSession):
    """Inside, a write into buckets or partitions takes its rows in their order, with a
    file open for each (beyond 32 it sorts them), instead of sorting them all."""
    return _with_conf(spark, "spark.sql.maxConcurrentOutputFileWriters", "32")


def spread(df):
    """Rebalance a CPU-bound input that arrives in too few partitions.

    On a cluster, large tables come in thousands of splits and are returned
    as is (no extra shuffle).  A small table stored as one file would
    otherwise run its per-row work (regexes, explodes) in a single task, so
    it is round-robin repartitioned to two tasks per core.
    """
    sc = df.sparkSession.sparkContext
    want = 2 * sc.defaultParallelism
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(want)
    return df
