"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "txrisk", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC times, ANSI SQL and adaptive execution.

    Partition counts are left to the cluster unless given; AQE coalesces
    small shuffles and splits skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**fixed, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it.

    Only a local session, where every task runs on this machine, may fall
    back to a temporary folder.
    """
    named = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="txrisk-")
    spark.conf.set(CHECKPOINT_KEY, folder)
    return folder


def run_root(spark: SparkSession) -> str:
    """This application's own folder below the shared one."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{run_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder; call it once
    its results are stored elsewhere."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def materialise(frame: DataFrame, name: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: a cut lineage
    that outlives the loss of any executor."""
    path = scratch_path(frame.sparkSession, name)
    frame.write.mode("error").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def give_heap_back(spark: SparkSession) -> None:
    """Executors collect their garbage and hand heap they no longer need back to the system.

    An executor's heap else stays as large as the work before made it, up to its limit,
    beside the Python workers of the work that follows.  An executor that gets no
    task here keeps its heap.
    """
    n = spark.sparkContext.defaultParallelism
    collected = F.java_method(F.lit("java.lang.System"), F.lit("gc")).alias("collected")
    spark.range(0, n, 1, n).select(collected).write.format("noop").mode("overwrite").save()
