"""Session helpers: build a session for local runs and find the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession


LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.driver.memory": os.environ.get("BUSGUARD_DRIVER_MEMORY", "8g"),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app: str = "busguard") -> SparkSession:
    """A session.  What the caller, spark-submit or a running session has set stays as it is; sizes are
    given for a local master alone."""
    running = SparkSession.getActiveSession()
    given = dict(running.sparkContext.getConf().getAll()) if running else dict(SparkConf().getAll())
    target = master or given.get("spark.master") or "local[*]"
    wanted = dict(DEFAULTS)
    if target.startswith("local") and not target.startswith("local-cluster"):
        wanted |= LOCAL_DEFAULTS
    builder = SparkSession.builder
    if not running:
        builder = builder.master(target)
        if "spark.app.name" not in given:
            builder = builder.appName(app)
    for key, value in wanted.items():
        if key not in given and not (running and _is_set(running, key)):
            builder = builder.config(key, value)
    spark = builder.getOrCreate()
    if shuffle_partitions is not None:
        spark.conf.set("spark.sql.shuffle.partitions", shuffle_partitions)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_set(spark: SparkSession, key: str) -> bool:
    """Whether a running session has a value of its own for a setting (or it can no longer be set)."""
    return not spark.conf.isModifiable(key) or spark.conf.get(key, None) is not None


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session names none (local tests) do we create one under the system temp folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="busguard-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


#: Executions delete their shuffle files as they end; Spark keeps them else until the driver's JVM collects.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session's settings have other values for what runs within."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def stage_table(df: DataFrame, stem: str) -> tuple[DataFrame, str]:
    """``df`` written as Parquet in the shared folder and read back (columns are pruned on reading, lost executors do
    no harm), and its folder for ``drop_folder``."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{stem}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system API (works for any shared store)."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
