"""Session settings the operators rely on."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import cache

from pyspark.sql import SparkSession

# All of these are runtime settings; none depends on the size of the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Rows of long texts; the default of 10,000 costs memory in the JVM and in Python.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}

# Partitions that text columns of the test tables are dealt to before heavy work.
SPREAD = "msgrisk.spread.partitions"


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session the caller already owns."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "*", memory: str = "8g", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("msgrisk")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # Call sites of column expressions cost more than the expressions.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if cores.isdigit():
        builder = builder.config(SPREAD, cores)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    A temporary folder stands in only where the setting is absent and Spark runs
    in local mode; elsewhere a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_folder()


@cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="msgrisk-")


_scratch: list[str] = []  # paths given out since they were last cleared


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for a written table or a stream."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def clear_scratch(spark: SparkSession) -> int:
    """Delete what operators have written below the shared folder; returns how many paths.

    A result is read from such tables until it has been written somewhere itself, so this
    is for the owner of a session to call, after its results are written and its streams
    have ended. Only paths given out by this process are deleted.
    """
    cleared = 0
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        cleared += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return cleared
