"""Session and scratch-space helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Spark's own setting to drop a query's shuffle files at its end
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = 8, app: str = "smudgeline") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8" if cpus == "*" else str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="smudgeline-wh-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a private one where there is one machine only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="smudgeline-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    path = f"{scratch_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


#: folders this process has made, by session
_MADE: dict[str, list[str]] = {}


def made_folders(spark: SparkSession) -> list[str]:
    """Folders :func:`stored` and :func:`scratch_path` have named for this application and not cleared."""
    return list(_MADE.get(spark.sparkContext.applicationId, ()))


def clear_made(spark: SparkSession, keep: int = 0) -> int:
    """Delete the folders made since the first ``keep``; how many were there.

    For a job that is through with its results: frames that read from these folders can no longer be used.
    Take ``len(made_folders(spark))`` before the job as ``keep``.
    """
    made = _MADE.get(spark.sparkContext.applicationId, [])
    gone, made[keep:] = made[keep:], []
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(gone)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: for results that are used again.

    A lost executor costs a read, not the work, and the copy is columnar. Shuffle files of the
    write go as soon as it is done, instead of when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(RELEASE)
        else:
            spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)
