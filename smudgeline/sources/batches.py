"""Appends that may be tried again: a batch is visible once, whole, or not at all.

A Parquet folder has no atomic append. So every try writes to a folder of its own, and one row in a commit
log then names the batch and the try that counts. Readers go by the log: a try that broke off before its
row is never read, a batch that is in the log is not written again, and of two tries that raced
to commit one batch the smaller name counts for everyone.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .writers import PARTITION

LOG, ROWS = "commits", "rows"


def _log(spark: SparkSession, location: str) -> DataFrame | None:
    try:
        return spark.read.schema("batch STRING, attempt STRING, columns STRING").parquet(f"{location}/{LOG}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def committed(spark: SparkSession, location: str) -> dict[str, str]:
    """The try that counts for each batch; as many entries as there are batches."""
    log = _log(spark, location)
    if log is None:
        return {}
    return {r["batch"]: r["attempt"] for r in log.groupBy("batch").agg(F.min("attempt").alias("attempt")).collect()}


def write_attempt(df: DataFrame, location: str, partition: str = PARTITION) -> str:
    """Write rows where no reader looks yet; the name of the try."""
    attempt = uuid.uuid4().hex
    df.hint("rebalance", partition).write.partitionBy(partition).parquet(f"{location}/{ROWS}/{attempt}")
    return attempt


def commit(spark: SparkSession, location: str, batch: str, attempt: str, df: DataFrame) -> None:
    """Make a try count. One file of one row, which a file system shows whole or not at all."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    row = spark.createDataFrame([(batch, attempt, columns)], "batch STRING, attempt STRING, columns STRING")
    row.coalesce(1).write.mode("append").parquet(f"{location}/{LOG}")


def append_batch(df: DataFrame, location: str, batch: str, partition: str = PARTITION) -> bool:
    """Append the rows as ``batch`` unless it is there already; whether they were written.

    A call that failed may be repeated, with the same batch name and rows, any number of times.
    Rows are rebalanced by partition value, as in a plain append.
    """
    spark = df.sparkSession
    if batch in committed(spark, location):
        return False
    attempt = write_attempt(df, location, partition)
    commit(spark, location, batch, attempt, df)
    return committed(spark, location)[batch] == attempt


def read_batches(spark: SparkSession, location: str, only: list[str] | None = None) -> DataFrame:
    """All rows of committed batches, or of those named in ``only``; the table must have one."""
    log = _log(spark, location)
    attempts = committed(spark, location)
    if log is None or not attempts:
        raise ValueError(f"no batch was committed at {location}")
    columns = log.select("columns").first()["columns"]
    wanted = [a for b, a in attempts.items() if only is None or b in only]
    if not wanted:
        return spark.createDataFrame([], columns)
    parts = [spark.read.schema(columns).parquet(f"{location}/{ROWS}/{a}") for a in sorted(wanted)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def broken_attempts(spark: SparkSession, location: str) -> list[str]:
    """Names of tries that do not count: broken off, still running, or second to commit.

    They take room but are never read. Which of them are still running only the caller knows, so none
    is deleted here.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{location}/{ROWS}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    counting = set(committed(spark, location).values())
    return sorted(n for n in names if n not in counting)
