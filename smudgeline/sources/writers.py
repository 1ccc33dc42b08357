"""Writing noisy tables, artifacts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PARTITION = "st"


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def create_noisy_table(
    spark: SparkSession,
    name: str,
    like: DataFrame,
    location: str,
    comment: str = "",
    partition: str = PARTITION,
) -> None:
    """An external table with the columns of ``like``, unless there is one."""
    columns = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in like.schema if f.name != partition
    )
    kind = like.schema[partition].dataType.simpleString()
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({columns}, `{partition}` {kind}) USING parquet "
        f"PARTITIONED BY (`{partition}`) LOCATION '{_escaped(location)}' "
        f"COMMENT '{_escaped(comment)}'"
    )


def append_noisy(df: DataFrame, name: str, partition: str = PARTITION) -> None:
    """Append by position, the partition column last.

    Rows are rebalanced by partition value first: small values share a task, a hot one is
    split, and no task writes a file for every value.
    """
    columns = [c for c in df.columns if c != partition]
    rows = df.select(*columns, partition).hint("rebalance", partition)
    rows.write.mode("append").insertInto(name)


def write_report_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_predictions(df: DataFrame, name: str) -> None:
    """Overwrite the predictions table; a failed write is an error."""
    df.write.mode("overwrite").saveAsTable(name)


def write_catalog(df: DataFrame, path: str) -> None:
    """``(cat_id, canonical, vec)``."""
    df.write.mode("overwrite").parquet(path)


def write_negatives(df: DataFrame, path: str) -> None:
    """Train rows with their negatives and test rows with none, by ``split``."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_pairs(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
