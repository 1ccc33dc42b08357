"""Reading noisy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import steps


def limit_rows(df: DataFrame, n: int | None) -> DataFrame:
    """At most ``n`` rows; null and 0 mean all."""
    return df.limit(n) if n else df


def source_sql(cfg: MatchConfig) -> str:
    """The query a table is read with."""
    where = steps.where_clause(
        cfg.columns.steps, cfg.steps_filter, cfg.steps_min, cfg.steps_max
    )
    base = f"SELECT * FROM {cfg.source_table}"
    return f"{base} WHERE {where}" if where else base


def filter_steps(df: DataFrame, cfg: MatchConfig) -> DataFrame:
    return df.filter(
        steps.passes(F.col(cfg.columns.steps), cfg.steps_filter, cfg.steps_min, cfg.steps_max)
    )


def read_table(spark: SparkSession, cfg: MatchConfig) -> DataFrame:
    return limit_rows(spark.sql(source_sql(cfg)), cfg.max_rows)


def read_parquet(spark: SparkSession, cfg: MatchConfig) -> DataFrame:
    return limit_rows(filter_steps(spark.read.parquet(cfg.source_parquet), cfg), cfg.max_rows)


def read_lines(spark: SparkSession, cfg: MatchConfig) -> DataFrame:
    """A Parquet path wins over a table; neither, or nothing read, is an error."""
    if cfg.source_parquet:
        rows = read_parquet(spark, cfg)
    elif cfg.source_table:
        rows = read_table(spark, cfg)
    else:
        raise ValueError("set source_table or source_parquet")
    if rows.isEmpty():
        raise ValueError("no rows were read; check the source and the steps filter")
    return rows


def temp_view(df: DataFrame, name: str) -> DataFrame:
    """Register for later SQL."""
    df.createOrReplaceTempView(name)
    return df


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
