"""The closed catalog and the noisy texts that belong to each of its lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .augment import CANONICAL, NOISY
from .skew import ROWS_PER_SPLIT, first_per_group, place_in_group, skew_join


def keep_known(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows where any of the columns is null."""
    return df.dropna(subset=list(columns))


def distinct_lines(df: DataFrame, canonical: str = CANONICAL) -> DataFrame:
    """Distinct non-null lines, as strings."""
    return (
        df.select(F.col(canonical).cast("string").alias("canonical"))
        .filter(F.col("canonical").isNotNull())
        .distinct()
    )


def distinct_catalog(
    df: DataFrame, canonical: str = CANONICAL, rows_per_stretch: int = ROWS_PER_SPLIT
) -> DataFrame:
    """``(cat_id, canonical)``: ids are positions in the sorted list, from 0.

    The distinct lines are made once and stored, then cut into sorted stretches of about
    ``rows_per_stretch`` lines. The stretches are stored too, so ids do not depend on where
    the cuts fell. One plan serves all sizes: only the counts of stretches meet in one task.
    """
    lines = stored(distinct_lines(df, canonical), "distinct_lines")
    stretches = lines.count() // rows_per_stretch + 1
    cut = stored(
        lines.repartitionByRange(stretches, "canonical").withColumn(
            "_stretch", F.spark_partition_id()
        ),
        "stretches",
    )
    counts = cut.groupBy("_stretch").agg(F.count("*").alias("_n"))
    # one row for each stretch
    before = Window.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(
        "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    at = F.row_number().over(Window.partitionBy("_stretch").orderBy("canonical"))
    return (
        cut.withColumn("_at", at)
        .join(shifts, "_stretch")
        .select((F.col("_shift") + F.col("_at") - 1).cast("long").alias("cat_id"), "canonical")
    )


def catalog_lookup(
    df: DataFrame,
    catalog: DataFrame,
    canonical: str = CANONICAL,
    row_key: str = "row_id",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Add ``cat_id``; null for a line the catalog does not hold."""
    ids = catalog.select(F.col("canonical").alias(canonical), "cat_id")
    return skew_join(df, ids, canonical, "left", row_key, rows_per_split)


def rank_noisy(
    df: DataFrame, canonical: str = CANONICAL, noisy: str = NOISY, order: str = "row_id"
) -> DataFrame:
    """``(canonical, noisy, row_id, place)``: the multimap in long form, nulls left out."""
    rows = keep_known(df, canonical, noisy).select(
        F.col(canonical).cast("string").alias("canonical"),
        F.col(noisy).cast("string").alias("noisy"),
        F.col(order).alias("row_id"),
    )
    return place_in_group(rows, "canonical", "row_id", "place")


def group_noisy(
    df: DataFrame,
    canonical: str = CANONICAL,
    noisy: str = NOISY,
    order: str = "row_id",
    per_list: int = 10_000,
) -> DataFrame:
    """``(canonical, part, noisy_list)``: noisy texts in input order.

    A line with more than ``per_list`` texts gets further parts, so no list grows without
    bound and none is cut short.
    """
    ranked = rank_noisy(df, canonical, noisy, order).withColumn(
        "part", F.floor((F.col("place") - 1) / per_list).cast("int")
    )
    return ranked.groupBy("canonical", "part").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("place", "noisy"))), lambda x: x["noisy"]
        ).alias("noisy_list")
    )


def first_variants(
    df: DataFrame, m: int, canonical: str = CANONICAL, noisy: str = NOISY, order: str = "row_id"
) -> DataFrame:
    """``(canonical, noisy, variant)``: the first ``m`` noisy texts of each line."""
    rows = keep_known(df, canonical, noisy).select(
        F.col(canonical).cast("string").alias("canonical"),
        F.col(noisy).cast("string").alias("noisy"),
        F.col(order).alias("_order"),
    )
    return first_per_group(rows, ["canonical"], ["_order"], m, "variant").drop("_order")


def with_vectors(catalog: DataFrame, encoder, text: str = "canonical") -> DataFrame:
    """Add the encoder's ``vec``."""
    return catalog.withColumn("vec", encoder(F.col(text)))
