"""Joins and positions that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: rows of one key that a single task may be left with
ROWS_PER_SPLIT = 1_000_000
#: parts of a key that repeats on both sides, and so copies of its rows, before parts of that many rows are full;
#: fewer where many keys repeat
GRID_COPIES = 32
#: rows of one key that are met as one list
LIST_ROWS = 128
#: parts the rows without a key are spread over
NULL_SPLITS = 1024
#: buckets of hashes in which hot keys are looked for first
BUCKETS = 1 << 16


def hot_keys(facts: DataFrame, key: str, rows_per_split: int = ROWS_PER_SPLIT) -> DataFrame:
    """``(key, _splits)`` of the keys with more than ``rows_per_split`` rows, stored.

    Rows are counted by hash bucket, at most 65,536 counts, so keys themselves are only counted
    in buckets that could hold a hot one: nearly unique keys are never shuffled to find none.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS))
    known = facts.filter(F.col(key).isNotNull()).withColumn("_bucket", bucket)
    full = stored(
        known.groupBy("_bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > rows_per_split),
        "full_buckets",
    )
    if not full.isEmpty():
        # at most BUCKETS rows of one long
        known = known.join(F.broadcast(full.select("_bucket")), "_bucket", "left_semi")
        counts = known.groupBy(key).agg(F.count("*").alias("_n"))
    else:
        counts = known.limit(0).select(key, F.lit(0).cast("long").alias("_n"))
    splits = F.ceil(F.col("_n") / rows_per_split).cast("int").alias("_splits")
    return stored(counts.filter(F.col("_n") > rows_per_split).select(key, splits), "hot_keys")


def skew_join(
    facts: DataFrame,
    dim: DataFrame,
    key: str,
    how: str = "left",
    row_key: str = "row_id",
    rows_per_split: int = ROWS_PER_SPLIT,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Join many rows to one row per key, with hot keys split over several tasks.

    Hot keys are looked for in two passes over ``facts``, or handed in as ``hot(key, _splits)`` where
    they are known, from counts made before or from :func:`hot_keys` of an earlier join. The list of hot keys has at most ``rows / rows_per_split`` entries and lies in a file, whose
    size tells Spark whether to broadcast it. Rows of ``dim`` are copied once per split of their
    own key, all others once. The two sides are sorted and merged: what Spark guesses before it has run
    leaves out how exploding and collecting grow rows, and a side broadcast by that guess may not fit the driver.
    """
    hot = hot_keys(facts, key, rows_per_split) if hot is None else hot
    left = facts.join(hot, key, "left").withColumn(
        "_split",
        # null keys match nothing, so they are spread freely
        F.when(F.col(key).isNull(), -1 - F.pmod(F.xxhash64(row_key), F.lit(NULL_SPLITS)))
        .when(F.col("_splits").isNotNull(), F.pmod(F.xxhash64(row_key), F.col("_splits")))
        .otherwise(0)
        .cast("int"),
    )
    right = dim.join(hot, key, "left").select(
        *dim.columns,
        F.explode(F.sequence(F.lit(0), F.coalesce("_splits", F.lit(1)) - 1)).alias("_split"),
    )
    return left.drop("_splits").join(right.hint("merge"), [key, "_split"], how).drop("_split")


def skew_join_many(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str = "inner",
    left_row: str = "row_id",
    right_row: str = "row_id",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Join on a key that may repeat on both sides, with hot keys split into a grid.

    A key with many rows on either side is cut into parts there; each part of one side meets each part
    of the other, and a row is copied for each part of the other side. ``rows_per_split`` is what a part aims at: more
    where a key would have over ``GRID_COPIES`` parts, never over ``ROWS_PER_SPLIT``, so that what is moved grows as
    the rows do until parts are full, however often keys repeat. Only a key with half of all pairs has that many parts:
    grids are to spread the work, and where many keys are hot each of them has a part of it. Rows of ``right`` are met
    in lists of about ``LIST_ROWS``. ``how`` is "inner" or "left";
    null keys match nothing. Columns other than the key must differ in name, the row columns named here
    need only be integers to deal rows by.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"inner or left, not {how!r}")
    hot = [
        hot_keys(side, key, rows_per_split).withColumnRenamed("_splits", name)
        for side, name in ((left, "_l_splits"), (right, "_r_splits"))
    ]
    grids = hot[0].join(hot[1], key, "full").na.fill(1, ["_l_splits", "_r_splits"])
    pairs = F.col("_l_splits").cast("double") * F.col("_r_splits")
    every = grids.agg(F.sum(pairs)).first()[0] or 1.0
    copies = F.ceil(F.lit(GRID_COPIES) * F.sqrt(F.least(F.lit(2.0) * pairs / every, F.lit(1.0))))

    def parts(name: str) -> Column:
        # parts of ``rows_per_split`` rows, and how many of those make one of a full part
        full = F.ceil(F.col(name) * rows_per_split / F.lit(max(rows_per_split, ROWS_PER_SPLIT)))
        return F.greatest(F.least(F.col(name), copies), full).cast("int").alias(name)

    lists = F.ceil(F.col("_r_splits") * rows_per_split / F.lit(LIST_ROWS)).alias("_lists")
    splits = stored(grids.select(key, parts("_l_splits"), parts("_r_splits"), lists), "hot_grid")
    known = left.filter(F.col(key).isNotNull()), right.filter(F.col(key).isNotNull())

    def dealt(side: DataFrame, own: str, other: str, row: str) -> DataFrame:
        part = F.pmod(F.xxhash64(row), F.coalesce(own, F.lit(1))).cast("int").alias(own.replace("splits", "part"))
        parts = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(other.replace("splits", "part"))
        return side.select("*", part, parts).drop("_l_splits", "_r_splits", "_lists")

    # a list for each part at least, and keys that are not hot may have as many rows as a part
    lists = F.greatest(F.coalesce("_r_splits", F.lit(1)), F.coalesce("_lists", F.lit(-(-rows_per_split // LIST_ROWS))))
    packed = (
        known[1].join(splits, key, "left")
        .withColumn("_list", F.pmod(F.xxhash64(right_row), lists))
        .groupBy(key, "_list", "_l_splits", "_r_splits")
        .agg(F.collect_list(F.struct(*(c for c in right.columns if c != key))).alias("_rows"))
    )
    # merged, as in skew_join: neither side's size is known before it has run. Rows are few beside their pairs:
    # dealt out by number, or few tasks would get them by their size
    keys = [key, "_l_part", "_r_part"]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = dealt(known[0].join(splits, key, "left"), "_l_splits", "_r_splits", left_row).repartition(tasks, *keys)
    met = dealt(packed, "_r_splits", "_l_splits", "_list").repartition(tasks, *keys).join(rows.hint("merge"), keys)
    # a list goes by the rows of the other side one after the other, so the same few rows come again and again,
    # which is what writers of columns shorten
    out = met.select(key, *(c for c in left.columns if c != key), F.inline("_rows"))
    if how == "inner":
        return out
    alone = left.join(known[1].select(key).distinct(), key, "left_anti")
    return out.unionByName(alone, allowMissingColumns=True)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column | str], n: int, place: str):
    """The first ``n`` rows of each group with their place.

    Spark limits each group before the shuffle as well, so a hot group sends at most ``n``
    rows per task.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(place, F.row_number().over(window)).filter(F.col(place) <= n)


def place_in_group(
    df: DataFrame, key: str, order: str, place: str, span: int = ROWS_PER_SPLIT
) -> DataFrame:
    """Exact 1-based position of each row in its group, by a unique integer column.

    Groups are cut into stretches of ``span`` ids; positions inside a stretch are shifted by
    the rows before it, so no task sees a whole hot group.
    """
    cut = df.withColumn("_stretch", F.floor(F.col(order) / span).cast("long"))
    counts = cut.groupBy(key, "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_stretch").rowsBetween(
        Window.unboundedPreceding, -1
    )
    shifts = counts.select(
        key, "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift")
    )
    inside = F.row_number().over(Window.partitionBy(key, "_stretch").orderBy(order))
    return (
        cut.withColumn("_at", inside)
        .join(shifts, [key, "_stretch"])
        .withColumn(place, F.col("_shift") + F.col("_at"))
        .drop("_stretch", "_shift", "_at")
    )
