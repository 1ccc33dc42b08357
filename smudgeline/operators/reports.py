"""Counts, accuracies and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import json_text
from ..functions.scoring import known_nll
from ..functions.similarity import jaro_winkler
from .augment import CANONICAL, NOISY, STEPS, made_once
from .skew import ROWS_PER_SPLIT, skew_join, skew_join_many

MISSING_SCORE = -1e30


def step_distribution(df: DataFrame, steps: str = STEPS) -> DataFrame:
    """Rows per steps string, most first."""
    return (
        df.groupBy(steps)
        .agg(F.count("*").alias("record_count"))
        .orderBy(F.desc("record_count"), steps)
    )


def line_distribution(df: DataFrame, canonical: str = CANONICAL, by_name: bool = False) -> DataFrame:
    """Rows per canonical line, most first or by name."""
    counts = df.groupBy(canonical).agg(F.count("*").alias("record_count"))
    return counts.orderBy(canonical) if by_name else counts.orderBy(F.desc("record_count"), canonical)


def row_count(df: DataFrame, canonical: str = CANONICAL) -> DataFrame:
    """Total rows and how many originals they come from."""
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct(canonical).alias("n_originals")
    )


def top1_accuracy(results: DataFrame) -> DataFrame:
    """Share of correct predictions, 0 when nothing was scored."""
    share = F.avg(F.coalesce("is_correct", F.lit(False)).cast("double"))
    return results.agg(F.coalesce(share, F.lit(0.0)).alias("accuracy"))


def topk_accuracy(
    queries: DataFrame, shortlisted: DataFrame, k: int = 3, by_pick_score: bool = True
) -> DataFrame:
    """Share of queries whose truth is among the first ``k`` candidates.

    Ordered by pick score, or by ``nll_yes`` for runs without one; candidates never scored
    come after scored ones, failed ones last, and ties keep their place. A query without candidates is a miss.
    """
    if by_pick_score:
        given = F.coalesce("pick_score", F.lit(MISSING_SCORE))
        rank = F.desc(F.when(F.isnan(given), F.lit(float("-inf"))).otherwise(given))
    else:
        rank = F.asc(known_nll(F.col("nll_yes")))
    order = Window.partitionBy("query_id").orderBy(rank, "place")
    hits = (
        shortlisted.withColumn("_at", F.row_number().over(order))
        .filter((F.col("_at") <= k) & (F.col("candidate") == F.col("truth")))
        .select("query_id", F.lit(1.0).alias("_hit"))
        .distinct()
    )
    share = F.avg(F.coalesce("_hit", F.lit(0.0)))
    return (
        queries.select("query_id")
        .join(hits, "query_id", "left")
        .agg(F.coalesce(share, F.lit(0.0)).alias("accuracy"))
    )


def topk_accuracy_legacy(queries: DataFrame, labelled: DataFrame, k: int = 3) -> DataFrame:
    """Share of queries whose truth is among the first ``k`` "yes" candidates in their order."""
    order = Window.partitionBy("query_id").orderBy("place")
    hits = (
        labelled.filter(F.col("label") == "yes")
        .withColumn("_at", F.row_number().over(order))
        .filter((F.col("_at") <= k) & (F.col("candidate") == F.col("truth")))
        .select("query_id", F.lit(1.0).alias("_hit"))
        .distinct()
    )
    share = F.avg(F.coalesce("_hit", F.lit(0.0)))
    return (
        queries.select("query_id")
        .join(hits, "query_id", "left")
        .agg(F.coalesce(share, F.lit(0.0)).alias("accuracy"))
    )


def jw_by_steps(
    report: DataFrame, steps: str = STEPS, noisy: str = NOISY, canonical: str = CANONICAL
) -> DataFrame:
    """Mean similarity and rows per steps string, over rows that noise did change."""
    return (
        report.filter((F.col("jw_score") <= 1) & (F.col(noisy) != F.col(canonical)))
        .groupBy(steps)
        .agg(F.avg("jw_score").alias("avg_jw"), F.count("*").alias("record_count"))
        .orderBy(F.desc("avg_jw"), steps)
    )


def hardest_steps(report: DataFrame, steps: str = STEPS) -> DataFrame:
    """Share of exact predictions per steps string."""
    return (
        report.filter(F.col("predicted").isNotNull())
        .groupBy(steps)
        .agg(
            F.sum(F.when(F.col("jw_score") == 1, 1).otherwise(0)).alias("correct"),
            F.count("*").alias("total_count"),
        )
        .withColumn("perc_correct", F.round(F.col("correct") / F.col("total_count"), 2))
    )


def worst_examples(
    report: DataFrame,
    steps_text: str,
    steps: str = STEPS,
    noisy: str = NOISY,
    canonical: str = CANONICAL,
) -> DataFrame:
    """Rows of one steps string, least similar first."""
    return (
        report.filter(F.col(steps) == steps_text)
        .select(canonical, noisy, steps, "predicted", "reference", "jw_score")
        .orderBy("jw_score", canonical, noisy)
    )


def join_predictions(
    rows: DataFrame,
    predictions: DataFrame,
    noisy: str = NOISY,
    row_key: str = "row_id",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """All test rows with the model's output on the same text, one prediction per text at most."""
    return skew_join(rows, predictions, noisy, "left", row_key, rows_per_split)


def join_repeated_predictions(
    rows: DataFrame,
    predictions: DataFrame,
    noisy: str = NOISY,
    row_key: str = "row_id",
    prediction_key: str = "prediction_id",
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """All test rows with every prediction on the same text; texts may repeat on both sides and multiply."""
    return skew_join_many(rows, predictions, noisy, "left", row_key, prediction_key, rows_per_split)


def join_predictions_by_row(rows: DataFrame, predictions: DataFrame, row_key: str = "row_id") -> DataFrame:
    """All test rows with the prediction made for that very row: nothing multiplies, no key is hot."""
    return rows.join(predictions, row_key, "left")


def add_jw(df: DataFrame, left: str, right: str, out: str = "jw_score") -> DataFrame:
    """Add the Jaro-Winkler similarity of two columns."""
    return made_once(df, out, jaro_winkler(F.col(left), F.col(right)))


def _shown(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text == "NaN", "").otherwise(text)


def to_flat_records(records: DataFrame, limit: int | None = None, key: str = "query_id") -> DataFrame:
    """Scalars and JSON text only, never null; all rows, or the first ``limit``."""
    rows = records if limit is None else records.orderBy(key).limit(limit)

    def flag(name: str):
        return F.coalesce(F.col(name).cast("boolean"), F.lit(False)).alias(name)

    def json(name: str, out: str):
        return json_text(F.col(name), "[]" if out in _LISTS else "{}").alias(out)

    return rows.select(
        _shown(F.col("noisy")).alias("noisy"),
        _shown(F.col("true")).alias("true"),
        _shown(F.col("predicted")).alias("predicted"),
        flag("predicted_prefers_yes"),
        flag("is_correct"),
        _shown(F.col("eval_pick_policy")).alias("eval_pick_policy"),
        F.coalesce("eval_ranker_max_encoder_rank", F.lit(0)).alias("eval_ranker_max_encoder_rank"),
        json("ranker_pool", "ranker_pool_json"),
        json("scores", "scores_json"),
        json("nll_yes", "nll_yes_json"),
        json("nll_no", "nll_no_json"),
        json("margins", "margins_json"),
        json("pick_scores", "pick_scores_json"),
        json("encoder_cosine", "encoder_cosine_json"),
        json("shortlist", "shortlist_json"),
    )


_LISTS = ("ranker_pool_json", "shortlist_json")


def predictions_table(records: DataFrame) -> DataFrame:
    """The nine columns a predictions table holds."""
    return records.select(
        "noisy",
        F.col("true").alias("true_canonical"),
        "predicted",
        "is_correct",
        F.coalesce("predicted_prefers_yes", F.lit(False)).alias("predicted_prefers_yes"),
        F.to_json("scores").alias("scores_json"),
        json_text(F.col("nll_yes")).alias("nll_yes_json"),
        json_text(F.col("nll_no")).alias("nll_no_json"),
        jaro_winkler(F.col("true"), F.col("predicted")).alias("jw_score"),
    )
