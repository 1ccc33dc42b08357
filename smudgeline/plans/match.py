"""The matching flow: read, split, mine, pair, rank, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions.encoders import Encoder, ngram_encoder
from ..functions.scoring import Scorer, edit_scorer
from ..functions.tokens import Tokenizer, byte_tokens
from ..operators.catalog import distinct_catalog, keep_known, with_vectors
from ..operators.negatives import mine_hard_negatives
from ..operators.neighbors import shortlist
from ..operators.pairs import make_pairs, tokenize_pairs
from ..operators.ranking import evaluate_ranking, evaluation_records, limit_eval
from ..operators.reports import predictions_table, top1_accuracy, topk_accuracy
from ..operators.split import exact_split
from ..session import scratch_path, stored
from ..sources import readers, writers


@dataclass
class MatchResult:
    """Tables of one run; all but the accuracies are read back from shared storage."""

    catalog: DataFrame
    negatives: DataFrame
    pairs: DataFrame
    records: DataFrame
    accuracy: float
    top3_accuracy: float


def embed_queries(rows: DataFrame, cfg: MatchConfig, encoder: Encoder, key: str) -> DataFrame:
    """``(query_id, noisy, truth, vec)`` of the rows to be matched."""
    names = cfg.columns
    return rows.select(
        F.col(key).alias("query_id"),
        F.col(names.noisy).cast("string").alias("noisy"),
        F.col(names.canonical).cast("string").alias("truth"),
        encoder(F.col(names.noisy)).alias("vec"),
    )


def match_rows(
    queries: DataFrame, catalog: DataFrame, cfg: MatchConfig, scorer: Scorer, **options
) -> DataFrame:
    """Shortlist, score and rank the queries against the catalog, in long form."""
    found = stored(shortlist(queries, catalog, cfg.shortlist_k, **options), "shortlist")
    return evaluate_ranking(
        queries,
        catalog,
        found,
        scorer,
        cfg.shortlist_k,
        cfg.ranker_pool,
        cfg.pick_policy,
        cfg.blend_weight,
        cfg.inject_truth,
        queries.select("query_id", "vec"),
        cfg.prompt,
    )


def run(
    spark: SparkSession,
    cfg: MatchConfig,
    encoder: Encoder | None = None,
    scorer: Scorer | None = None,
    tokenizer: Tokenizer = byte_tokens,
    key: str = "row_id",
) -> MatchResult:
    """The whole flow. Each artifact is written once and read back where it is used again."""
    encoder, scorer = encoder or ngram_encoder(), scorer or edit_scorer()
    names = cfg.columns
    root = (cfg.artifact_dir or scratch_path(spark, "match")).rstrip("/")
    rows = readers.read_lines(spark, cfg)
    if cfg.max_rows:
        # which rows a limit keeps must not change from one use to the next
        rows = stored(rows, "rows")

    writers.write_catalog(
        with_vectors(distinct_catalog(rows, names.canonical), encoder), f"{root}/catalog"
    )
    catalog = spark.read.parquet(f"{root}/catalog")
    if catalog.isEmpty():
        raise ValueError("the catalog is empty: no canonical line was read")

    parts = exact_split(rows, cfg.test_size, cfg.split_seed, key)
    train, test = (parts.filter(F.col("split") == s) for s in ("train", "test"))
    mined = mine_hard_negatives(
        train,
        catalog,
        cfg.max_neighbors,
        cfg.per_neighbor,
        cfg.per_row,
        names.canonical,
        names.noisy,
        key,
    )
    no_negatives = test.withColumn("hard_negatives", F.array().cast("array<string>"))
    writers.write_negatives(mined.unionByName(no_negatives), f"{root}/negatives")
    negatives = spark.read.parquet(f"{root}/negatives")

    pairs = make_pairs(
        keep_known(negatives, names.canonical, names.noisy),
        names.canonical,
        names.noisy,
        key,
        cfg.prompt,
        keep=("split",),
    )
    writers.write_pairs(tokenize_pairs(pairs, cfg.max_input_length, tokenizer), f"{root}/pairs")

    to_match = limit_eval(
        keep_known(test, names.canonical, names.noisy), cfg.eval_max_rows, key
    )
    queries = stored(embed_queries(to_match, cfg, encoder, key), "queries")
    match_rows(queries, catalog, cfg, scorer).write.mode("overwrite").parquet(f"{root}/ranked")
    ranked = spark.read.parquet(f"{root}/ranked")
    evaluation_records(ranked, cfg.pick_policy, cfg.ranker_pool).write.mode(
        "overwrite"
    ).parquet(f"{root}/records")
    records = spark.read.parquet(f"{root}/records")
    if cfg.predictions_table:
        writers.write_predictions(predictions_table(records), cfg.predictions_table)
    return MatchResult(
        catalog,
        negatives,
        readers.read_pairs(spark, f"{root}/pairs"),
        records,
        top1_accuracy(records).first()["accuracy"],
        topk_accuracy(records.select("query_id"), ranked, 3).first()["accuracy"],
    )
