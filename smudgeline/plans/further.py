"""More registered queries: SQL functions, numbered plans, whole-catalog scoring, batches, tries, pooling, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import draws, noise, scoring, sql, tokens
from ..functions.encoders import ngram_encoder
from ..operators import augment, backoff, catalog, neighbors, pairs, pooling, ranking, reports, split, trie
from ..operators import negatives as mining
from ..operators.augment import CANONICAL, NOISY, STEPS
from ..session import scratch_path, stored
from ..sources import batches, readers, writers
from . import registered as r
from .registered import PLANS, SEED, Query, query, spread, table

# --- noise in SQL text -------------------------------------------------------

#: query of the Column form, and the step whose SQL function must give the same rows
SQL_FORMS = {
    "replace_char": "replace_char",
    "repeat_characters": "repeat_characters",
    "repeat_part": "repeat_part_of_address",
    "insert_random_word": "insert_random_words",
    "add_random_text": "add_random_text",
    "convert_directions": "convert_cardinal_directions",
    "change_case": "change_case",
    "add_special": "add_special_characters",
    "change_ordinals": "change_ordinal_numbers",
    "change_directions": "change_cardinal_directions",
    "insert_random_directions": "insert_random_cardinal_directions",
    "remove_vowels": "randomly_remove_vowels",
    "replace_spaces": "randomly_replace_spaces",
    "insert_direction": "insert_cardinal_directions",
}


def _noise_in_sql(step: str, text: str) -> Query:
    def run(spark, sf):
        sql.register_noise(spark, [step])
        sql.register_helpers(spark)
        view = r._name("lines")
        r.lines(spark, sf, text).repartition(spread(spark), "line_id").createOrReplaceTempView(view)
        return spark.sql(
            f"SELECT line_id, made.text, made.step FROM (SELECT line_id, {step}(first_line, "
            f"noise_base({SEED}, CAST(line_id AS STRING), 1, 0)) AS made FROM {view})"
        )

    return run


r.QUERIES |= {
    f"sql_noise_{name}": _noise_in_sql(step, r.MIXED_LINE if name == "convert_directions" else r.LINE)
    for name, step in SQL_FORMS.items()
}


@query
def sql_helpers(spark, sf):
    """The other functions SQL text can call, on noisy lines."""
    sql.register_all(spark)
    view = r._name("noisy")
    r.noisy(spark, sf).createOrReplaceTempView(view)
    return spark.sql(
        f"SELECT row_id, step_count({STEPS}) AS n_steps, "
        f"specials_to_space({NOISY}) AS spaced, round(edit_similarity({NOISY}, {CANONICAL}), 6) AS similar, "
        f"round(jaro_winkler({CANONICAL}, {NOISY}), 6) AS jw FROM {view}"
    )


# --- plans by number ---------------------------------------------------------


@query
def step_plans_by_number(spark, sf):
    """All plans of one to four steps, and the rows each gives on the lines of the largest type."""
    plans = augment.numbered_plans(spark, noise.GRID_STEPS, 4)
    most = r.lines(spark, sf).groupBy("st").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    return plans.select("plan_no", F.array_join("steps_arr", ",").alias("plan"), "n_steps", F.lit(most).cast("long").alias("n_rows"))


@query
def ordered_plans_by_number(spark, sf):
    """All orders of one to three steps, counted by their last step."""
    plans = augment.numbered_plans(spark, noise.GRID_STEPS, 3, ordered=True)
    total = r.lines(spark, sf).count()
    return (
        plans.groupBy(F.element_at("steps_arr", -1).alias("last_step"), "n_steps")
        .agg(F.count("*").alias("n_plans"), F.min("plan_no").alias("first_plan"), F.max("plan_no").alias("last_plan"))
        .withColumn("n_lines", F.lit(total).cast("long"))
    )


@query
def noisy_grid_by_number(spark, sf):
    """The small noisy table, its plans made from their numbers."""
    return augment.augment_grid_by_number(
        r.lines(spark, sf), [PLANS[0][0], PLANS[1][0]], 2, r.ITERATIONS, SEED, partitions=spread(spark)
    ).select("row_id", "line_id", NOISY, STEPS, "n_steps")


# --- search and scoring ------------------------------------------------------


@query
def shortlist_by_cells(spark, sf):
    """The shortlist through cells, visited in rounds."""
    found = neighbors.shortlist(r.vector_queries(spark, sf), r.vectors(spark, sf), 64, chunk_rows=100, cell_rows=25)
    return found.select("query_id", "cat_id", "candidate", "cosine", "place")


def rare_scorer(df: DataFrame) -> DataFrame:
    """Drawn scores under which about one candidate in a hundred is a "yes"."""
    at = draws.base(SEED, F.col("query_id"), F.col("cat_id"))
    return (
        df.withColumn("_at", at)
        .withColumn("nll_yes", draws.uniform(F.col("_at"), 1) * 5)
        .withColumn("nll_no", draws.uniform(F.col("_at"), 2) * 0.1)
        .drop("_at")
    )


@query
def score_legacy_whole(spark, sf):
    """Every vector's text asks the whole catalog; the first "yes" by id answers."""
    return ranking.score_legacy_whole(
        r.vector_queries(spark, sf), r.vectors(spark, sf), rare_scorer, block_lines=40, block_queries=200
    ).select("query_id", "predicted", "is_correct")


@query
def score_by_counts(spark, sf):
    """Forced-label costs of pairs, by a model counted over the pairs of every other line."""
    made = pairs.make_pairs(r.mined(spark, sf))
    model = backoff.count_labels(made.filter("row_id % 2 = 0"))
    scored = backoff.backoff_scorer(model)(made.select("row_id", "pos", "prompt"))
    label = scoring.yes_no_label(F.col("nll_yes"), F.col("nll_no"))
    return scored.select(
        "row_id", "pos", F.round("nll_yes", 6).alias("nll_yes"), F.round("nll_no", 6).alias("nll_no"), label.alias("label")
    )


def failing_scorer(df: DataFrame) -> DataFrame:
    """Drawn scores, some of them infinite, not numbers or missing, by the sum of the ids."""
    kind = (F.col("query_id") + F.col("cat_id")) % 7
    drawn = r.drawn_scorer(df)
    endless, nothing = F.lit(float("inf")), F.lit(float("nan"))
    return drawn.withColumns(
        {
            "nll_yes": F.when(kind.isin(0, 1), endless).when(kind == 2, nothing).otherwise(F.col("nll_yes")),
            "nll_no": F.when(kind == 0, endless).when(kind == 3, F.lit(None).cast("double")).otherwise(F.col("nll_no")),
        }
    )


def failing(spark, sf) -> DataFrame:
    asked, lines_ = r.vector_queries(spark, sf), r.vectors(spark, sf)
    found = stored(neighbors.shortlist(asked, lines_, 16), "shortlist")
    return ranking.evaluate_ranking(asked, lines_, found, failing_scorer, k=16, pool=4, policy="max_yes_no_margin", inject=False)


@query
def label_failed_scores(spark, sf):
    """Labels and scores where scoring failed in every way."""
    return failing(spark, sf).filter("scored").select(
        "query_id", "cat_id", "label", F.when(F.isnan("margin"), "none").otherwise(F.round("margin", 6).cast("string")).alias("margin"),
        (F.col("pick_score") == float("-inf")).alias("is_last"),
    )


@query
def pick_best_of_failed(spark, sf):
    """The best of four candidates, failed ones after all others."""
    return ranking.pick_best(failing(spark, sf).filter("scored")).select(
        "query_id", "predicted", "predicted_prefers_yes", "is_correct"
    )


@query
def topk_accuracy_of_failed(spark, sf):
    """Truths among the first three, failed candidates after unscored ones."""
    return reports.topk_accuracy(r.vector_queries(spark, sf), failing(spark, sf), 3).select(
        F.round("accuracy", 6).alias("accuracy")
    )


# --- contents of records and artifacts ---------------------------------------


@query
def evaluation_maps(spark, sf):
    """Every value of the maps of the evaluation records."""
    records = ranking.evaluation_records(r.ranked(spark, sf), "encoder_margin_blend", 8)
    names = ("nll_yes", "nll_no", "margins", "pick_scores")
    return records.select("query_id", F.explode("encoder_cosine").alias("candidate", "cosine"), "scores", *names).select(
        "query_id", "candidate", F.round("cosine", 6).alias("cosine"), F.col("scores")[F.col("candidate")].alias("label"),
        *(F.round(F.try_element_at(n, F.col("candidate")), 5).alias(n) for n in names),
    )


@query
def flat_record_maps(spark, sf):
    """The JSON texts of the flat records, read back value by value."""
    records = ranking.evaluation_records(r.ranked(spark, sf), "encoder_margin_blend", 8)
    flat = reports.to_flat_records(records)
    as_map = "map<string,double>"
    read = [F.from_json(f"{n}_json", as_map).alias(n) for n in ("nll_yes", "nll_no", "margins", "pick_scores", "encoder_cosine")]
    maps = flat.select("noisy", *read)
    return maps.select("noisy", F.explode("encoder_cosine").alias("candidate", "cosine"), "*").select(
        "noisy", "candidate", F.round("cosine", 6).alias("cosine"),
        *(F.round(F.try_element_at(n, F.col("candidate")), 5).alias(n) for n in ("nll_yes", "nll_no", "margins", "pick_scores")),
    )


@query
def catalog_contents(spark, sf):
    """Ids, lines and vectors of a catalog as it was written."""
    path = scratch_path(spark, "catalog")
    lines_ = catalog.distinct_catalog(r.noisy(spark, sf))
    writers.write_catalog(catalog.with_vectors(lines_, ngram_encoder(r.DIMS)), path)
    read = spark.read.parquet(path).select("cat_id", "canonical", F.posexplode("vec").alias("slot", "w"))
    return read.filter("w != 0").select(
        "cat_id", "canonical", F.col("slot").cast("long").alias("slot"), F.round(F.col("w").cast("double"), 5).alias("w")
    )


@query
def negatives_contents(spark, sf):
    """Rows and negatives of both splits as they were written."""
    path = scratch_path(spark, "negatives")
    parts = split.exact_split(r.vector_train(spark, sf), 0.1, SEED)
    train = mining.mine_hard_negatives(parts.filter("split = 'train'"), r.vectors(spark, sf), per_neighbor=2)
    test = parts.filter("split = 'test'").withColumn("hard_negatives", F.array().cast("array<string>"))
    writers.write_negatives(augment.union_all([train, test]), path)
    return spark.read.parquet(path).select(
        "row_id", CANONICAL, NOISY, "split", F.array_join("hard_negatives", "|").alias("hard_negatives")
    )


@query
def merged_rows(spark, sf):
    """Every train row with its own columns and the mined ones."""
    return r.mined(spark, sf).select(
        "row_id", CANONICAL, NOISY, F.size("hard_negatives").alias("n_negatives"),
        F.array_join("hard_negatives", "|").alias("hard_negatives"),
    )


@query
def pairs_contents(spark, sf):
    """Token ids, masks and labels of pairs as they were written."""
    path = scratch_path(spark, "pairs")
    writers.write_pairs(pairs.tokenize_pairs(pairs.make_pairs(r.mined(spark, sf)), 128, target_len=8), path)
    return readers.read_pairs(spark, path).select(
        "row_id", "pos", F.md5(F.array_join("input_ids", " ")).alias("ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"),
        F.array_join("labels", " ").alias("labels"),
    )


# --- batches -----------------------------------------------------------------


@query
def append_noisy_batches(spark, sf):
    """Two batches, one sent twice, and a try that broke off before it was committed."""
    rows, place = r.noisy(spark, sf), scratch_path(spark, "batches")
    first, second = rows.filter("row_id % 2 = 0"), rows.filter("row_id % 2 = 1")
    batches.append_batch(first, place, "even")
    batches.append_batch(first, place, "even")
    batches.write_attempt(second, place)
    batches.append_batch(second, place, "odd")
    return batches.read_batches(spark, place).groupBy("st", STEPS).agg(
        F.count("*").alias("n_rows"), F.sum("row_id").alias("sum_ids")
    )


# --- tries -------------------------------------------------------------------


def part_trie(spark, sf) -> DataFrame:
    """Byte tokens of part names in two batches, the second one sent twice."""
    place = scratch_path(spark, "trie")
    names = r.part_names(spark, sf).select("p_partkey", tokens.byte_tokens(F.col("p_name")).alias("ids"))
    trie.extend(names.filter("p_partkey % 3 = 0"), place, "first")
    trie.extend(names, place, "second")
    trie.extend(names, place, "second")
    return trie.read(spark, place)


@query
def trie_nodes(spark, sf):
    """Distinct prefixes of part names by length, and what follows them."""
    return trie.nodes(part_trie(spark, sf))


@query
def allowed_next_from_trie(spark, sf):
    """What may follow each prefix of each part name, asked of the stored trie."""
    parts = r.part_names(spark, sf).select("p_partkey", tokens.byte_tokens(F.col("p_name")).alias("ids"))
    wanted = parts.select("*", F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("n_ids")).select(
        "p_partkey",
        F.col("n_ids").cast("long").alias("n_ids"),
        F.concat(F.array(F.lit(0)), F.slice("ids", F.lit(1), F.col("n_ids"))).alias("prefix"),
    )
    return trie.allowed_next(wanted, part_trie(spark, sf)).select(
        "p_partkey", "n_ids", F.array_join("allowed", " ").alias("allowed")
    )


# --- pooling -----------------------------------------------------------------


def _pooled(padded: bool) -> Query:
    def run(spark, sf):
        vectors = table(spark, sf, "embeddings").filter("vec_id < 259").selectExpr(
            "CAST(vec_id AS INT) AS token_id", "embedding AS vec"
        )
        texts = r.lines(spark, sf).select("line_id", tokens.byte_tokens(F.col(CANONICAL)).alias("ids"))
        batch = F.floor(F.col("line_id") / 64) if padded else None
        made = pooling.mean_over_tokens(texts, vectors, "line_id", batch=batch, limit=40)
        return made.select("line_id", F.posexplode("vec").alias("slot", "w")).select(
            "line_id", F.col("slot").cast("long").alias("slot"), F.round("w", 6).alias("w")
        )

    return run


r.QUERIES |= {"mean_over_tokens": _pooled(False), "mean_over_padded_tokens": _pooled(True)}


# --- many to many ------------------------------------------------------------


def _named(spark, sf, row: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias(row), F.upper("p_name").alias(NOISY), "p_type")


@query
def join_repeated_predictions(spark, sf):
    """Every part name with every prediction made for it, few names being common to very many."""
    rows = _named(spark, sf, "row_id").drop("p_type")
    predictions = _named(spark, sf, "prediction_id").filter("prediction_id % 5 < 2").withColumnRenamed(
        "p_type", "predicted"
    )
    out = reports.join_repeated_predictions(rows, predictions, rows_per_split=7)
    return out.select("row_id", NOISY, "prediction_id", "predicted")


@query
def join_predictions_by_row(spark, sf):
    """Every part name with the prediction made for its own row."""
    rows = _named(spark, sf, "row_id").drop("p_type")
    predictions = _named(spark, sf, "row_id").filter("row_id % 5 < 2").select("row_id", F.col("p_type").alias("predicted"))
    return reports.join_predictions_by_row(rows, predictions).select("row_id", NOISY, "predicted")
