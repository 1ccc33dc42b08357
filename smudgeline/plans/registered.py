"""Every registered query, on the supplied tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MatchConfig
from ..functions import clean, draws, lexicons, noise, scoring, similarity, steps, tokens
from ..functions.encoders import ngram_encoder
from ..functions.exprs import as_text as as_text_
from ..functions.exprs import distinct_sorted, words_literal
from ..functions.exprs import json_text as json_text_
from ..operators import augment, catalog, neighbors, negatives, pairs, ranking, reports, split
from ..operators.augment import CANONICAL, NOISY, STEPS
from ..session import scratch_path, stored
from ..sources import readers, writers
from . import build_noisy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

SEED = 42
ITERATIONS = 2
#: plans of the small noisy table most reports read
PLANS = [
    ["randomly_remove_vowels"],
    ["randomly_replace_spaces"],
    ["randomly_remove_vowels", "randomly_replace_spaces"],
]
DIMS = 64

# the line view: the same text in Spark SQL and in the check queries
SUFFIX = (
    "CASE WHEN p_size % 100 IN (11, 12, 13) THEN 'TH' WHEN p_size % 10 = 1 THEN 'ST' "
    "WHEN p_size % 10 = 2 THEN 'ND' WHEN p_size % 10 = 3 THEN 'RD' ELSE 'TH' END"
)
DIRECTION = (
    "CASE p_partkey % 9 WHEN 1 THEN 'N' WHEN 2 THEN 'S' WHEN 3 THEN 'E' WHEN 4 THEN 'W' "
    "WHEN 5 THEN 'NW' WHEN 6 THEN 'NE' WHEN 7 THEN 'SW' WHEN 8 THEN 'SE' END"
)
LINE = (
    f"upper(concat_ws(' ', CAST(100 + p_partkey AS VARCHAR(20)), {DIRECTION}, p_name, "
    f"concat(CAST(p_size AS VARCHAR(20)), {SUFFIX}), 'ST'))"
)
FORMS = [f for forms in lexicons.MIXED_DIRECTIONS.values() for f in forms]


def _form(key: str) -> str:
    return "CASE " + key + " " + " ".join(f"WHEN {i} THEN '{f}'" for i, f in enumerate(FORMS)) + " END"


MIXED_LINE = (
    f"concat_ws(' ', CAST(100 + p_partkey AS VARCHAR(20)), {_form('p_partkey % 16')}, p_name, "
    f"{_form('CAST(floor(p_partkey / 16) AS INT) % 16')}, 'St')"
)


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lines(spark: SparkSession, sf: str, text: str = LINE) -> DataFrame:
    return table(spark, sf, "part").selectExpr(
        "p_partkey AS line_id", f"CAST({text} AS STRING) AS first_line", "p_type AS st"
    )


def noisy(spark: SparkSession, sf: str) -> DataFrame:
    return augment.augment_grid(
        lines(spark, sf), PLANS, ITERATIONS, SEED, partitions=spread(spark)
    ).select("row_id", "line_id", CANONICAL, NOISY, STEPS, "n_steps", "st")


def line_base() -> Column:
    return draws.base(SEED, F.col("line_id"), F.lit(1), F.lit(0))


# --- noise -------------------------------------------------------------------


def _noise(fn, text: str = LINE, **options) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        src = lines(spark, sf, text).repartition(spread(spark), "line_id")
        made = src.withColumn("b", line_base()).select(
            "line_id", fn(F.col(CANONICAL), F.col("b"), **options).alias("r")
        )
        return made.select("line_id", "r.text", "r.step")

    return run


QUERIES |= {
    "noise_replace_char": _noise(noise.replace_char),
    "noise_repeat_characters": _noise(noise.repeat_characters),
    "noise_repeat_part": _noise(noise.repeat_part),
    "noise_insert_random_word": _noise(noise.insert_random_word),
    "noise_insert_absent_word": _noise(noise.insert_random_word, whole_word=True),
    "noise_add_random_text": _noise(noise.add_random_text),
    "noise_convert_directions": _noise(noise.convert_directions, MIXED_LINE),
    "noise_change_case": _noise(noise.change_case),
    "noise_change_half_case": _noise(noise.change_case, max_share=0.5),
    "noise_add_special": _noise(noise.add_special),
    "noise_change_ordinals": _noise(noise.change_ordinals),
    "noise_change_directions": _noise(noise.change_directions),
    "noise_insert_random_directions": _noise(noise.insert_random_directions),
    "noise_insert_directions_if_absent": _noise(
        noise.insert_random_directions, skip_if_present=True
    ),
    "noise_remove_vowels": _noise(noise.remove_vowels),
    "noise_replace_spaces": _noise(noise.replace_spaces),
    "noise_insert_direction": _noise(noise.insert_direction),
}


@query
def apply_steps(spark, sf):
    src = augment.add_working_column(lines(spark, sf).repartition(spread(spark), "line_id"))
    out = augment.apply_steps(src, PLANS[2], SEED, iteration=F.lit(1))
    return out.select("line_id", NOISY, STEPS)


@query
def augment_grid(spark, sf):
    return noisy(spark, sf).select("row_id", "line_id", NOISY, STEPS, "n_steps")


@query
def augment_all_steps(spark, sf):
    """The default grid over all lines, one iteration: rows and changed rows per step."""
    rows = build_noisy.noisy_rows(
        lines(spark, sf), iterations=1, sample=None, seed=SEED, partitions=spread(spark)
    )
    return rows.groupBy(F.get("steps_arr", F.lit(0)).alias("step")).agg(
        F.count("*").alias("n_rows"), F.count_distinct("line_id").alias("n_lines")
    )


@query
def step_plans(spark, sf):
    """Rows each two-step plan gives per type."""
    plans = [",".join(p) for p in augment.plan_lists(noise.GRID_STEPS, 2)]
    types = lines(spark, sf).groupBy("st").agg(F.count("*").alias("n_rows"))
    return types.select("st", F.explode(words_literal(plans)).alias("plan"), "n_rows")


@query
def step_permutations(spark, sf):
    """Rows the ordered three-step plans of each first step give."""
    plans = [p[0] for p in augment.plan_lists(noise.GRID_STEPS, 3, ordered=True)]
    sizes = lines(spark, sf).agg(F.count("*").alias("n"))
    return (
        sizes.select("n", F.explode(words_literal(plans)).alias("first_step"))
        .groupBy("first_step")
        .agg(F.count("*").alias("n_plans"), F.sum("n").alias("n_rows"))
    )


@query
def sample_lines(spark, sf):
    return augment.sample_lines(lines(spark, sf), 1000, SEED).select("line_id", CANONICAL)


@query
def add_working_column(spark, sf):
    return augment.add_working_column(lines(spark, sf)).select("line_id", NOISY, STEPS)


@query
def unpack_step(spark, sf):
    src = augment.add_working_column(lines(spark, sf)).withColumn(
        "r", noise.remove_vowels(F.col(NOISY), line_base())
    )
    return augment.unpack_step(src, "r").select("line_id", NOISY, STEPS)


# --- lexicons ----------------------------------------------------------------


def _words_of(df: DataFrame) -> DataFrame:
    """Words of each line, single and in neighbouring pairs, each once per line."""
    ws = F.split(CANONICAL, " ")
    spoken = df.select("line_id", ws.alias("ws")).select(
        "line_id",
        F.explode(
            F.array_distinct(
                F.concat(
                    "ws",
                    F.transform(
                        F.slice("ws", F.lit(2), F.size("ws") - 1),
                        lambda w, i: F.concat(F.get("ws", i), F.lit(" "), w),
                    ),
                )
            )
        ).alias("word"),
    )
    return spoken.groupBy("word").agg(F.count("*").alias("n_lines"))


@query
def direction_variants(spark, sf):
    """How many lines hold each spelling of each direction."""
    variants = lexicons.direction_table(spark).withColumn("word", F.trim("variant"))
    found = variants.join(_words_of(lines(spark, sf)), "word", "left")
    return found.select(
        "dir_group", "variant", F.coalesce("n_lines", F.lit(0)).alias("n_lines")
    )


@query
def lookalike_table(spark, sf):
    """Characters of the lines, how often they occur and what they may become."""
    chars = (
        lines(spark, sf)
        .select(F.explode(F.split(F.upper(CANONICAL), "")).alias("ch"))
        .groupBy("ch")
        .agg(F.count("*").alias("n_uses"))
    )
    alts = lexicons.lookalike_table(spark).select("ch", F.explode("alts").alias("alt"))
    return chars.join(alts, "ch")


@query
def ordinal_table(spark, sf):
    """Spellings of the ordinals that occur in the lines."""
    used = (
        table(spark, sf, "part")
        .groupBy(F.expr(f"concat(p_size, {SUFFIX})").alias("ordinal"))
        .agg(F.count("*").alias("n_lines"))
    )
    return used.join(lexicons.ordinal_table(spark), "ordinal").select(
        "ordinal", "n_lines", F.posexplode("alts").alias("at", "alt")
    )


@query
def word_table(spark, sf):
    """Lines per word of each category."""
    found = lexicons.word_table(spark).join(_words_of(lines(spark, sf)), "word", "left")
    return found.select("word", "category", F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


@query
def fraction_glyphs(spark, sf):
    text = clean.fraction_glyphs(F.col(CANONICAL), lexicons.FRACTIONS)
    return lines(spark, sf).select("line_id", text.alias("text"))


@query
def dedupe_alts(spark, sf):
    """Distinct characters of each line, sorted."""
    chars = distinct_sorted(F.split(CANONICAL, ""))
    return lines(spark, sf).select("line_id", F.array_join(chars, "").alias("alts"))


@query
def merge_maps(spark, sf):
    """The first line of each word, replaced by the last line that has it in third place."""
    words = lines(spark, sf).select("line_id", F.split(CANONICAL, " ").alias("words"))
    first = words.select(F.explode("words").alias("word"), F.col("line_id").alias("value"))
    third = words.select(F.get("words", F.lit(2)).alias("word"), F.col("line_id").alias("value"))
    return lexicons.merge_tables(
        first.groupBy("word").agg(F.min("value").alias("value")),
        third.filter(F.col("word").isNotNull()).groupBy("word").agg(F.max("value").alias("value")),
        "word",
    )


# --- steps and filters -------------------------------------------------------


def odd_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with steps strings of every odd kind."""
    kinds = "CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ', a' WHEN 3 THEN ', a, b' " \
        "WHEN 4 THEN 'a,,b' WHEN 5 THEN ' , ' WHEN 6 THEN ', a, b, c' ELSE 'a' END"
    return table(spark, sf, "part").selectExpr("p_partkey AS line_id", f"{kinds} AS {STEPS}")


@query
def step_segments(spark, sf):
    segments = steps.step_segments(F.col(STEPS))
    return odd_steps(spark, sf).select(
        "line_id", F.size(segments).alias("n"), F.array_join(segments, "+").alias("segments")
    )


def _kept(mode: str, low: int = 1, high: int = 1) -> Query:
    def run(spark, sf):
        return odd_steps(spark, sf).filter(steps.passes(F.col(STEPS), mode, low, high))

    return run


def _kept_by_sql(mode: str, low: int = 1, high: int = 1) -> Query:
    def run(spark, sf):
        where = steps.where_clause(STEPS, mode, low, high)
        rows = odd_steps(spark, sf)
        return rows.filter(where) if where else rows

    return run


QUERIES |= {
    "filter_steps_none": _kept("none"),
    "filter_steps_one_comma": _kept("legacy_one_comma"),
    "filter_steps_min": _kept("min_steps", 2),
    "filter_steps_max": _kept("max_steps", high=1),
    "filter_steps_sql_none": _kept_by_sql("none"),
    "filter_steps_sql_one_comma": _kept_by_sql("legacy_one_comma"),
    "filter_steps_sql_min": _kept_by_sql("min_steps", 2),
    "filter_steps_sql_max": _kept_by_sql("max_steps", high=1),
}


@query
def keep_known(spark, sf):
    rows = odd_steps(spark, sf).withColumn("noisy", F.nullif(STEPS, F.lit("")))
    return catalog.keep_known(rows, "line_id", "noisy").select("line_id", "noisy")


@query
def as_text(spark, sf):
    return table(spark, sf, "part").select(
        as_text_(F.col("p_partkey")).alias("key"), as_text_(F.col("p_size")).alias("text")
    )


# --- sources and sinks -------------------------------------------------------


def _name(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex[:12]}"


@query
def create_and_append_noisy(spark, sf):
    rows, name = noisy(spark, sf), _name("noisy")
    writers.create_noisy_table(spark, name, rows, scratch_path(spark, name), "noisy lines")
    writers.append_noisy(rows, name)
    return spark.table(name).groupBy("st", STEPS).agg(F.count("*").alias("n_rows"))


@query
def read_noisy_table(spark, sf):
    rows, name = noisy(spark, sf), _name("noisy")
    writers.create_noisy_table(spark, name, rows, scratch_path(spark, name))
    writers.append_noisy(rows, name)
    cfg = MatchConfig(source_table=name)
    return readers.read_lines(spark, cfg).select("row_id", NOISY, STEPS)


@query
def read_noisy_parquet(spark, sf):
    path = scratch_path(spark, "noisy")
    noisy(spark, sf).write.parquet(path)
    cfg = MatchConfig(source_parquet=path, steps_filter="min_steps", steps_min=2)
    return readers.read_lines(spark, cfg).select("row_id", NOISY, STEPS)


@query
def temp_view(spark, sf):
    name = _name("view")
    readers.temp_view(noisy(spark, sf), name)
    return spark.sql(
        f"SELECT {CANONICAL}, count(*) AS record_count FROM {name} GROUP BY 1 ORDER BY 1"
    )


@query
def limit_rows(spark, sf):
    """No cap for 0 and null: both counts are those of the whole table."""
    rows = lines(spark, sf)
    counts = [
        readers.limit_rows(rows, n).agg(F.lit(str(n)).alias("cap"), F.count("*").alias("n_rows"))
        for n in (None, 0, 100)
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def union_all(spark, sf):
    src = lines(spark, sf)
    parts = [
        augment.apply_steps(augment.add_working_column(src), plan, SEED, iteration=F.lit(1))
        for plan in PLANS[:2]
    ]
    return augment.union_all(parts).groupBy(STEPS).agg(F.count("*").alias("n_rows"))


# --- counts ------------------------------------------------------------------


@query
def step_distribution(spark, sf):
    return reports.step_distribution(noisy(spark, sf))


@query
def line_distribution(spark, sf):
    return reports.line_distribution(noisy(spark, sf))


@query
def line_distribution_by_name(spark, sf):
    rows = table(spark, sf, "part").select(F.upper("p_name").alias(CANONICAL))
    return reports.line_distribution(rows, by_name=True)


@query
def row_count(spark, sf):
    return reports.row_count(noisy(spark, sf))


@query
def distinct_catalog(spark, sf):
    return catalog.distinct_catalog(noisy(spark, sf))


@query
def distinct_catalog_of_names(spark, sf):
    """A small catalog under many rows."""
    return catalog.distinct_catalog(table(spark, sf, "part"), "p_name")


@query
def catalog_lookup(spark, sf):
    """Ids of part and supplier names in the catalog of all part names; supplier names are not in it."""
    parts = table(spark, sf, "part").select("p_partkey", "p_name")
    others = table(spark, sf, "supplier").select((-F.col("s_suppkey") - 1).alias("p_partkey"), F.col("s_name").alias("p_name"))
    held = catalog.distinct_catalog(parts, "p_name")
    return catalog.catalog_lookup(parts.unionByName(others), held, "p_name", "p_partkey").select(
        "p_partkey", "p_name", "cat_id"
    )


def names_noisy(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy rows over few catalog lines: every line of a part name has many."""
    parts = table(spark, sf, "part").selectExpr("p_partkey AS line_id", "upper(p_name) AS first_line")
    return augment.augment_grid(parts, PLANS[:2], 1, SEED, partitions=spread(spark))


@query
def group_noisy(spark, sf):
    grouped = catalog.group_noisy(names_noisy(spark, sf), per_list=25)
    return grouped.select(
        "canonical", "part", F.size("noisy_list").alias("n"),
        F.array_join("noisy_list", "\n").alias("texts"),
    )


@query
def rank_noisy(spark, sf):
    return catalog.rank_noisy(names_noisy(spark, sf)).select(
        "canonical", "noisy", "row_id", F.col("place").cast("long").alias("place")
    )


@query
def first_m_per_group(spark, sf):
    return catalog.first_variants(names_noisy(spark, sf), 5)


# --- cleaning and strings ----------------------------------------------------


def _cleaned(fn) -> Query:
    def run(spark, sf):
        docs = table(spark, sf, "documents").withColumn("out", fn(F.col("text")))
        return docs.select(
            "doc_id", F.length("out").alias("n"), F.md5("out").alias("digest")
        )

    return run


QUERIES |= {
    "strip_combining": _cleaned(clean.strip_combining),
    "squeeze_runs": _cleaned(clean.squeeze_runs),
    "specials_to_space": _cleaned(clean.specials_to_space),
    "clean_line": _cleaned(clean.clean_line),
}


@query
def jaro_winkler(spark, sf):
    score = similarity.jaro_winkler(F.col(CANONICAL), F.col(NOISY))
    return noisy(spark, sf).select("row_id", F.round(score, 9).alias("jw_score"))


@query
def rank_prompt(spark, sf):
    prompt = tokens.rank_prompt(F.col(NOISY), F.col(CANONICAL))
    return noisy(spark, sf).select("row_id", prompt.alias("prompt"))


@query
def tokenize_pad(spark, sf):
    """Byte tokens of conversation turns, cut or padded to 128."""
    turns = table(spark, sf, "conversations").withColumn("target", F.col("role"))
    ids = pairs.tokenize_pairs(turns, 128, text="text", target_len=32)
    return ids.select(
        "conv_id",
        "turn",
        F.array_join("input_ids", " ").alias("input_ids"),
        F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_tokens"),
        F.array_join("labels", " ").alias("labels"),
    )


@query
def tokenize_words(spark, sf):
    """Hashed word tokens, inside the JVM."""
    turns = table(spark, sf, "conversations").withColumn("target", F.col("role"))
    ids = pairs.tokenize_pairs(turns, 32, tokens.word_tokens, text="text")
    return ids.select(
        "conv_id", "turn", F.array_join("input_ids", " ").alias("input_ids"),
        F.array_join("attention_mask", "").alias("mask"),
    )


def part_names(spark: SparkSession, sf: str) -> DataFrame:
    """Names of parts, dealt out before prefixes multiply them: a small file would be one task."""
    return table(spark, sf, "part").select("p_partkey", "p_name").repartition(spread(spark), "p_partkey")


@query
def allowed_next(spark, sf):
    """What may follow each prefix of each part name, the empty and the whole one too."""
    parts = part_names(spark, sf).select("p_partkey", tokens.byte_tokens(F.col("p_name")).alias("ids"))
    sequences = parts.select("ids").distinct()
    wanted = parts.select(
        "*", F.explode(F.sequence(F.lit(0), F.size("ids") - 1)).alias("n_ids")
    ).select(
        "p_partkey",
        F.col("n_ids").cast("long").alias("n_ids"),
        F.concat(F.array(F.lit(0)), F.slice("ids", F.lit(1), F.col("n_ids"))).alias("prefix"),
    )
    return pairs.allowed_next(wanted, sequences).select(
        "p_partkey", "n_ids", F.array_join("allowed", " ").alias("allowed")
    )


@query
def run_stamp(spark, sf):
    # a wall-clock time, whatever the session's zone
    at = F.expr(
        "TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, 1764739202 + line_id * 86461)"
    )
    return lines(spark, sf).select(
        "line_id",
        scoring.run_stamp(at).alias("stamp"),
        scoring.run_stamp(at, compact=True).alias("compact"),
    )


@query
def json_text(spark, sf):
    made = F.map_from_arrays(F.array("c_name", F.lit("segment é")), F.array("c_mktsegment", "c_name"))
    return table(spark, sf, "customer").select("c_custkey", json_text_(made).alias("json"))


@query
def embed_lines(spark, sf):
    encode = ngram_encoder(DIMS)
    made = lines(spark, sf).select("line_id", F.posexplode(encode(F.col(CANONICAL))).alias("slot", "w"))
    return made.filter("w != 0").select(
        "line_id", F.col("slot").cast("long").alias("slot"), F.round(F.col("w").cast("double"), 5).alias("w")
    )


# --- vectors -----------------------------------------------------------------


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """The embeddings as a catalog: ``(cat_id, canonical, vec, label)``."""
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS cat_id", "concat('line ', lpad(vec_id, 8, '0')) AS canonical",
        "embedding AS vec", "label",
    )


def vector_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks for a line up to nine places before its own."""
    truth = "CASE WHEN vec_id >= label THEN vec_id - label ELSE vec_id END"
    return table(spark, sf, "embeddings").selectExpr(
        "vec_id AS query_id", "concat('text ', vec_id) AS noisy",
        f"concat('line ', lpad({truth}, 8, '0')) AS truth", "embedding AS vec",
    )


def drawn_scorer(df: DataFrame) -> DataFrame:
    """Scores from draws, so any engine can recompute them."""
    at = draws.base(SEED, F.col("query_id"), F.col("cat_id"))
    return (
        df.withColumn("_at", at)
        .withColumn("nll_yes", draws.uniform(F.col("_at"), 1) * 5)
        .withColumn("nll_no", draws.uniform(F.col("_at"), 2) * 5)
        .drop("_at")
    )


def shortlisted(spark, sf, k: int = 64) -> DataFrame:
    return neighbors.shortlist(vector_queries(spark, sf), vectors(spark, sf), k)


def ranked(
    spark, sf, policy: str = "encoder_margin_blend", k: int = 16, pool: int = 8, inject: bool = True
) -> DataFrame:
    asked, lines_ = vector_queries(spark, sf), vectors(spark, sf)
    found = stored(neighbors.shortlist(asked, lines_, k), "shortlist")
    return ranking.evaluate_ranking(
        asked, lines_, found, drawn_scorer,
        k=k, pool=pool, policy=policy, inject=inject, vectors=asked.select("query_id", "vec"),
    )


@query
def cosine_pairs(spark, sf):
    """Cosine of each vector with the mean of its label.

    Labels are few and so are their means, which Spark broadcasts by their size: no label is a hot key.
    """
    rows = table(spark, sf, "embeddings")
    means = rows.select("label", F.posexplode("embedding").alias("at", "x")).groupBy(
        "label", "at"
    ).agg(F.avg(F.col("x").cast("double")).alias("m")).groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("at", "m")))["m"].alias("mean")
    )
    near = similarity.cosine(F.col("embedding"), F.col("mean"))
    return rows.join(means, "label").select("vec_id", F.round(near, 6).alias("cosine"))


@query
def nearest_lines(spark, sf):
    found = neighbors.nearest_lines(vectors(spark, sf), 10)
    return found.select("cat_id", "near_id", "cosine", "place")


@query
def nearest_lines_by_pivots(spark, sf):
    """The same through cells and pivots, as a large catalog would be searched."""
    found = neighbors.nearest_lines(vectors(spark, sf), 10, chunk_rows=100, cell_rows=60)
    return found.select("cat_id", "near_id", "cosine", "place")


@query
def shortlist(spark, sf):
    return shortlisted(spark, sf).select(
        "query_id", "cat_id", "candidate", "cosine", "place"
    )


def vector_train(spark, sf) -> DataFrame:
    """Three noisy texts per line of the embeddings."""
    return vectors(spark, sf).select(
        F.col("canonical").alias(CANONICAL), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"),
        "cat_id", "label",
    ).select(
        (F.col("cat_id") * 3 + F.col("v")).alias("row_id"),
        F.when(F.col("label") == 3, F.lit("unknown line")).otherwise(F.col(CANONICAL)).alias(CANONICAL),
        F.concat(F.lit("noisy "), F.col("cat_id"), F.lit(" "), F.col("v")).alias(NOISY),
    )


def mined(spark, sf) -> DataFrame:
    return negatives.mine_hard_negatives(
        vector_train(spark, sf), vectors(spark, sf), per_neighbor=2
    )


@query
def mine_hard_negatives(spark, sf):
    return mined(spark, sf).select(
        "row_id", CANONICAL, NOISY, F.array_join("hard_negatives", "|").alias("hard_negatives")
    )


@query
def mine_hard_negatives_of_lines(spark, sf):
    """Negatives of noisy part lines, by the default encoder."""
    rows = stored(noisy(spark, sf), "noisy")
    lines_ = stored(
        catalog.with_vectors(catalog.distinct_catalog(rows), ngram_encoder(DIMS)), "catalog"
    )
    out = negatives.mine_hard_negatives(rows, lines_)
    return out.select("row_id", F.array_join("hard_negatives", "|").alias("hard_negatives"))


@query
def merge_negatives(spark, sf):
    """Train rows keep all their columns beside the mined ones."""
    return mined(spark, sf).groupBy(CANONICAL).agg(
        F.count("*").alias("n_rows"), F.sum(F.size("hard_negatives")).alias("n_negatives")
    )


@query
def exact_split(spark, sf):
    rows = stored(noisy(spark, sf), "noisy")
    return split.exact_split(rows, 0.1, SEED).select("row_id", "split")


@query
def make_pairs(spark, sf):
    return pairs.make_pairs(mined(spark, sf)).select("row_id", "pos", "prompt", "target")


@query
def pair_volume(spark, sf):
    return pairs.pair_volume(split.exact_split(mined(spark, sf), 0.1, SEED))


@query
def write_and_read_pairs(spark, sf):
    path = scratch_path(spark, "pairs")
    made = pairs.make_pairs(mined(spark, sf))
    writers.write_pairs(pairs.tokenize_pairs(made, 128), path)
    read = readers.read_pairs(spark, path)
    return read.groupBy("pos").agg(
        F.count("*").alias("n_pairs"),
        F.sum(F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)).alias("n_tokens"),
        F.sum(F.size("input_ids")).alias("n_ids"),
    )


@query
def write_catalog(spark, sf):
    path = scratch_path(spark, "catalog")
    lines_ = catalog.distinct_catalog(noisy(spark, sf))
    writers.write_catalog(catalog.with_vectors(lines_, ngram_encoder(DIMS)), path)
    return spark.read.parquet(path).select("cat_id", "canonical", F.size("vec").alias("dims"))


@query
def write_negatives(spark, sf):
    path = scratch_path(spark, "negatives")
    parts = split.exact_split(vector_train(spark, sf), 0.1, SEED)
    train = negatives.mine_hard_negatives(
        parts.filter("split = 'train'"), vectors(spark, sf), per_neighbor=2
    )
    test = parts.filter("split = 'test'").withColumn(
        "hard_negatives", F.array().cast("array<string>")
    )
    writers.write_negatives(train.unionByName(test), path)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count("*").alias("n_rows"), F.sum(F.size("hard_negatives")).alias("n_negatives")
    )


# --- ranking -----------------------------------------------------------------


@query
def inject_truth(spark, sf):
    asked, lines_ = vector_queries(spark, sf), vectors(spark, sf)
    cands = ranking.candidates(asked, stored(neighbors.shortlist(asked, lines_, 16), "shortlist"))
    out = ranking.inject_truth(cands, lines_, 16, asked.select("query_id", "vec"))
    return out.select(
        "query_id", "cat_id", "candidate", "cosine", "place", "was_injected"
    )


@query
def ranker_pool(spark, sf):
    cands = ranking.candidates(vector_queries(spark, sf), shortlisted(spark, sf))
    return ranking.ranker_pool(cands, 24).select("query_id", "candidate", "place")


@query
def minmax_norm(spark, sf):
    normed = ranking.minmax_norm(ranking.ranker_pool(shortlisted(spark, sf), 24))
    return normed.select("query_id", "cat_id", F.round("cosine_norm", 5).alias("cosine_norm"))


@query
def yes_no_label(spark, sf):
    rows = drawn_scorer(shortlisted(spark, sf, 5))
    failed = F.when(F.col("place") == 4, F.lit(None).cast("double")).otherwise(F.col("nll_yes"))
    label = scoring.yes_no_label(failed, F.when(F.col("place") == 5, failed).otherwise(F.col("nll_no")))
    return rows.select("query_id", "cat_id", label.alias("label"))


@query
def score_pairs(spark, sf):
    """The default scorer on noisy lines and their own canonical line."""
    rows = noisy(spark, sf).select(
        "row_id", F.col(NOISY).alias("noisy"), F.col(CANONICAL).alias("candidate")
    )
    out = ranking.score_pairs(rows, scoring.edit_scorer())
    return out.select(
        "row_id", F.round("nll_yes", 6).alias("nll_yes"), F.round("nll_no", 6).alias("nll_no"), "label"
    )


def _picked(policy: str) -> Query:
    def run(spark, sf):
        scored = ranked(spark, sf, policy).filter("scored")
        return scored.select(
            "query_id", "cat_id", F.round("margin", 6).alias("margin"),
            F.round("pick_score", 5).alias("pick_score"),
        )

    return run


QUERIES |= {f"pick_score_{p}": _picked(p) for p in scoring.POLICIES}


@query
def pick_best(spark, sf):
    return ranking.pick_best(ranked(spark, sf).filter("scored")).select(
        "query_id", "predicted", "predicted_prefers_yes", "is_correct"
    )


@query
def score_legacy(spark, sf):
    """The first candidate labelled "yes" in catalog order."""
    labelled = ranked(spark, sf).filter("scored")
    return ranking.score_legacy(vector_queries(spark, sf), labelled).select(
        "query_id", "predicted", "is_correct"
    )


@query
def evaluate_ranking(spark, sf):
    records = ranking.evaluation_records(ranked(spark, sf), "encoder_margin_blend", 8)
    return records.select(
        "query_id", "noisy", "true", "predicted", "predicted_prefers_yes", "is_correct",
        F.size("scores").alias("n_scores"), F.size("encoder_cosine").alias("n_cosines"),
        F.array_join("ranker_pool", "|").alias("ranker_pool"),
        F.array_join("shortlist", "|").alias("shortlist"),
    )


@query
def top1_accuracy(spark, sf):
    return reports.top1_accuracy(ranking.pick_best(ranked(spark, sf).filter("scored"))).select(
        F.round("accuracy", 6).alias("accuracy")
    )


def _top_k(k: int, **options) -> Query:
    def run(spark, sf):
        rows = ranked(spark, sf)
        asked = vector_queries(spark, sf)
        return reports.topk_accuracy(asked, rows, k, **options).select(
            F.round("accuracy", 6).alias("accuracy")
        )

    return run


QUERIES |= {
    "topk_accuracy": _top_k(3),
    "topk_accuracy_by_nll": _top_k(3, by_pick_score=False),
    "top10_accuracy": _top_k(10),
}


@query
def topk_accuracy_legacy(spark, sf):
    rows = ranked(spark, sf).filter("scored")
    return reports.topk_accuracy_legacy(vector_queries(spark, sf), rows, 3).select(
        F.round("accuracy", 6).alias("accuracy")
    )


@query
def top1_without_injection(spark, sf):
    scored = ranked(spark, sf, inject=False).filter("scored")
    return reports.top1_accuracy(ranking.pick_best(scored)).select(
        F.round("accuracy", 6).alias("accuracy")
    )


@query
def limit_eval(spark, sf):
    """The first hundred rows are those a run with that setting scores."""
    return ranking.limit_eval(noisy(spark, sf), 100).select("row_id", NOISY)


# --- report tables -----------------------------------------------------------


def report(spark: SparkSession, sf: str) -> DataFrame:
    """Noisy rows with a prediction: right for most, a neighbour or none for others."""
    rows = noisy(spark, sf)
    guess = (
        F.when(F.col("row_id") % 7 == 0, F.lit(None).cast("string"))
        .when(F.col("row_id") % 5 == 0, F.col(NOISY))
        .otherwise(F.col(CANONICAL))
    )
    out = rows.withColumn("predicted", guess).withColumn("reference", F.col(CANONICAL))
    return reports.add_jw(out, CANONICAL, "predicted")


@query
def jw_by_steps(spark, sf):
    return reports.jw_by_steps(report(spark, sf)).select(
        STEPS, F.round("avg_jw", 6).alias("avg_jw"), "record_count"
    )


@query
def hardest_steps(spark, sf):
    return reports.hardest_steps(report(spark, sf))


@query
def worst_examples(spark, sf):
    out = reports.worst_examples(report(spark, sf), ", randomly_replace_spaces")
    return out.withColumn("jw_score", F.round("jw_score", 6))


@query
def join_predictions(spark, sf):
    rows = noisy(spark, sf)
    predictions = rows.groupBy(NOISY).agg(F.min(CANONICAL).alias("predicted"))
    out = reports.join_predictions(rows, predictions)
    return out.select("row_id", NOISY, "predicted")


@query
def write_report_table(spark, sf):
    name = _name("report")
    writers.write_report_table(report(spark, sf), name)
    return spark.table(name).groupBy(STEPS).agg(
        F.count("*").alias("n_rows"), F.round(F.sum("jw_score"), 4).alias("sum_jw")
    )


@query
def to_flat_records(spark, sf):
    records = ranking.evaluation_records(ranked(spark, sf), "encoder_margin_blend", 8)
    out = reports.to_flat_records(records, None)
    return out.select(
        "noisy", "true", "predicted", "predicted_prefers_yes", "is_correct",
        "eval_pick_policy", "eval_ranker_max_encoder_rank", "ranker_pool_json", "scores_json", "shortlist_json",
    )


@query
def write_predictions(spark, sf):
    name = _name("predictions")
    records = ranking.evaluation_records(ranked(spark, sf), "encoder_margin_blend", 8)
    writers.write_predictions(reports.predictions_table(records), name)
    return spark.table(name).select(
        "noisy", "true_canonical", "predicted", "is_correct", "predicted_prefers_yes",
        "scores_json", F.round("jw_score", 6).alias("jw_score"),
    )


def noisy_queries(spark: SparkSession, sf: str, iterations: int = 1) -> DataFrame:
    """Every line under every step of the default grid, with its vector."""
    rows = build_noisy.noisy_rows(
        lines(spark, sf), iterations=iterations, sample=None, seed=SEED, partitions=spread(spark)
    )
    return rows.select(
        F.col("row_id").alias("query_id"),
        F.col(NOISY).alias("noisy"),
        F.col(CANONICAL).alias("truth"),
        F.col(STEPS).alias("steps"),
        ngram_encoder(DIMS)(F.col(NOISY)).alias("vec"),
    )


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Noise, embed, shortlist, pick, and accuracy per steps string."""
    asked = stored(noisy_queries(spark, sf), "asked")
    lines_ = stored(
        catalog.with_vectors(catalog.distinct_catalog(lines(spark, sf)), ngram_encoder(DIMS)),
        "catalog",
    )
    ranked_ = ranking.evaluate_ranking(
        asked, lines_, stored(neighbors.shortlist(asked, lines_, 24), "shortlist"),
        scoring.edit_scorer(), k=24, pool=0, inject=False,
    )
    best = ranking.pick_best(ranked_)
    return (
        best.join(asked.select("query_id", "steps"), "query_id")
        .groupBy("steps")
        .agg(
            F.count("*").alias("n_rows"),
            F.round(F.avg(F.col("is_correct").cast("double")), 6).alias("accuracy"),
        )
        .orderBy("accuracy", "steps")
    )


QUERIES["accuracy_by_steps"] = flagship
