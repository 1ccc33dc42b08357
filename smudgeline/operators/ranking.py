"""Scoring shortlisted candidates and picking one, in long form.

A candidate row is ``(query_id, noisy, truth, cat_id, candidate, cosine, place)`` with
``place`` starting at 1. All windows are per query, whose rows a shortlist bounds.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..functions.similarity import cosine
from ..functions.tokens import RANK_PROMPT, rank_prompt
from ..session import stored
from .augment import made_once
from .skew import ROWS_PER_SPLIT, skew_join
from .split import SORTED_ROWS, first_by

#: catalog lines of a block, queries that meet a block in one place, blocks of the first round
BLOCK_LINES, BLOCK_QUERIES, FIRST_BLOCKS = 1024, 4096, 1

log = logging.getLogger(__name__)


def limit_eval(rows: DataFrame, n: int | None, key: str = "row_id") -> DataFrame:
    """The first ``n`` rows by a unique integer key; null means all.

    A large ``n`` is found as a cut in the keys, and the rows are filtered where they lie.
    """
    if n is None or n <= SORTED_ROWS:
        return rows if n is None else rows.orderBy(key).limit(n)
    return first_by(rows, F.col(key).cast("long"), key, n)


def candidates(queries: DataFrame, found: DataFrame) -> DataFrame:
    """Attach ``queries(query_id, noisy, truth)`` to a shortlist."""
    return found.join(queries.select("query_id", "noisy", "truth"), "query_id")


def inject_truth(
    cands: DataFrame,
    catalog: DataFrame,
    k: int,
    vectors: DataFrame,
    rows_per_split: int = ROWS_PER_SPLIT,
) -> DataFrame:
    """Put a truth the shortlist missed first, and drop what no longer fits in ``k``.

    Adds ``was_injected``. ``vectors(query_id, vec)`` gives the added row its cosine. A truth
    outside the catalog cannot be scored and adds nothing. ``cands`` is read twice: store a shortlist before.
    """
    is_hit = F.coalesce(F.col("candidate") == F.col("truth"), F.lit(False))
    # noisy and truth are the same in all rows of a query; counted for hot truths and joined, so made once
    missed = stored(
        cands.groupBy("query_id")
        .agg(F.max(is_hit).alias("_hit"), F.first("noisy").alias("noisy"), F.first("truth").alias("truth"))
        .filter(~F.col("_hit"))
        .drop("_hit"),
        "missed",
    )
    lines = catalog.select(
        "cat_id", F.col("canonical").alias("truth"), "vec"
    )
    added = skew_join(missed, lines, "truth", "inner", "query_id", rows_per_split)
    added = added.join(vectors.select("query_id", F.col("vec").alias("_query")), "query_id")
    near = F.round(cosine(F.col("_query"), F.col("vec")), 9)
    columns = ["query_id", "noisy", "truth", "cat_id", "candidate", "cosine", "place"]
    rows = cands.select(*columns, F.lit(False).alias("was_injected")).unionByName(
        added.withColumn("candidate", F.col("truth"))
        .withColumn("cosine", near)
        .withColumn("place", F.lit(0))
        .select(*columns, F.lit(True).alias("was_injected"))
    )
    order = Window.partitionBy("query_id").orderBy("place")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def ranker_pool(cands: DataFrame, n: int = 24) -> DataFrame:
    """The first ``n`` candidates of each query; 0 keeps all."""
    return cands.filter(F.col("place") <= n) if n > 0 else cands


def score_pairs(
    cands: DataFrame, scorer: scoring.Scorer, template: str = RANK_PROMPT
) -> DataFrame:
    """Add the prompt, ``nll_yes``, ``nll_no`` and ``label``."""
    asked = cands.withColumn(
        "prompt", rank_prompt(F.col("noisy"), F.col("candidate"), template)
    )
    return scorer(asked).withColumn(
        "label", scoring.yes_no_label(F.col("nll_yes"), F.col("nll_no"))
    )


def minmax_norm(cands: DataFrame, value: str = "cosine", out: str = "cosine_norm") -> DataFrame:
    """The value from lowest to highest of its query, as 0 to 1; spans are at least 1e-8."""
    query = Window.partitionBy("query_id")
    low, high = F.min(value).over(query), F.max(value).over(query)
    return cands.withColumn(out, (F.col(value) - low) / F.greatest(high - low, F.lit(1e-8)))


def add_pick_scores(
    scored: DataFrame, policy: str = "encoder_margin_blend", weight: float = 2.0
) -> DataFrame:
    """Add ``cosine_norm``, ``margin`` and ``pick_score``."""
    name = scoring.policy_name(policy)
    yes, no = F.col("nll_yes"), F.col("nll_no")
    return (
        minmax_norm(scored)
        .withColumn("margin", scoring.margin(yes, no))
        .withColumn("pick_score", scoring.pick_score(name, yes, no, F.col("cosine_norm"), weight))
    )


def _standing() -> Column:
    """What the best candidate of a query has the highest of."""
    worked = ~scoring.failed(F.col("nll_yes"), F.col("nll_no"))
    return F.struct(worked, "pick_score", -F.col("place"))


def pick_best(scored: DataFrame) -> DataFrame:
    """One row per query: the highest pick score, the earlier place on ties.

    A candidate whose scoring failed comes after all others, those that cost infinitely much included.
    """
    row = F.struct("noisy", "truth", "candidate", "nll_yes", "nll_no")
    best = scored.groupBy("query_id").agg(F.max_by(row, _standing()).alias("b"))
    return best.select("query_id", "b.noisy", "b.truth", *_verdict("b"))


def _verdict(best: str) -> list[Column]:
    row = F.col(best)
    return [
        row["candidate"].alias("predicted"),
        F.coalesce(row["nll_yes"] < row["nll_no"], F.lit(False)).alias("predicted_prefers_yes"),
        F.coalesce(row["candidate"] == row["truth"], F.lit(False)).alias("is_correct"),
    ]


def score_legacy(queries: DataFrame, labelled: DataFrame) -> DataFrame:
    """Per query the first candidate labelled "yes" in catalog order, null if there is none."""
    first = (
        labelled.filter(F.col("label") == "yes")
        .groupBy("query_id")
        .agg(F.min_by("candidate", "cat_id").alias("predicted"))
    )
    return queries.join(first, "query_id", "left").withColumn(
        "is_correct", F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False))
    )


def score_legacy_whole(
    queries: DataFrame,
    catalog: DataFrame,
    scorer: scoring.Scorer,
    template: str = RANK_PROMPT,
    block_lines: int = BLOCK_LINES,
    block_queries: int = BLOCK_QUERIES,
    rounds: list[dict] | None = None,
) -> DataFrame:
    """``queries`` with ``predicted``, the first line of the whole catalog labelled "yes", and ``is_correct``.

    ``queries`` is ``(query_id, noisy, truth)`` with unique ids, ``catalog`` ``(cat_id, canonical)``. Lines are
    asked about in order of ``cat_id``, in blocks of ids; each round takes twice as many blocks as the one
    before, and only queries without an answer go on. Pairs are scored where a block and a chunk of
    queries meet and reduced to one answer a query before they leave. A query no line answers gets null.
    ``rounds`` takes a row for each round: queries asked, blocks and pairs.
    """
    block = F.floor(F.col("cat_id") / block_lines).cast("long")
    lines = catalog.select("cat_id", F.col("canonical").alias("candidate"), block.alias("_block"))
    sizes = stored(lines.groupBy("_block").agg(F.count("*").alias("n")), "legacy_blocks")
    at, last = sizes.agg(F.min("_block"), F.max("_block")).first()
    open_ = stored(queries.select("query_id", "noisy", "truth"), "legacy_queries")
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    answers, step, turn = [], FIRST_BLOCKS, 0
    while at is not None and at <= last:
        asked = open_.count()
        if not asked:
            break
        end = min(at + step, last + 1)
        chunks = -(-asked // block_queries)
        chunk = F.pmod(F.xxhash64("query_id"), F.lit(chunks)).cast("int")
        left = open_.withColumn("_chunk", chunk).withColumn(
            "_block", F.explode(F.sequence(F.lit(at).cast("long"), F.lit(end - 1).cast("long")))
        )
        right = lines.filter(F.col("_block").between(at, end - 1)).withColumn(
            "_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))
        )
        # blocks are small and their pairs many: dealt out by number, or few tasks would get them by their size
        met = [side.repartition(tasks, "_block", "_chunk") for side in (left, right)]
        pairs = met[0].join(met[1].hint("merge"), ["_block", "_chunk"]).drop("_block", "_chunk")
        labelled = score_pairs(pairs, scorer, template).select("query_id", "cat_id", "candidate", "label")
        found = stored(
            # a filter pushed into the join would work out the scores of a pair once for each place they are named in
            made_once(labelled, "label", F.col("label"))
            .filter(F.col("label") == "yes")
            .groupBy("query_id")
            .agg(F.min_by("candidate", "cat_id").alias("predicted")),
            "legacy_answers",
        )
        answers.append(found)
        lines_asked = sizes.filter(F.col("_block").between(at, end - 1)).agg(F.sum("n")).first()[0] or 0
        report = {"round": turn, "queries": asked, "blocks": end - at, "pairs": asked * lines_asked}
        log.info("whole catalog: %s", report)
        if rounds is not None:
            rounds.append(report)
        open_ = stored(open_.join(found, "query_id", "left_anti"), "legacy_queries")
        at, step, turn = end, 2 * step, turn + 1
    if not answers:
        none = queries.withColumn("predicted", F.lit(None).cast("string"))
        return none.withColumn("is_correct", F.lit(False))
    every = answers[0]
    for found in answers[1:]:
        every = every.unionByName(found)
    return queries.join(every, "query_id", "left").withColumn(
        "is_correct", F.coalesce(F.col("predicted") == F.col("truth"), F.lit(False))
    )


def evaluation_records(ranked: DataFrame, policy: str, pool: int) -> DataFrame:
    """One nested record per query: scalars, six maps and two lists in shortlist order.

    ``ranked`` is the result of :func:`evaluate_ranking`. One grouping by query makes it all.
    """
    name = scoring.policy_name(policy)
    fields = ["candidate", "cosine", "nll_yes", "nll_no", "label", "margin", "pick_score"]
    row = F.struct("noisy", "truth", *fields)
    grouped = ranked.groupBy("query_id").agg(
        F.max_by(row, F.when(F.col("scored"), _standing())).alias("b"),
        F.sort_array(F.collect_list(F.struct("place", "scored", *fields))).alias("_all"),
    )

    def as_map(rows: str, value) -> Column:
        return F.map_from_entries(
            F.transform(rows, lambda r: F.struct(r["candidate"], value(r)))
        )

    return grouped.withColumn("_pool", F.filter("_all", lambda r: r["scored"])).select(
        "query_id",
        "b.noisy",
        F.col("b.truth").alias("true"),
        *_verdict("b"),
        as_map("_pool", lambda r: r["label"]).alias("scores"),
        as_map("_pool", lambda r: scoring.known_nll(r["nll_yes"])).alias("nll_yes"),
        as_map("_pool", lambda r: scoring.known_nll(r["nll_no"])).alias("nll_no"),
        as_map("_pool", lambda r: r["margin"]).alias("margins"),
        as_map("_pool", lambda r: r["pick_score"]).alias("pick_scores"),
        as_map("_all", lambda r: r["cosine"]).alias("encoder_cosine"),
        F.lit(name).alias("eval_pick_policy"),
        F.lit(pool).alias("eval_ranker_max_encoder_rank"),
        F.col("_pool")["candidate"].alias("ranker_pool"),
        F.col("_all")["candidate"].alias("shortlist"),
    )


def evaluate_ranking(
    queries: DataFrame,
    catalog: DataFrame,
    found: DataFrame,
    scorer: scoring.Scorer,
    k: int = 64,
    pool: int = 24,
    policy: str = "encoder_margin_blend",
    weight: float = 2.0,
    inject: bool = True,
    vectors: DataFrame | None = None,
    template: str = RANK_PROMPT,
) -> DataFrame:
    """The shortlist in long form, the pool scored; ``scored`` marks the pool.

    ``found`` is the shortlist of :func:`neighbors.shortlist`. With ``inject`` off, a truth
    that was not retrieved stays a miss; with it on, ``vectors`` must be given, or an added truth
    would have no cosine to win by. Only pool rows reach the scorer.
    """
    if inject and vectors is None:
        raise ValueError("injecting truths needs vectors(query_id, vec)")
    cands = candidates(queries, found)
    if inject:
        cands = inject_truth(cands, catalog, k, vectors)
    else:
        cands = cands.withColumn("was_injected", F.lit(False))
    scored = add_pick_scores(
        score_pairs(ranker_pool(cands, pool), scorer, template).drop("prompt"), policy, weight
    ).withColumn("scored", F.lit(True))
    if pool <= 0:
        return scored
    rest = cands.filter(F.col("place") > pool).withColumn("scored", F.lit(False))
    return scored.unionByName(rest, allowMissingColumns=True)
