"""Text vectors as means over token vectors, by join and sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import bind
from ..functions.tokens import PAD
from .augment import made_once

#: bytes of token vectors that every task may hold
VOCABULARY_BYTES = 64 << 20


def _scaled(vec: Column, by: Column) -> Column:
    return F.transform(vec, lambda x: x.cast("double") * by)


def _total(rows: Column) -> Column:
    """Componentwise sum of ``(token, n, vec)`` rows, n times each vector."""
    start = F.transform(F.get(rows, F.lit(0))["vec"], lambda _: F.lit(0.0))
    return F.aggregate(
        rows, start, lambda total, r: F.zip_with(total, _scaled(r["vec"], r["n"]), lambda a, b: a + b)
    )


def unit(vec: Column) -> Column:
    """A vector at length one; a zero vector stays. The vector and its length are worked out once each."""

    def scaled(v: Column) -> Column:
        size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return bind(size, lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v))

    return bind(vec, scaled)


def _is_small(vectors: DataFrame) -> bool:
    """Whether token vectors are few and short enough to be held by every task, by their count and lengths."""
    n, longest = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    return n * 8 * max(longest or 0, 1) <= VOCABULARY_BYTES


def mean_over_tokens(
    texts: DataFrame,
    token_vectors: DataFrame,
    key: str,
    ids: str = "ids",
    batch: Column | None = None,
    limit: int = 512,
    normalise: bool = True,
) -> DataFrame:
    """``(key, vec)``: the mean of the vectors of a text's first ``limit`` tokens, of length one.

    ``token_vectors`` is ``(token_id, vec)`` with one row per token. With ``batch`` texts are padded to the longest of
    their batch and the padding counts in the mean, with the vector of the padding token, as it does where a
    batch is pooled without a mask. Tokens are counted in their row, so a join sees each distinct token of
    a text once and a sum has no more rows than the vocabulary. Tokens without a vector add nothing but
    count. A text without tokens has no row; keys must be unique.

    Texts are dealt out by key before they are taken apart. A vocabulary of at most ``VOCABULARY_BYTES`` is
    broadcast, so vectors are summed where their text lies; a larger one is joined by sorting, never the texts broadcast.
    """
    kept = F.slice(F.col(ids), 1, limit)
    rows = texts.filter(F.size(ids) > 0).select(F.col(key), kept.alias("_ids"), F.size(kept).alias("_n"), *(
        [batch.alias("_batch")] if batch is not None else []
    ))
    if batch is not None:
        widest = rows.groupBy("_batch").agg(F.max("_n").alias("_width"))
        rows = rows.join(widest.hint("merge"), "_batch")
    else:
        rows = rows.withColumn("_width", F.col("_n"))
    counted = F.transform(
        F.array_distinct("_ids"),
        lambda t: F.struct(t.alias("token"), F.size(F.filter("_ids", lambda x: x == t)).alias("n")),
    )
    padding = F.struct(F.lit(PAD).alias("token"), (F.col("_width") - F.col("_n")).alias("n"))
    spread = rows.repartition(key).select(key, "_width", F.explode(F.concat(counted, F.array(padding))).alias("t")).filter("t.n > 0")
    known = token_vectors.select(F.col("token_id").alias("_token"), F.col("vec").alias("_vec"))
    known = known.hint("broadcast" if _is_small(token_vectors) else "merge")
    summed = (
        spread.join(known, F.col("t.token") == F.col("_token"))
        .groupBy(key)
        .agg(
            F.first("_width").alias("_width"),
            # in order of token, so sums do not depend on how rows were dealt
            F.sort_array(F.collect_list(F.struct("t.token", "t.n", F.col("_vec").alias("vec")))).alias("_rows"),
        )
    )
    width = F.col("_width")
    mean = F.transform(_total(F.col("_rows")), lambda x: x / width)
    # made once, whatever is read of it later
    return made_once(summed.select(key, "_rows", "_width"), "vec", unit(mean) if normalise else mean).select(key, "vec")
