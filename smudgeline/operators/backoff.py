"""Forced-label costs from a counted back-off model.

The model counts which token of a label followed which last few tokens. The cost of a label under a prompt is
the sum over its tokens, end token included, of the negative log of their chance: the share in the longest
context that was seen with that token, cut by a factor for every token of context given up. Only the
last tokens of a prompt matter, so costs are worked out once for each distinct ending and joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import Scorer
from ..functions.tokens import EOS, OFFSET, PAD, Tokenizer, byte_tokens
from ..session import stored
from .skew import skew_join

#: tokens of context, what is kept of a chance for each token given up, tokens there are
CONTEXT, KEPT, VOCABULARY = 4, 0.4, 256 + OFFSET
LABELS = ("yes", "no")


def _bare(ids: Column) -> Column:
    return F.filter(ids, lambda x: (x != PAD) & (x != EOS))


def _ending(ids: Column, n: int) -> Column:
    """The last ``n`` tokens, or all."""
    size = F.size(ids)
    return F.slice(ids, F.greatest(size - n + 1, F.lit(1)), n)


def _key(context: Column) -> Column:
    return F.concat_ws("-", F.size(context), F.xxhash64(context), F.xxhash64(F.lit(1), context))


def _steps(ending: Column, label: Column, context: int) -> Column:
    """``(at, size, key, next_id)`` for every token of a label, after each length of context there is."""
    whole = F.concat(label, F.array(F.lit(EOS)))
    before = F.transform(
        F.sequence(F.lit(1), F.size(whole)),
        lambda n: F.struct(
            n.alias("at"),
            _ending(F.concat(ending, F.slice(label, F.lit(1), n - 1)), context).alias("context"),
            F.element_at(whole, n).alias("next_id"),
        ),
    )
    return F.flatten(
        F.transform(
            before,
            lambda s: F.transform(
                F.sequence(F.lit(0), F.size(s["context"])),
                lambda c: F.struct(
                    s["at"].alias("at"), c.alias("size"),
                    _key(F.slice(s["context"], F.size(s["context"]) - c + 1, c)).alias("key"), s["next_id"].alias("next_id"),
                ),
            ),
        )
    )


def count_labels(
    pairs: DataFrame,
    prompt: str = "prompt",
    target: str = "target",
    tokenizer: Tokenizer = byte_tokens,
    context: int = CONTEXT,
) -> DataFrame:
    """``(key, next_id, n, total)``: how often a token of a label followed a context, and anything did; stored.

    Pairs with a null prompt or target teach nothing. Counts are added up in each task before they are moved.
    """
    ids = pairs.select(tokenizer(F.col(prompt)).alias("_p"), tokenizer(F.col(target)).alias("_t")).dropna()
    seen = ids.select(F.explode(_steps(_ending(_bare(F.col("_p")), context), _bare(F.col("_t")), context)).alias("s"))
    counts = stored(seen.groupBy("s.key", "s.next_id").agg(F.count("*").alias("n")), "label_counts")
    totals = counts.groupBy("key").agg(F.sum("n").alias("total"))
    return stored(counts.join(totals, "key"), "label_model")


def label_costs(
    endings: DataFrame, model: DataFrame, tokenizer: Tokenizer = byte_tokens, context: int = CONTEXT
) -> DataFrame:
    """``(ending, label, nll)`` of each label after each of the distinct ``endings(ending)``."""
    labels = F.array(
        *(F.struct(F.lit(w).alias("label"), _bare(tokenizer(F.lit(w))).alias("ids")) for w in LABELS)
    )
    asked = (
        endings.select("ending", F.explode(labels).alias("l"))
        .select("ending", "l.label", F.explode(_steps(F.col("ending"), F.col("l.ids"), context)).alias("s"))
        .select("ending", "label", "s.*")
    )
    found = asked.join(model, ["key", "next_id"], "left")
    given_up = F.lit(float(context)) - F.col("size")
    cost = -F.log(F.col("n") / F.col("total")) - given_up * F.log(F.lit(KEPT))
    unseen = F.lit(float(context + 1)) * -F.log(F.lit(KEPT)) + F.log(F.lit(float(VOCABULARY)))
    per_token = found.groupBy("ending", "label", "at").agg(
        F.max_by(cost, F.when(F.col("n").isNotNull(), F.col("size"))).alias("cost")
    )
    return per_token.groupBy("ending", "label").agg(F.sum(F.coalesce("cost", unseen)).alias("nll"))


def backoff_scorer(
    model: DataFrame, tokenizer: Tokenizer = byte_tokens, context: int = CONTEXT, prompt: str = "prompt"
) -> Scorer:
    """A scorer that adds ``nll_yes`` and ``nll_no`` by the counts of a model; null for a null prompt."""

    def score(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_ending", _ending(_bare(tokenizer(F.col(prompt))), context)).withColumn(
            "_ending_key", F.when(F.col("_ending").isNotNull(), _key(F.col("_ending")))
        )
        # tokens are made once: rows are counted, joined and asked for their endings
        rows = stored(rows.withColumn("_row", F.xxhash64(F.spark_partition_id(), prompt)), "endings")
        endings = rows.select(F.col("_ending").alias("ending")).dropna().distinct()
        costs = label_costs(endings, model, tokenizer, context)
        by_label = costs.groupBy(_key(F.col("ending")).alias("_ending_key")).agg(
            *(F.max(F.when(F.col("label") == w, F.col("nll"))).alias(f"nll_{w}") for w in LABELS)
        )
        return skew_join(rows, by_label, "_ending_key", "left", "_row").drop("_ending", "_ending_key", "_row")

    return score
