"""Ranking pairs and token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tokens import (
    EOS,
    PAD,
    RANK_PROMPT,
    Tokenizer,
    byte_tokens,
    mask,
    pad,
    rank_prompt,
)
from .augment import CANONICAL, NOISY
from .skew import skew_join


def make_pairs(
    rows: DataFrame,
    canonical: str = CANONICAL,
    noisy: str = NOISY,
    row_key: str = "row_id",
    template: str = RANK_PROMPT,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """``(row_id, pos, prompt, target)``: the truth with "yes", then each negative with "no"."""
    candidates = F.concat(
        F.array(F.col(canonical)), F.coalesce("hard_negatives", F.array().cast("array<string>"))
    )
    return rows.select(
        row_key, *keep, F.col(noisy).alias("_noisy"), F.posexplode(candidates).alias("pos", "_c")
    ).select(
        row_key,
        *keep,
        "pos",
        rank_prompt(F.col("_noisy"), F.col("_c"), template).alias("prompt"),
        F.when(F.col("pos") == 0, "yes").otherwise("no").alias("target"),
    )


def tokenize_pairs(
    pairs: DataFrame,
    max_len: int = 128,
    tokenizer: Tokenizer = byte_tokens,
    text: str = "prompt",
    target: str = "target",
    target_len: int | None = None,
) -> DataFrame:
    """Replace the texts by ``input_ids``, ``attention_mask`` and ``labels``."""
    rest = [c for c in pairs.columns if c not in (text, target)]
    ids = pairs.select(
        *rest, tokenizer(F.col(text)).alias("_ids"), tokenizer(F.col(target)).alias("_labels")
    )
    return ids.select(
        *rest,
        pad(F.col("_ids"), max_len).alias("input_ids"),
        mask(F.col("_ids"), max_len).alias("attention_mask"),
        pad(F.col("_labels"), target_len or max_len).alias("labels"),
    )


def pair_volume(rows: DataFrame) -> DataFrame:
    """Rows and expected pairs per ``split``."""
    pairs = F.greatest(F.size(F.coalesce("hard_negatives", F.array().cast("array<string>"))), F.lit(0))
    return rows.groupBy("split").agg(
        F.count("*").alias("n_rows"), F.sum(pairs + 1).alias("n_pairs")
    )


def next_tokens(sequences: DataFrame, ids: str = "ids") -> DataFrame:
    """``(prefix, next_id)``: what may follow each prefix of any sequence, each once.

    Sequences end with the end token, which so follows a whole sequence.
    """
    seq = F.filter(F.col(ids), lambda x: (x != PAD) & (x != EOS))
    whole = sequences.select(F.concat(seq, F.array(F.lit(EOS))).alias("s"))
    return whole.select(
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.size("s")),
                lambda n: F.struct(
                    F.slice("s", F.lit(1), n - 1).alias("prefix"),
                    F.element_at("s", n).alias("next_id"),
                ),
            )
        ).alias("p")
    ).select("p.prefix", "p.next_id").distinct()


def _prefix_key(prefix: Column) -> Column:
    """A short stand-in for a prefix: its length and two hashes of 64 bits; null for null."""
    parts = F.concat_ws("-", F.size(prefix), F.xxhash64(prefix), F.xxhash64(F.lit(1), prefix))
    return F.when(prefix.isNotNull(), parts)


def allowed_next(
    prefixes: DataFrame, sequences: DataFrame, prefix: str = "prefix", ids: str = "ids"
) -> DataFrame:
    """Add ``allowed``, the sorted ids that continue the prefix; the end token if none does.

    A leading pad is dropped from the prefix first. Sequences give their prefixes of the
    lengths asked for only, as hashes; repeats go before the shuffle, and rows of a prefix that
    many ask for are split. The lists hold distinct ids only, so the vocabulary bounds them.
    """
    bare = F.when(
        F.get(prefix, F.lit(0)) == PAD,
        F.slice(prefix, F.lit(2), F.greatest(F.size(prefix) - 1, F.lit(0))),
    ).otherwise(F.col(prefix))
    spread = [c for c, kind in prefixes.dtypes if "map<" not in kind]
    wanted = prefixes.withColumns(
        {
            "_length": F.size(bare),
            "_key": _prefix_key(bare),
            # rows alike in all columns lie in several tasks, which tells them apart
            "_row": F.xxhash64(F.spark_partition_id(), *spread),
        }
    )
    # as many numbers as there are lengths of prefixes
    asked = wanted.filter("_key IS NOT NULL").select("_length").distinct().collect()
    lengths = F.array(*[F.lit(r["_length"]) for r in sorted(asked)]).cast("array<int>")
    seq = F.filter(F.col(ids), lambda x: (x != PAD) & (x != EOS))
    whole = sequences.select(F.concat(seq, F.array(F.lit(EOS))).alias("s"))
    follow = (
        whole.select(
            F.explode(
                F.transform(
                    F.filter(lengths, lambda n: n < F.size("s")),
                    lambda n: F.struct(
                        _prefix_key(F.slice("s", F.lit(1), n)).alias("_key"),
                        F.element_at("s", n + 1).alias("next_id"),
                    ),
                )
            ).alias("p")
        )
        .select("p.*")
        .distinct()
        .join(wanted.select("_key").distinct(), "_key", "left_semi")
        .groupBy("_key")
        .agg(F.sort_array(F.collect_set("next_id")).alias("allowed"))
    )
    return (
        skew_join(wanted, follow, "_key", "left", "_row")
        .withColumn("allowed", F.coalesce("allowed", F.array(F.lit(EOS))))
        .select(*prefixes.columns, "allowed")
    )
