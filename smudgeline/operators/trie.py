"""A stored trie of token prefixes: made once, extended by new lines, asked many times.

An edge is (length of the prefix, two 64-bit hashes of it, the token that may follow). A prefix is named by
its hashes and never written out, so a line of L tokens gives L short rows, and of prefixes that many lines share
one row is left before anything is shuffled. Edges lie sorted by name, so a lookup skips most of the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tokens import EOS, PAD
from ..sources import batches
from .skew import skew_join

NODE = ["length", "h1", "h2"]


def _node(prefix: Column) -> list[Column]:
    return [
        F.size(prefix).alias("length"), F.xxhash64(prefix).alias("h1"), F.xxhash64(F.lit(1), prefix).alias("h2")
    ]


def bare(prefix: Column) -> Column:
    """A prefix without the pad a decoder starts with."""
    return F.when(
        F.get(prefix, F.lit(0)) == PAD, F.slice(prefix, F.lit(2), F.greatest(F.size(prefix) - 1, F.lit(0)))
    ).otherwise(prefix)


def edges(sequences: DataFrame, ids: str = "ids") -> DataFrame:
    """``(length, h1, h2, next_id)``, each once: what may follow each prefix of any sequence.

    Pads and end tokens inside are dropped; the end token follows a whole sequence. Null sequences give none.
    """
    seq = F.filter(F.col(ids), lambda x: (x != PAD) & (x != EOS))
    whole = sequences.select(F.concat(seq, F.array(F.lit(EOS))).alias("s"))
    steps = F.transform(
        F.sequence(F.lit(1), F.size("s")),
        lambda n: F.struct(
            *_node(F.slice("s", F.lit(1), n - 1)), F.element_at("s", n).alias("next_id")
        ),
    )
    return whole.filter("s IS NOT NULL").select(F.explode(steps).alias("e")).select("e.*").distinct()


def extend(sequences: DataFrame, location: str, batch: str, ids: str = "ids") -> bool:
    """Add the edges of new sequences to the trie at ``location``; whether the batch was written.

    Edges the trie has are left out, so every edge is stored once. The call may be repeated.
    """
    spark = sequences.sparkSession
    new = edges(sequences, ids)
    if batches.committed(spark, location):
        new = new.join(read(spark, location), [*NODE, "next_id"], "left_anti")
    # one folder for short prefixes, which all lines share, and one for each further sixteen tokens
    placed = new.withColumn("stretch", F.floor(F.col("length") / 16).cast("int"))
    return batches.append_batch(placed.sortWithinPartitions("h1"), location, batch, "stretch")


def read(spark: SparkSession, location: str) -> DataFrame:
    """The edges of all batches."""
    return batches.read_batches(spark, location).select(*NODE, "next_id")


def nodes(trie: DataFrame) -> DataFrame:
    """``(length, n_nodes, n_edges)``: distinct prefixes that something follows, and what follows them."""
    per_node = trie.groupBy(*NODE).agg(F.count("*").alias("n"))
    return per_node.groupBy("length").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_edges"))


def allowed_next(prefixes: DataFrame, trie: DataFrame, prefix: str = "prefix") -> DataFrame:
    """Add ``allowed``, the sorted ids that continue the prefix; the end token if none does.

    A leading pad is dropped from the prefix first; a null prefix gets the end token. Rows of a prefix that many ask for
    are split, equal rows too. The lists hold distinct ids only, so the vocabulary bounds them.
    """
    given = prefixes.columns
    wanted = prefixes.withColumns(
        {f"_{n}": c for n, c in zip(NODE, _node(bare(F.col(prefix))), strict=True)}
        # rows alike in all columns lie in several tasks, which tells them apart
        | {"_row": F.xxhash64(F.spark_partition_id(), *[c for c, kind in prefixes.dtypes if "map<" not in kind])}
    )
    name = F.when(F.col(prefix).isNotNull(), F.concat_ws("-", *(f"_{n}" for n in NODE)))
    wanted = wanted.withColumn("_key", name)
    asked = wanted.filter("_key IS NOT NULL").select(*(F.col(f"_{n}").alias(n) for n in NODE)).distinct()
    follow = (
        trie.join(asked, NODE, "left_semi")
        .groupBy(F.concat_ws("-", *NODE).alias("_key"))
        .agg(F.sort_array(F.collect_set("next_id")).alias("allowed"))
    )
    return (
        skew_join(wanted, follow, "_key", "left", "_row")
        .withColumn("allowed", F.coalesce("allowed", F.array(F.lit(EOS))))
        .select(*given, "allowed")
    )
