"""From raw documents to packed sequences: quality, near duplicates, personal data, mix, packing.

Every stage but the last returns the columns of its input, whatever they are named. Null and empty texts have no
words and leave with the first stage; a null id, language or source is a value of its own. An empty table goes
through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from smudgeline.llm import mixing, ngram_join, packing, pseudonyms, quality
from smudgeline.llm.queries import PSEUDONYM_KEY
from smudgeline.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the distance to every language reference reject go.

    Under 50 words, null and empty texts included, a document goes; rows that repeat are judged alike.
    """
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: that of the smallest id.

    Rows that repeat in id and text are one document. Rows with a null id leave where they are linked with one
    that has an id, and stay otherwise. Rows of one id with different texts are documents of their own.
    """
    return ngram_join.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values become pseudonyms, equal ones the same; a null text stays null."""
    return pseudonyms.pseudonymise_documents(docs, PSEUDONYM_KEY)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice.

    Rows alike in id, text and source are taken together; rows without words are not taken.
    """
    return mixing.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece with its sequence and place; a document taken twice is packed twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_join", near_duplicates),
    ("pseudonyms", personal_data),
    ("source_mix", source_mix),
    ("packing", sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: SQL has no byte-pair tokenizer, language references or connected components at this size
ORACLE_SQL = None
