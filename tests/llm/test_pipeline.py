"""The registered training-data queries and the pipeline."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
import corpus_pipeline
from smudgeline.llm import queries
from tests.llm.packing_rules import check_packing
from tools.check import rows_of


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    df = queries.QUERIES[name](spark, small)
    result = con.execute(queries.SQL[name])
    assert rows_of(df.columns, map(tuple, df.collect())) == rows_of([c[0] for c in result.description], result.fetchall())


def test_registered():
    names = spark_entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


@pytest.mark.parametrize("name", ["op1_toxicity", "op3_sentence_spans", "op4_source_mix", "op9_secret_scan", "op12_byte_bpe"])
def test_one_row_per_document(spark, small, name):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    got = queries.QUERIES[name](spark, small)
    assert sorted(r[0] for r in got.select("doc_id").collect()) == sorted(r[0] for r in docs.select("doc_id").collect())


def test_pipeline_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns, size = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        docs = corpus_pipeline.stored(docs, name)
        assert docs.columns == columns
        if name != "source_mix":
            assert 0 < docs.count() <= size
            size = docs.count()
    rows = corpus_pipeline.sequences(spark, docs, small).collect()
    check_packing(rows)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_over_odd_and_empty_tables(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names, all five stages."""
    rng = random.Random(3)
    plain = [" ".join(f"w{rng.randrange(400)}" for _ in range(90)) + "." for _ in range(25)]
    rows = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for k, t in enumerate(plain)]
    rows += [rows[3], rows[3], (3, plain[4], "en", "a"), (None, plain[5], "en", "a"), (None, plain[5] + " x y", None, None),
             (40, None, "en", "a"), (41, "", None, "a"), (None, None, None, None), (42, " \n\t ", "en", "b"),
             (43, " ".join(f"v{rng.randrange(10**6)}" for _ in range(60_000)), "en", "b"), (44, "x" * 300_000, "en", "a"),
             (45, plain[6] + " call 212-555-0143 or me@mail.example", "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("key", "size", "kept", "quality", "_text_key", "signature", "n", "part", "piece", "sequence_id", "_mix_key"):
        df = df.withColumn(name, F.lit("x"))
    for given in (df, df.limit(0)):
        docs = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(stage(spark, docs, "nowhere"), name)
            if name == "ngram_join" and given is df:
                kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
                assert len(kept) == len(set(kept)) and (3, plain[3]) in kept and (None, plain[5]) not in kept
        packed = corpus_pipeline.sequences(spark, docs, "nowhere").collect()
        check_packing(packed)
        assert bool(packed) == (given is df)
        if packed:
            texts = " ".join(r["text"] for r in docs.collect())
            assert "212-555-0143" not in texts and "me@mail" not in texts
            assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
