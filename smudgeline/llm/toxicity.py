"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence is a bag of hashed words with logit ``s``; a document is toxic unless all its sentences
are clean, so its score is the noisy-or ``1 - prod(1 - sigmoid(s))``. Sentences without a word that
tells anything have chance 0: what such words cannot explain is one leak per document, so no text
becomes toxic by its length. Only document labels are needed to train the sentence weights, and
the trained sentence scores locate what offends.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import in_batches, texts

#: words in any script, or the marks and line ends that close a sentence
PIECES = re.compile(r"[^\W\d_]+|[.!?\n]+")
CLOSERS = ".!?\n"


@dataclass
class SentenceModel:
    weights: np.ndarray
    bias: float
    #: logit of being toxic for a document without any telling word
    leak: float = -6.0

    @property
    def dims(self) -> int:
        return len(self.weights)


class WordIds(dict):
    """Word to feature number, kept per batch of work; sentence ends are -1."""

    def __init__(self, dims: int):
        self.dims = dims

    def __missing__(self, piece: str) -> int:
        import zlib

        if len(self) > 500_000:
            self.clear()
        at = -1 if piece[0] in CLOSERS else zlib.crc32(piece.encode("utf-8", "surrogatepass")) % self.dims
        self[piece] = at
        return at


def sentence_bags(batch: list[str], ids: WordIds):
    """``(doc, sentence, feature)`` of every distinct word of every sentence, as flat arrays.

    ``sentence`` numbers run through the batch; also returns the document of each sentence.
    """
    features, docs_of, at = [], [], 0
    sentences = []
    for doc, text in enumerate(batch):
        pieces = PIECES.findall(text.lower())
        codes = np.fromiter(map(ids.__getitem__, pieces), np.int64, len(pieces))
        ends = codes < 0
        number = np.cumsum(ends)
        n = int(number[-1]) + 1 if len(number) else 1
        keep = ~ends
        features.append(codes[keep])
        sentences.append(number[keep] + at)
        docs_of.append(np.full(n, doc, np.int64))
        at += n
    feature, sentence = np.concatenate(features), np.concatenate(sentences)
    pairs = np.unique(sentence * ids.dims + feature)
    return pairs // ids.dims, pairs % ids.dims, np.concatenate(docs_of)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, x)


def sentence_logits(model: SentenceModel, sentence, feature, n: int) -> np.ndarray:
    return model.bias + np.bincount(sentence, model.weights[feature], n)


def speaking(telling: np.ndarray, sentence, feature, n: int) -> np.ndarray:
    """Which sentences hold a telling word; the others have chance 0."""
    return np.bincount(sentence, telling[feature], n) > 0


#: tasks that read a sample of bounded size
MERGED = 16


def training_sample(documents: DataFrame, labels: DataFrame, rows: int | None) -> DataFrame:
    """``(text, toxic)`` of labelled documents; with ``rows``, those with the smallest id hashes.

    A document labelled several times counts as toxic if any label says so; null labels and null
    ids teach nothing.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col("toxic").cast("int").alias("_toxic"))
        .dropna()
        .groupBy("_id")
        .agg(F.max("_toxic").alias("_toxic"))
    )
    if rows is not None:
        known = known.orderBy(F.xxhash64("_id"), "_id").limit(rows)
    asked = documents.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    return asked.join(known, "_id").select("_text", "_toxic")


def fit(
    documents: DataFrame,
    labels: DataFrame,
    rows: int | None = 12_000,
    dims: int = 1 << 16,
    iterations: int = 12,
    step: float = 0.3,
    decay: float = 1e-3,
    bias: float = -6.0,
    least_documents: int = 5,
    least_deviation: float = 5.0,
) -> SentenceModel:
    """Train sentence weights from document labels by full-batch gradient steps.

    ``rows`` bounds the labelled documents learnt from (None: all). Words found in fewer than
    ``least_documents`` of them, or not clearly more often in toxic ones (by fewer than
    ``least_deviation`` standard deviations), keep weight 0. The documents are written out as bags
    once; each step is one pass over them in which every task returns one gradient of ``dims``
    numbers, so the driver's share depends on ``dims`` and the number of tasks only. Without both
    classes the model is the smoothed rate of toxic labels.
    """
    schema = pa.schema(
        [("toxic", pa.float64()), ("sentence", pa.list_(pa.int32())), ("feature", pa.list_(pa.int32())),
         ("n", pa.int32())]
    )

    def bags(batch: pa.RecordBatch) -> dict:
        ids = WordIds(dims)
        out: dict = {k: [] for k in schema.names}
        for text, toxic in zip(texts(batch.column(0)), batch.column(1).to_pylist(), strict=True):
            sentence, feature, docs = sentence_bags([text], ids)
            out["toxic"].append(float(toxic > 0))
            out["sentence"].append(sentence.astype(np.int32))
            out["feature"].append(feature.astype(np.int32))
            out["n"].append(len(docs))
        return out

    # as many tasks as the documents have; the files they leave are merged as they are read
    sample = training_sample(documents, labels, rows)
    train = stored(
        sample.mapInArrow(in_batches(bags, schema), "toxic double, sentence array<int>, feature array<int>, n int"),
        "toxicity-bags",
    )
    if rows is not None:
        train = train.coalesce(MERGED)
    count, positives = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0.0))).first()
    model = SentenceModel(np.zeros(dims), bias)
    if not 0 < positives < count:
        rate = (positives + 0.5) / (count + 1)
        model.leak = float(np.log(rate / (1 - rate)))
        return model
    told = np.zeros(dims)
    found = train.select("toxic", F.explode(F.array_distinct("feature")).alias("feature"))
    for r in (
        found.groupBy("feature")
        .agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
        .filter(F.col("n") >= least_documents)
        .collect()
    ):  # at most one row per dimension
        rate = positives / count
        spread = np.sqrt(r["n"] * rate * (1 - rate))
        told[r["feature"]] = r["k"] - r["n"] * rate >= least_deviation * spread
        if told[r["feature"]]:  # start where a sentence with this word alone has the word's rate
            chance = (r["k"] + 0.5) / (r["n"] + 1)
            model.weights[r["feature"]] = np.log(chance / (1 - chance)) - bias

    def gradient(weights: bytes, telling: bytes, bias: float, leak: float):
        def run(batches):
            import zlib

            current = SentenceModel(np.frombuffer(zlib.decompress(weights)), bias, leak)
            heard = np.frombuffer(zlib.decompress(telling))
            total = np.zeros(dims + 2)
            for batch in batches:
                toxic = batch.column(0).to_numpy()
                sizes = batch.column(3).to_numpy().astype(np.int64)
                sentence_lists, feature_lists = batch.column(1), batch.column(2)
                starts = np.concatenate([[0], np.cumsum(sizes)])
                lengths = np.diff(sentence_lists.offsets.to_numpy())
                sentence = sentence_lists.flatten().to_numpy() + np.repeat(starts[:-1], lengths)
                feature = feature_lists.flatten().to_numpy()
                logits = sentence_logits(current, sentence, feature, int(starts[-1]))
                speaks = speaking(heard, sentence, feature, int(starts[-1]))
                # -log of being clean
                clean = np.add.reduceat(speaks * softplus(logits), starts[:-1]) + softplus(current.leak)
                # d(loss)/d(clean): 1 for a clean label, -1/(e^clean - 1) for a toxic one
                slope = np.where(toxic > 0, -1.0 / np.expm1(np.clip(clean, 1e-6, 700)), 1.0)
                by_sentence = speaks * np.repeat(slope, sizes) / (1 + np.exp(-logits))
                total[:dims] += np.bincount(feature, by_sentence[sentence], dims)
                total[dims] += by_sentence.sum()
                total[dims + 1] += slope.sum() / (1 + np.exp(-current.leak))
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["g"])

        return run

    import zlib

    mean, square = np.zeros(dims + 2), np.zeros(dims + 2)
    heard_by_all = zlib.compress(told.tobytes(), 1)
    for k in range(1, iterations + 1):
        packed = zlib.compress(model.weights.tobytes(), 1)
        parts = train.mapInArrow(gradient(packed, heard_by_all, model.bias, model.leak), "g binary").collect()
        g = sum((np.frombuffer(p["g"]) for p in parts), np.zeros(dims + 2)) / count
        g[:dims] = told * (g[:dims] + decay * model.weights)
        mean = 0.9 * mean + 0.1 * g
        square = 0.99 * square + 0.01 * g * g
        move = step * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-5)
        model = SentenceModel(
            model.weights - move[:dims], model.bias - 0.2 * move[dims], model.leak - 0.2 * move[dims + 1]
        )
    return model


def score(documents: DataFrame, model: SentenceModel, floor: float = 0.5) -> DataFrame:
    """``(doc_id, score, n_sentences, offending)``: one row per input row.

    ``offending`` lists ``(start, end, score)`` of sentences scoring ``floor`` or more, in
    characters of the text. A null or empty text is one empty sentence. Rows that repeat get the
    same score each; other columns are not read.
    """
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema(
        [("doc_id", pa.int64()), ("score", pa.float64()), ("n_sentences", pa.int64()),
         ("offending", pa.list_(span))]
    )
    weights, bias, leak, dims = model.weights, model.bias, model.leak, model.dims

    def run(batch: pa.RecordBatch) -> dict:
        own = SentenceModel(weights, bias, leak)
        ids = WordIds(dims)
        batch_texts = texts(batch.column(1))
        sentence, feature, docs = sentence_bags(batch_texts, ids)
        logits = sentence_logits(own, sentence, feature, len(docs))
        n = len(batch_texts)
        speaks = speaking((own.weights != 0).astype(float), sentence, feature, len(docs))
        clean = np.bincount(docs, speaks * softplus(logits), n) + softplus(leak)
        sizes = np.bincount(docs, minlength=n)
        first = np.concatenate([[0], np.cumsum(sizes)])
        chances = speaks / (1 + np.exp(-np.clip(logits, -500, 500)))
        offending: list[list] = [[] for _ in range(n)]
        for at in np.flatnonzero(chances >= floor):
            doc = int(docs[at])
            start, end = sentence_place(batch_texts[doc], int(at - first[doc]))
            offending[doc].append({"start": start, "end": end, "score": float(chances[at])})
        return {
            "doc_id": batch.column(0), "score": -np.expm1(-clean), "n_sentences": sizes,
            "offending": offending,
        }

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        in_batches(run, schema),
        "doc_id long, score double, n_sentences long, "
        "offending array<struct<start:long,end:long,score:double>>",
    )


def sentence_place(text: str, number: int) -> tuple[int, int]:
    """Where the sentence of that number lies in a text."""
    start, at = 0, 0
    for m in re.finditer(r"[.!?\n]+", text):
        if at == number:
            return start, m.end()
        start, at = m.end(), at + 1
    return start, len(text)
