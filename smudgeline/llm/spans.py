"""Substring dedup by spans of sentences: every run of several sentences is looked up globally.

At each sentence a span starts and one ends: the shortest runs of at least ``least_sentences`` sentences
with at least ``least_words`` words, so any longer run that is repeated is covered from its first to
its last sentence. Sentences of many words are cut at clauses, and clauses of many words at places
that follow from the words around alone; where words are written without blanks each character is
one. Spans are hashed and compared over all documents; the first by
document and place stays, and sentences under any other are removed.

Every lot of texts keeps the first of each of its spans and only that travels, so a span that is everywhere
is one row a lot; the others of the lot are told as stretches of their texts. Spans meet once, at their hash.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, lots, mix64, powers

#: a sentence with the marks and blanks that close it
SENTENCE = re.compile(r"[^.!?\n。！？]*(?:[.!?]+(?=\s|$)[^\S\n]*\n*|[。！？]+[^\S\n]*\n*|\n+|[.!?]+|$)")
CLAUSE = re.compile(r"[^,;:，、；：]+(?:[,;:，、；：]+\s*|$)|[,;:，、；：]+\s*")
LONG = 25
#: bytes of text looked at together
LOT = 16 << 20
#: of so many words in a row one begins a piece, where there are no other marks
CUT_WITHIN = 7
_BARE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
#: characters of scripts without blanks
BARE = re.compile(f"[{_BARE}]")
WORD_AT = re.compile(rf"[{_BARE}]|[^\x20\x09-\x0D{_BARE}]+")


def words_of(piece: str) -> list[bytes]:
    """Lower-case words of a piece."""
    if not piece.isascii():
        piece = BARE.sub(r" \g<0> ", piece)
    return piece.lower().encode("utf-8", "surrogatepass").split()


def cut_by_content(clause: str) -> list[str]:
    """Pieces of at most CUT_WITHIN words that begin at the least word hash of any so many in a row."""
    starts = [m.start() for m in WORD_AT.finditer(clause)]
    hashes = np.fromiter(
        (zlib.crc32(m[0].lower().encode("utf-8", "surrogatepass")) for m in WORD_AT.finditer(clause)),
        np.int64, len(starts),
    )
    if len(starts) < CUT_WITHIN:
        return [clause]
    windows = np.lib.stride_tricks.sliding_window_view(hashes, CUT_WITHIN)
    chosen = np.unique(windows.argmin(axis=1) + np.arange(len(windows)))
    places = [0, *(starts[k] for k in chosen.tolist() if k), len(clause)]
    return [clause[a:b] for a, b in zip(places, places[1:], strict=False)]


def pieces_of(text: str) -> tuple[list[str], list[list[bytes]]]:
    """Pieces that joined give the text again, and their words.

    A piece is a sentence; sentences of more than LONG words are cut by clauses, long clauses by content.
    """
    pieces: list[str] = []
    words: list[list[bytes]] = []
    start = 0
    for m in SENTENCE.finditer(text):
        end = m.end()
        if end == start or (end < len(text) and not text[end - 1].isspace() and text[end - 1] not in "。！？"):
            continue  # nothing new, or a mark inside a word or number, which ends nothing
        piece = text[start:end]
        start = end
        said = words_of(piece)
        if len(said) <= LONG:
            pieces.append(piece)
            words.append(said)
            continue
        for clause in CLAUSE.findall(piece):
            said = words_of(clause)
            if len(said) <= LONG:
                pieces.append(clause)
                words.append(said)
            else:
                cut = cut_by_content(clause)
                pieces += cut
                words += map(words_of, cut)
    return pieces, words


def span_hashes(
    words: list[list[bytes]], hashes: WordHashes, least_sentences: int, least_words: int
) -> tuple[np.ndarray, np.ndarray]:
    """Places (first piece in the upper, last in the lower 32 bits) and hashes of all spans of a text."""
    counts = np.fromiter(map(len, words), np.int64, len(words))
    spoken = np.flatnonzero(counts)  # blank pieces neither count nor part sentences
    if len(spoken) < least_sentences:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    flat = hashes.of([w for ws in words for w in ws])
    ends = np.cumsum(counts[spoken])
    starts = ends - counts[spoken]
    last = np.maximum(
        np.searchsorted(ends, starts + least_words), np.arange(len(spoken)) + least_sentences - 1
    )
    whole = last < len(spoken)
    # and the shortest run that ends at each sentence
    first = np.minimum(
        np.searchsorted(starts, ends - least_words, "right") - 1, np.arange(len(spoken)) - least_sentences + 1
    )
    closed = first >= 0
    runs = np.unique(
        np.concatenate(
            [np.flatnonzero(whole) * len(spoken) + last[whole], first[closed] * len(spoken) + np.flatnonzero(closed)]
        )
    )
    if not len(runs):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = runs // len(spoken), runs % len(spoken)
    # sums of words times powers of an odd number; a span is a difference, moved to its own start
    up, down = powers(len(flat))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(flat) * up, dtype=np.uint64)])
        at = starts[first]
        codes = mix64((sums[ends[last]] - sums[at]) * down[at] + (ends[last] - at).astype(np.uint64))
    return spoken[first] << 32 | spoken[last], codes.view(np.int64)


def first_spans(doc: np.ndarray, key: np.ndarray, place: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Which spans of a lot are the first of their code by document, text and place."""
    order = np.lexsort((place, key, doc, code))
    opens = np.ones(len(order), bool)
    opens[1:] = code[order][1:] != code[order][:-1]
    out = np.zeros(len(order), bool)
    out[order[opens]] = True
    return out


def stretches(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts and places of the stretches that spans of a lot cover together."""
    order = np.lexsort((place, text))
    text, place = text[order], place[order]
    reach = np.maximum.accumulate((text << 32) + (place & 0xFFFFFFFF))
    opens = np.ones(len(order), bool)
    opens[1:] = (text[1:] << 32) + (place[1:] >> 32) > reach[:-1] + 1
    first = np.flatnonzero(opens)
    ends = reach[np.append(first[1:], len(order)) - 1] if len(order) else reach
    return text[first], place[first] >> 32 << 32 | ends & 0xFFFFFFFF


def remove_repeats(
    documents: DataFrame, least_sentences: int = 2, least_words: int = 20
) -> DataFrame:
    """``(doc_id, text, n_removed)``: texts without repeated spans, and how many sentences went.

    The first occurrence is the one in the smallest doc_id (null before all), then the earliest in
    the text; within one document later repeats go as well. A null text stays null and an empty
    one empty; texts too short for a span stay as they are. Rows alike in id and text are one
    document: they keep the same sentences. Other columns are not read.
    """
    names = ["doc", "text_key", "place", "code", "kept"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            for start, end in lots(sizes, LOT):
                yield spans_of(batch.slice(start, end - start), hashes)

    def spans_of(lot: pa.RecordBatch, hashes: WordHashes) -> pa.RecordBatch:
        doc, key = (lot.column(k).to_numpy() for k in (0, 2))
        # rows alike in id and text are looked at once
        _, once = np.unique(key, return_index=True)
        found = [
            span_hashes(pieces_of(t or "")[1], hashes, least_sentences, least_words)
            for t in lot.column(1).take(pa.array(once)).to_pylist()
        ]
        at = np.repeat(once, [len(f[0]) for f in found])
        place, code = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        kept = first_spans(doc[at], key[at], place, code)
        gone_at, gone = stretches(at[~kept], place[~kept])
        columns = (
            np.concatenate([doc[at[kept]], doc[gone_at]]),
            np.concatenate([key[at[kept]], key[gone_at]]),
            np.concatenate([place[kept], gone]),
            # what the lot takes out itself meets no other span: it goes by its text, not by a code
            np.concatenate([code[kept], key[gone_at] ^ gone]),
            np.arange(int(kept.sum()) + len(gone)) < kept.sum(),
        )
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    lowest = -(1 << 63)
    given = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn(
        "text_key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text")
    )
    spans = given.select(F.coalesce("doc_id", F.lit(lowest)).alias("doc"), "text", "text_key").mapInArrow(
        find, "doc long, text_key long, place long, code long, kept boolean"
    )
    # rank, as rows alike in id and text may lie in two lots and stay both
    earlier = F.rank().over(Window.partitionBy("code", "kept").orderBy("doc", "text_key", "place")) > 1
    removed = (
        spans.withColumn("gone", ~F.col("kept") | earlier)
        .filter("gone")
        .groupBy("text_key")
        .agg(F.collect_set("place").alias("covered"))
    )

    out_schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_removed", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
            for start, end in lots(sizes, LOT):
                lot = batch.slice(start, end - start)
                left, n_gone = [], []
                for text, covered in zip(lot.column(1).to_pylist(), lot.column(2), strict=True):
                    text, n = without(text, covered.values.to_numpy()) if covered.is_valid else (text, 0)
                    left.append(text)
                    n_gone.append(n)
                yield pa.RecordBatch.from_arrays(
                    [lot.column(0), pa.array(left, pa.string()), pa.array(n_gone, pa.int64())], schema=out_schema
                )

    def without(text: str, places: np.ndarray) -> tuple[str, int]:
        pieces = pieces_of(text)[0]
        # runs that begin less those that have ended: above nought inside a span
        depth = np.zeros(len(pieces) + 1, np.int64)
        np.add.at(depth, places >> 32, 1)
        np.add.at(depth, (places & 0xFFFFFFFF) + 1, -1)
        gone = np.cumsum(depth)[:-1] > 0
        return "".join(p for p, g in zip(pieces, gone.tolist(), strict=True) if not g), int(gone.sum())

    return (
        given.join(removed, "text_key", "left")
        .select("doc_id", "text", "covered")
        .mapInArrow(cut, "doc_id long, text string, n_removed long")
    )
