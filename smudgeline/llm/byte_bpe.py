"""Byte-level BPE by the tokenizers library: ids and offsets over Arrow batches, and back to bytes.

The library's BPE works on characters, so each byte stands for one printable character. Its model is made
from a file of ranks: tokens are spelt in those characters, and every way of parting a token in two tokens
is a merge of its rank. Texts are cut by the vocabulary's pattern; a worker keeps the ids of pieces it has
met, so the library sees each distinct piece about once. Characters on whose kind the fast pattern engine
and the library disagree (they know different versions of Unicode) send their text through the library
as a whole. Decoding reverses the byte table; a character that is split over tokens appears where it ends.
"""

from __future__ import annotations

import codecs
import functools
import os
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lots
from .packing import public_vocabulary

#: characters of text worked on at once, pieces a worker keeps, the longest piece kept
LOT, KEPT, KEPT_LENGTH = 1 << 19, 100_000, 64


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_characters() -> list[str]:
    """The character that stands for each byte: printable Latin-1 itself, the others from 256 on in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def spelt(ranks: dict[bytes, int]) -> dict[str, int]:
    """Tokens in the characters of their bytes, by rank."""
    letters = dict(enumerate(byte_characters()))
    return {t.decode("latin-1").translate(letters): r for t, r in sorted(ranks.items(), key=lambda x: x[1])}


def libraries(ranks: dict[bytes, int], pattern: str):
    """Two tokenizers of one model: for whole texts, which it cuts itself, and for pieces."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    vocabulary = spelt(ranks)
    merges = [
        (token[:k], token[k:])
        for token in vocabulary
        for k in range(1, len(token))
        if token[:k] in vocabulary and token[k:] in vocabulary
    ]
    model = models.BPE(vocab=vocabulary, merges=merges, ignore_merges=True)
    to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    cut = pre_tokenizers.Split(Regex(pattern), "isolated")
    whole, piece = Tokenizer(model), Tokenizer(model)
    whole.pre_tokenizer = pre_tokenizers.Sequence([cut, to_bytes])
    piece.pre_tokenizer = to_bytes
    return whole, piece, cut


def packed(numbers: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    out = array("I", numbers)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class Encoder:
    """Ids and offsets of texts; offsets are code points, and a part of a character spans all of it."""

    def __init__(self, path: str, pattern: str, offsets: bool = False):
        import regex

        self.whole, self.piece, self.cut = libraries(read_ranks(path), pattern)
        self.find = regex.compile(pattern).findall
        self.offsets = offsets
        #: packed ids, and starts and ends, of pieces met before
        self.known: list[dict[str, bytes]] = [{} for _ in range(3 if offsets else 1)]
        self.agreed: set[str] = set()

    def row(self, encoding) -> tuple[bytes, ...]:
        ids = packed(encoding.ids)
        if not self.offsets:
            return (ids,)
        places = np.array(encoding.offsets, "<u4").reshape(-1, 2)
        return ids, places[:, 0].tobytes(), places[:, 1].tobytes()

    def joined(self, pieces: list[str]) -> tuple[bytes, ...]:
        """Packed columns of a text from those of its pieces, all of which are known."""
        ids = b"".join(map(self.known[0].__getitem__, pieces))
        if not self.offsets:
            return (ids,)
        lengths = np.array([len(p) for p in pieces], np.int64)
        tokens = [len(self.known[0][p]) // 4 for p in pieces]
        moved = np.repeat(np.cumsum(lengths) - lengths, tokens).astype("<u4")
        places = (np.frombuffer(b"".join(map(k.__getitem__, pieces)), "<u4") for k in self.known[1:])
        return ids, *((p + moved).tobytes() for p in places)

    def doubtful(self, pieces: Iterable[str]) -> set[str]:
        """Characters whose kind the pattern engine and the library see differently."""
        found = set()
        for c in {c for p in pieces if not p.isascii() for c in p} - self.agreed:
            if all(len(self.find(b + c)) == len(self.cut.pre_tokenize_str(b + c)) for b in ("a", "1", "!", " ")):
                self.agreed.add(c)
            else:
                found.add(c)
        return found

    def encode(self, texts: list[str]) -> list[tuple[bytes, ...]]:
        """Packed ids, and with offsets packed starts and ends, of each text."""
        cut = [self.find(t) for t in texts]
        if len(self.known[0]) > KEPT:
            for column in self.known:
                column.clear()
        fresh = list(set().union(*cut) - self.known[0].keys())
        odd = self.doubtful(fresh)
        batch = self.piece.encode_batch if self.offsets else self.piece.encode_batch_fast
        rows = map(self.row, batch(fresh, add_special_tokens=False))
        for column, values in zip(self.known, zip(*rows, strict=True), strict=False):
            column.update(zip(fresh, values, strict=True))
        out = [
            self.row(self.whole.encode(text, add_special_tokens=False))
            if odd and not odd.isdisjoint(text)
            else self.joined(pieces)
            for text, pieces in zip(texts, cut, strict=True)
        ]
        # a piece with a doubtful character is looked at anew each time it comes
        gone = [p for p in fresh if len(p) > KEPT_LENGTH or (odd and not p.isascii() and not odd.isdisjoint(p))]
        for column in self.known:
            for piece in gone:
                del column[piece]
        return out


class Decoder:
    """Bytes and characters of ids: the byte table read backwards."""

    def __init__(self, path: str):
        back = {ord(c): b for b, c in enumerate(byte_characters())}
        vocabulary = spelt(read_ranks(path))
        self.tokens: list[bytes | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
        for token, at in vocabulary.items():
            self.tokens[at] = token.translate(back).encode("latin-1")

    def data(self, ids: Iterable[int]) -> bytes | None:
        """Bytes of ids; None where an id is not in the vocabulary."""
        try:
            return b"".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError):
            return None

    def texts(self, ids: Iterable[int]) -> list[str] | None:
        """The characters each token completes; bytes that make no character become U+FFFD."""
        reader = codecs.getincrementaldecoder("utf-8")("replace")
        ids = list(ids)
        if self.data(ids) is None:
            return None
        out = [reader.decode(self.tokens[k]) for k in ids]
        if out:
            out[-1] += reader.decode(b"", final=True)
        return out


@functools.lru_cache(maxsize=1)
def worker_encoder(path: str, pattern: str, offsets: bool) -> Encoder:
    """The encoder of this worker: tasks come one after the other, and what each made anew would not all be given back."""
    # a task has a core of its own
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path, pattern, offsets)


@functools.lru_cache(maxsize=1)
def worker_decoder(path: str) -> Decoder:
    return Decoder(path)


def encode_documents(
    documents: DataFrame,
    offsets: bool = False,
    decoded: bool = False,
    vocabulary: str | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """``(doc_id, ids)`` of every row; with ``offsets`` also ``starts`` and ``ends``, as packed numbers.

    Packed numbers are little-endian unsigned 32-bit ones in a binary; :func:`unpacked` makes an array
    of them. With ``decoded`` the ids are turned back in the same pass, into ``data``, as :func:`decode_documents`
    does for stored ids. A null or empty text has no ids. Rows that repeat come once each, with a null doc_id too;
    other columns are not read. The vocabulary is opened where the tasks run, so its path must be known there.
    """
    path, cut_by = vocabulary or public_vocabulary(), pattern or public_pattern()
    names = ["ids", *(["starts", "ends"] if offsets else []), *(["data"] if decoded else [])]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.binary()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(path, cut_by, offsets)
        decoder = worker_decoder(path) if decoded else None
        for batch in batches:
            column = batch.column(1)
            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy()
            for first, last in lots(lengths, LOT):
                columns = list(zip(*encoder.encode([t or "" for t in column[first:last].to_pylist()]), strict=True))
                if decoder:
                    columns.append([decoder.data(np.frombuffer(ids, "<u4").tolist()) for ids in columns[0]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[first:last], *(pa.array(c, pa.binary()) for c in columns)], schema=schema
                )

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, ", ".join(["doc_id long", *(f"{n} binary" for n in names)])
    )


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids, data)``: the bytes that packed ids stand for.

    No ids give no bytes; null ids, and ids outside the vocabulary, a null. ``decode(data, 'UTF-8')`` is
    the text. Other columns are not read.
    """
    path = vocabulary or public_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_decoder(path)
        for batch in batches:
            data = [
                None if ids is None else decoder.data(np.frombuffer(ids, "<u4").tolist())
                for ids in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(data, pa.binary())], schema=schema
            )

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(
        run, "doc_id long, ids binary, data binary"
    )


def token_texts(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, place, id, text)``: a row per token with the characters it completes.

    A token that ends inside a character has an empty text, and the one that ends it the character.
    Rows with null ids, or an id outside the vocabulary, give none.
    """
    path = vocabulary or public_vocabulary()
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_decoder(path)
        for batch in batches:
            for doc, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(packed or b"", "<u4").tolist()
                said = decoder.texts(ids)
                if said:
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": [doc] * len(ids), "place": range(len(ids)), "id": ids, "text": said}, schema=schema
                    )

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(
        run, "doc_id long, place long, id long, text string"
    )


def unpacked(encoded: DataFrame, column: str) -> DataFrame:
    """Packed numbers of a column as an array of longs; a null stays null."""

    @F.pandas_udf("array<long>")
    def numbers(packed):
        return packed.map(lambda b: None if b is None else np.frombuffer(b, "<u4").astype(np.int64))

    return encoded.withColumn(column, numbers(column))
