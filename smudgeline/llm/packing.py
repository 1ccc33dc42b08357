"""Best-fit packing of tokenised documents, with bounds that certify how good it is.

Every partition is packed best fit decreasing, and dual feasible functions give a number of
sequences no packing of its pieces can go below. Where both agree the partition is done. The
partitions with a gap give up the pieces of their unfilled sequences; these are dealt anew, fewer
partitions taking more each, and packed again.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import in_batches, texts

CAPACITY = 2048
END = 0
#: tokens the vocabulary's tokenizers file adds to its ranks; texts that spell one out hold its id
ADDED = {"<|endoftext|>": 50256}
#: pieces a partition packs at first
PIECES_PER_PART = 2000


def public_vocabulary(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """The byte-level vocabulary at a path, by its ranks: the same ids as its tokenizers file."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(
        "pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=ADDED
    )


def pieces_of(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of pieces: a long document's first piece takes what the others leave."""
    n = len(ids)
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


def token_pieces(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every row's ids and the end id 0.

    A null text is an empty one and has the end id alone. Only documents above the capacity are
    cut. Rows that repeat give their pieces each; other columns are not read. The vocabulary is
    opened where the tasks run, so its path must be known there.
    """
    path = vocabulary or public_vocabulary()
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_to_numpy

        def work(batch: pa.RecordBatch) -> dict:
            out: dict = {n: [] for n in schema.names}
            for doc, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                ids = np.append(encode(text, allowed_special="all"), END).astype("<u4")
                for piece, (start, length) in enumerate(pieces_of(ids, capacity)):
                    row = (doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()))
                    for name, value in zip(schema.names, row, strict=True):
                        out[name].append(value)
            return out

        yield from in_batches(work, schema)(batches)

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Sequence and offset of each piece, and the number of sequences; longest pieces first.

    Open sequences are kept by the room they have, with one bit for each room that occurs, so the
    tightest fit is found with two operations on a number.
    """
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    sequence = np.zeros(len(lengths), np.int64)
    offset = np.zeros(len(lengths), np.int64)
    count = 0
    for at in np.argsort(-lengths, kind="stable"):
        need = int(lengths[at])
        fitting = rooms >> need
        if fitting:
            room = need + (fitting & -fitting).bit_length() - 1
            bin_ = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            bin_, room = count, capacity
            count += 1
        sequence[at], offset[at] = bin_, capacity - room
        room -= need
        if room:
            by_room[room].append(bin_)
            rooms |= 1 << room
    return sequence, offset, count


def lower_bound(lengths: np.ndarray, capacity: int, steps: int = 24) -> int:
    """The most that the families of dual feasible functions prove a packing to need.

    Each maps sizes so that any set fitting one sequence still sums to at most a sequence: the
    sizes themselves; small pieces dropped and large ones rounded up to a whole; and rounding down to
    k-ths that favours pieces just above one.
    """
    if not len(lengths):
        return 0
    sizes, counts = np.unique(lengths, return_counts=True)
    best = -(-int((sizes * counts).sum()) // capacity)
    half = sizes[sizes * 2 <= capacity]
    for small in np.unique(half[:: max(1, len(half) // steps)]):
        value = np.where(sizes > capacity - small, capacity, np.where(sizes < small, 0, sizes))
        best = max(best, -(-int((value * counts).sum()) // capacity))
    for k in range(1, steps):
        scaled = sizes * (k + 1)
        exact = scaled % capacity == 0
        # k + 1 pieces of exactly 1/(k+1) fit: they keep their size, others round down to k-ths
        value = np.where(exact, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * counts).sum()) // (k * capacity)))
    return best


def part_packer(capacity: int, turn: int, last: bool):
    """Packs one part and says which of its pieces are to be dealt anew."""

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        order = [n for n in ("doc_id", "piece", "_row") if n in group]
        group = group.sort_values(order, kind="stable").reset_index(drop=True)
        lengths = group["length"].to_numpy()
        sequence, offset, count = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        used = np.bincount(sequence, lengths, count)
        gap = count > bound and not last
        part = int(group["part"].iloc[0])
        return group.assign(
            sequence_id=sequence + (turn << 56) + (part << 28),
            offset=offset,
            open=(used[sequence] < capacity) if gap else False,
            part=part, sequences=count, bound=bound,
        )

    return packed


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, per_part: int = PIECES_PER_PART, rounds: int = 3
) -> tuple[DataFrame, DataFrame]:
    """``pieces`` with ``sequence_id`` and ``offset``, and ``(round, part, sequences, bound)``.

    Parts hold about ``per_part`` pieces by a hash of the row, so no document or id weighs on one
    part. After each round the parts whose count exceeds their bound take their unfilled sequences
    apart; those pieces are packed again in parts that draw on several of the former ones. The last round
    is final. Sequence ids are the round, part and number in it. An empty table packs to nothing.
    """
    base = stored(pieces, "pieces")
    todo = base.select("*", F.col("_metadata.row_index").alias("_row"))
    total = base.count()
    columns = pieces.columns
    names = [*columns, "_row"]
    kinds = {f.name: f.dataType.simpleString() for f in todo.schema}
    schema = ", ".join(f"{n} {kinds[n]}" for n in names)
    schema += ", sequence_id long, offset long, open boolean, part int, sequences long, bound long"
    done: list[DataFrame] = []
    reports: list[DataFrame] = []
    for turn in range(rounds):
        last = turn == rounds - 1
        parts = max(1, round(total / per_part))

        dealt = todo.select(
            *names,
            F.pmod(F.xxhash64(F.lit(turn), *(n for n in ("doc_id", "piece") if n in columns), "_row"), F.lit(parts))
            .cast("int").alias("part"),
        )
        result = stored(dealt.groupBy("part").applyInPandas(part_packer(capacity, turn, last), schema), "packed")
        done.append(result.filter("not open").select(*columns, "sequence_id", "offset"))
        reports.append(
            result.groupBy("part")
            .agg(
                F.max("sequences").alias("sequences"), F.max("bound").alias("bound"),
                F.countDistinct(F.when(F.col("open"), F.col("sequence_id"))).alias("reopened"),
            )
            .select(F.lit(turn).alias("round"), "*")
        )
        if last:
            break
        todo = result.filter("open").select(*names)
        left = todo.count()
        if not left:
            break
        # pieces of at least two former parts meet, without a part growing beyond its measure
        total = min(left, per_part * max(1, left // (2 * per_part) + 1))
    packed_all, report = done[0], reports[0]
    for more in done[1:]:
        packed_all = packed_all.unionByName(more)
    for more in reports[1:]:
        report = report.unionByName(more)
    return packed_all, report


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Every piece of every row with its sequence and its place there."""
    return pack(token_pieces(documents, capacity, vocabulary), capacity)[0]
