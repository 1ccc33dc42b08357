"""Vector code compression: each part of a vector becomes the index of its nearest codebook entry.

Distinct parts are counted once and kept in lexicographic order, so a task holds a trie of them. Walking it
depth first, the squared distances to all entries summed along a prefix are shared by every part below it;
at a leaf the least of them is the entry, and the part times its count goes into that entry's sum. Only
sums per entry leave a task. All arithmetic is on whole numbers, so any partitioning gives the same books.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import skew_join
from ..session import stored
from .topk import whole_numbers

#: leaves whose distances are held at once; the largest component taken
LEAVES, LARGEST = 512, 1 << 26


def walk(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (the lower index of equals) and squared distance of each of the sorted ``parts``."""
    n, width = parts.shape
    entry, distance = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return entry, distance
    differ = parts[1:] != parts[:-1]
    #: leading components each row has in common with the one before it
    shared = np.zeros(n, np.int64)
    if width:
        shared[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        spread = int(max(parts.max(), book.max())) - int(min(parts.min(), book.min()))
        small = spread * spread * width < 2**31
    else:
        small = True
    parts, book = (a.astype(np.int32 if small else np.int64) for a in (parts, book))
    columns = np.ascontiguousarray(book.T)

    def finish(first: int, end: int, depth: int, above: np.ndarray) -> None:
        """All leaves of a stretch that shares ``depth`` components, level by level."""
        node = np.zeros(end - first, np.int64)
        sums = above[None, :]
        for d in range(depth, width):
            opens = shared[first:end] <= d
            opens[0] = True
            starts = np.flatnonzero(opens)
            step = parts[first:end][starts, d][:, None] - columns[d][None, :]
            step *= step
            step += sums[node[starts]] if len(sums) > 1 else sums
            node, sums = np.cumsum(opens) - 1, step
        best = sums.argmin(axis=1)
        entry[first:end] = best[node]
        distance[first:end] = sums[np.arange(len(sums)), best][node]

    # the sums along the path from the root are all that waits while a subtrie is done
    todo = [(0, n, 0, np.zeros(len(book), parts.dtype))]
    while todo:
        first, end, depth, sums = todo.pop()
        if end - first <= LEAVES or depth == width:
            finish(first, end, depth, sums)
            continue
        edges = [first, *(np.flatnonzero(shared[first + 1 : end] <= depth) + first + 1).tolist(), end]
        later, held = [], first
        for left, right in zip(edges, edges[1:], strict=False):
            if right - held > LEAVES and held < left:
                finish(held, left, depth, sums)
                held = left
            if right - held > LEAVES:
                later.append((left, right, depth + 1, sums + (parts[left, depth] - columns[depth]) ** 2))
                held = right
        if held < end:
            finish(held, end, depth, sums)
        todo += reversed(later)
    return entry, distance


def lexicographic(parts: np.ndarray) -> np.ndarray:
    """The order of rows by their components, the first one first."""
    return np.lexsort(parts.T[::-1]) if parts.shape[1] else np.arange(len(parts))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def whole_vectors(vectors: DataFrame, vector: Column, scale: int = 1024, parts: int = 4) -> tuple[DataFrame, int]:
    """Rows with ``data``, the floors as an array of ints, and how many components a part has.

    Rows whose vector is null or holds a null or a non-finite component are left out. Vectors of fewer
    components than the longest are filled up with zeros, as are all up to a multiple of ``parts``. A
    component beyond 2^26 after scaling is an error, as sums of squares would leave 64 bits.
    """
    kept = vectors.withColumn("data", whole_numbers(vector, scale)).filter(F.col("data").isNotNull())
    size, most = kept.agg(
        F.max(F.size("data")), F.max(F.array_max(F.transform("data", lambda x: F.abs(x))))
    ).first()
    if (most or 0) > LARGEST:
        raise ValueError(f"a component of {most:.0f} after scaling; at most {LARGEST} is exact")
    width = -(-(size or 0) // parts)
    filled = F.concat(
        F.transform("data", lambda x: x.cast("int")),
        F.array_repeat(F.lit(0), F.lit(width * parts) - F.size("data")),
    )
    return kept.withColumn("data", filled), width


def distinct_parts(kept: DataFrame, parts: int, width: int) -> DataFrame:
    """``(position, part, n)`` of every distinct part, stored in lexicographic stretches."""
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda p: F.slice("data", p * width + 1, width))
    counted = (
        kept.select(F.posexplode(cut).alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("n"))
    )
    return stored(
        counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part"), "parts"
    )


def entry_sums(counted: DataFrame, books: list[np.ndarray]) -> list[dict[int, tuple[int, list[int]]]]:
    """By position: entry to the count and componentwise sum of its parts; the size of the books at most."""
    width = books[0].shape[1]
    schema = pa.schema(
        [("position", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("value", pa.int64())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            position = batch.column(0).to_numpy()
            rows, n = matrix(batch.column(1), width), batch.column(2).to_numpy()
            for p in np.unique(position).tolist():
                at = position == p
                entry, _ = walk(rows[at], books[p])
                np.add.at(counts[p], entry, n[at])
                np.add.at(sums[p], entry, rows[at] * n[at][:, None])
        for p, (count, total) in enumerate(zip(counts, sums, strict=True)):
            used = np.flatnonzero(count)
            values = np.concatenate([count[used][:, None], total[used]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(values.size, p, np.int32)),
                    pa.array(np.repeat(used, width + 1).astype(np.int32)),
                    pa.array(np.tile(np.arange(-1, width, dtype=np.int32), len(used))),
                    pa.array(values.ravel()),
                ],
                schema=schema,
            )

    found = (
        counted.mapInArrow(run, "position int, entry int, place int, value long")
        .groupBy("position", "entry", "place")
        .agg(F.sum("value").alias("value"))
        .collect()
    )
    out: list[dict] = [{} for _ in books]
    for r in sorted(found):
        count, total = out[r["position"]].get(r["entry"], (0, []))
        out[r["position"]][r["entry"]] = (r["value"], []) if r["place"] < 0 else (count, [*total, r["value"]])
    return out


def train(kept: DataFrame, width: int, parts: int = 4, entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """One codebook per part position, of ``entries`` entries or as many as there are rows.

    Books start as the parts of the smallest vec_ids (null after all, ties by the vector). Each round
    replaces every entry that is some part's nearest by the floor of the mean of its parts.
    """
    first = kept.select("vec_id", "data").orderBy(F.col("vec_id").asc_nulls_last(), "data").limit(entries).collect()
    rows = np.array([r["data"] for r in first], np.int64).reshape(len(first), parts * width)
    books = [rows[:, p * width : (p + 1) * width].copy() for p in range(parts)]
    if len(first):
        counted = distinct_parts(kept, parts, width)
        for _ in range(rounds):
            for book, sums in zip(books, entry_sums(counted, books), strict=True):
                for entry, (count, total) in sums.items():
                    book[entry] = [t // count for t in total]
    return books


def encode(kept: DataFrame, books: list[np.ndarray], carried: str = "label") -> DataFrame:
    """``(vec_id, <carried>, codes, error)``: an index per part, and the squared distance over all parts."""
    width = books[0].shape[1]
    kind = kept.schema[carried].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = matrix(batch.column(2), width * len(books))
            codes = np.zeros((len(rows), len(books)), np.uint8)
            error = np.zeros(len(rows), np.int64)
            for p, book in enumerate(books):
                part = rows[:, p * width : (p + 1) * width]
                order = lexicographic(part)
                entry, distance = walk(part[order], book)
                codes[order, p] = entry
                error[order] += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)],
                names=["vec_id", carried, "codes", "error"],
            )

    return kept.select(F.col("vec_id").cast("long"), carried, "data").mapInArrow(
        run, f"vec_id long, `{carried}` {kind}, codes binary, error long"
    )


def decode(coded: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``(vec_id, data)``: the vectors that codes stand for, entry by entry."""
    width = books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([list(c) for c in batch.column(1).to_pylist()], np.int64).reshape(-1, len(books))
            rows = np.concatenate([b[codes[:, p]] for p, b in enumerate(books)], axis=1)
            values = pa.array(rows.ravel(), pa.int64())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (width * len(books)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(offsets, values)], names=["vec_id", "data"]
            )

    return coded.select("vec_id", "codes").mapInArrow(run, "vec_id long, data array<long>")


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, as decimals joined by commas."""
    numbers = [str(x) for book in books for x in book.ravel().tolist()]
    return hashlib.sha256(",".join(numbers).encode()).hexdigest()


def compress(
    vectors: DataFrame, vector: str = "embedding", label: str = "label", scale: int = 1024,
    parts: int = 4, entries: int = 256, rounds: int = 4,
) -> tuple[DataFrame, list[np.ndarray]]:
    """``(vec_id, <label>, codes, error, label_error)`` of every usable row, and the codebooks.

    ``label_error`` is the error summed over rows of the same label, null labels together. Rows that
    repeat, and rows with a null vec_id, are coded each. An empty table gives no rows. At most 256
    entries, as a code is a byte. Other columns are not read. See :func:`whole_vectors` for the vectors.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    given = vectors.select("vec_id", F.col(label), F.col(vector).alias("_vector"))
    kept, width = whole_vectors(given, F.col("_vector"), scale, parts)
    books = train(kept, width, parts, entries, rounds)
    coded = stored(encode(kept, books, label), "codes")
    # nulls join as a group of their own
    key = F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("null"))
    keyed = coded.withColumn("_label", key)
    totals = keyed.groupBy("_label").agg(F.sum("error").alias("label_error"))
    return skew_join(keyed, totals, "_label", "left", "vec_id").drop("_label"), books


def hex_code(codes: Column) -> Column:
    """Indexes in part order, two lower-case hexadecimal digits each."""
    return F.lower(F.hex(codes))
