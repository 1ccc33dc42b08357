"""What the operators of this package share: tables, word rules, Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: a word is a run of characters other than the ASCII blanks; Java's spelling of it
WORD = r"[^\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def count_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ascii_words(text: str) -> list[bytes]:
    """Words as UTF-8: bytes.split() cuts at exactly the six ASCII blanks."""
    return text.encode("utf-8", "surrogatepass").split()


def in_batches(work: Callable[[pa.RecordBatch], dict | None], schema: pa.Schema):
    """A mapInArrow function from one that turns a batch into columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = work(batch)
                if columns is not None:
                    yield pa.RecordBatch.from_arrays(
                        [
                            c if isinstance(c, pa.Array) else pa.array(c, schema.field(n).type)
                            for n, c in columns.items()
                        ],
                        schema=schema,
                    )

    return run


def texts(column: pa.Array) -> list[str]:
    """Texts of a column; a null is an empty text."""
    return [t or "" for t in column.to_pylist()]


def lots(lengths: Iterable[int], size: int) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about ``size`` bytes each."""
    first = held = at = 0
    for at, length in enumerate(lengths, 1):
        held += length
        if held >= size:
            yield first, at
            first, held = at, 0
    if first < at:
        yield first, at


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen before; emptied when it has grown large."""

    LIMIT = 1_000_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` or more powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = max(4096, 2 * n)
        base = 0x9E3779B97F4A7C15
        with np.errstate(over="ignore"):
            made = tuple(
                np.cumprod(np.array([1] + [b] * (size - 1), np.uint64), dtype=np.uint64)
                for b in (base, pow(base, -1, 1 << 64))
            )
        _POWERS[:] = [made]
    return tuple(p[:n] for p in _POWERS[0])
