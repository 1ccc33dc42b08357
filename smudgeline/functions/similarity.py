"""Similarity of vectors and of strings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: cells of one padded batch of characters, to bound what a batch takes
_CELLS = 1 << 21


def dot(a: Column, b: Column) -> Column:
    """Sum of products, in doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """``a`` at length one; a zero vector stays as it is."""
    length = norm(a)
    return F.when(length == 0, a.cast("array<double>")).otherwise(
        F.transform(a, lambda x: x.cast("double") / length)
    )


def cosine(a: Column, b: Column) -> Column:
    """Cosine; 0 when either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(0.0)).otherwise(dot(a, b) / lengths)


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points of a batch, a row for each text, read from one buffer."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(lengths) - lengths
    out = np.zeros((len(texts), width), np.int32)
    out[np.repeat(np.arange(len(texts)), lengths), np.arange(len(flat)) - np.repeat(starts, lengths)] = flat
    return out


def _jaro_winkler(left: list[str], right: list[str]) -> np.ndarray:
    """All pairs of one batch at once: a loop over places of the left, not over rows."""
    la = np.array([len(t) for t in left])
    lb = np.array([len(t) for t in right])
    wa, wb = max(int(la.max()), 1), max(int(lb.max()), 1)
    a, b = _codes(left, wa), _codes(right, wb)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    spots = np.arange(wb)
    free = spots[None, :] < lb[:, None]
    hit_a = np.zeros(a.shape, bool)
    rows = np.arange(len(left))
    for i in range(wa):
        near = np.abs(spots[None, :] - i) <= reach[:, None]
        ok = free & near & (b == a[:, i : i + 1]) & (i < la)[:, None]
        first = ok.argmax(axis=1)
        found = ok[rows, first]
        hit_a[found, i] = True
        free[rows[found], first[found]] = False
    hit_b = (spots[None, :] < lb[:, None]) & ~free
    m = hit_a.sum(axis=1)
    # matched characters of both sides, packed to the left in order
    width = max(int(m.max()), 1)
    pa, pb = np.zeros((len(left), width), np.int32), np.zeros((len(left), width), np.int32)
    for codes, hits, out in ((a, hit_a, pa), (b, hit_b, pb)):
        r, c = np.nonzero(hits)
        out[r, hits.cumsum(axis=1)[r, c] - 1] = codes[r, c]
    swaps = (pa != pb).sum(axis=1) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = (m / la + m / lb + (m - swaps) / m) / 3
    jaro = np.where(m == 0, 0.0, jaro)
    jaro = np.where((la == 0) & (lb == 0), 1.0, jaro)
    k = min(4, wa, wb)
    same = (a[:, :k] == b[:, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None])
    prefix = same.cumprod(axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


def _similar(left: pd.Series, right: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=left.index)
    known = left.notna() & right.notna()
    lengths = np.maximum(left[known].str.len(), right[known].str.len())
    ordered = lengths.sort_values(ascending=False, kind="stable")
    at = 0
    while at < len(ordered):
        # rows of like length go together, the longest first, so padding stays small
        take = at + max(1, _CELLS // max(int(ordered.iloc[at]), 1))
        index = ordered.index[at:take]
        out.loc[index] = _jaro_winkler(left.loc[index].tolist(), right.loc[index].tolist())
        at = take
    return out


@F.pandas_udf(T.DoubleType())
def _jaro_winkler_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return _similar(left, right)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler over code points; a null counts as an empty text.

    Equal texts are settled before Python: they cross as nulls.
    """
    a, b = F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))
    differ = a != b
    return F.coalesce(
        _jaro_winkler_udf(F.when(differ, a), F.when(differ, b)), F.lit(1.0)
    )


@F.pandas_udf(T.DoubleType())
def _jaro_winkler_sql(left: pd.Series, right: pd.Series) -> pd.Series:
    return _similar(left.fillna(""), right.fillna(""))


def register_functions(spark: SparkSession) -> None:
    """Make ``jaro_winkler(a, b)`` known to SQL text; a null counts as an empty text there too."""
    spark.udf.register("jaro_winkler", _jaro_winkler_sql)


def edit_similarity(a: Column, b: Column) -> Column:
    """One minus the share of edits, inside the JVM."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return F.lit(1.0) - F.levenshtein(a, b) / longest
