"""Small expression helpers shared by the row functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_text(value: Column) -> Column:
    """A key or text as a string, as all of them are kept."""
    return value.cast("string")


def json_text(value: Column, empty: str = "{}") -> Column:
    """A map, list or struct as JSON text; ``empty`` for null."""
    return F.coalesce(F.to_json(value), F.lit(empty))


def distinct_sorted(values: Column) -> Column:
    """Each value of a list once, in order; a null list stays null."""
    return F.sort_array(F.array_distinct(values))


def upto(n: Column) -> Column:
    """``[1, ..., n]``, empty when ``n`` is below one."""
    return F.when(n >= 1, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(
        F.array().cast("array<int>")
    )


def part(text: Column, start: Column | int, length: Column | int) -> Column:
    """``length`` characters of ``text`` from the 1-based ``start``."""
    start = F.lit(start) if isinstance(start, int) else start
    length = F.lit(length) if isinstance(length, int) else length
    return text.substr(start, length)


def head(text: Column, length: Column) -> Column:
    """The first ``length`` characters."""
    return text.substr(F.lit(1), length)


def tail(text: Column, start: Column) -> Column:
    """Everything from the 1-based ``start`` on."""
    return text.substr(start, F.greatest(F.length(text) - start + 1, F.lit(0)))


def replace_first(text: Column, find: Column, new: Column) -> Column:
    """Replace the first occurrence only."""
    at = F.call_function("instr", text, find)
    return F.when(
        at > 0, F.concat(head(text, at - 1), new, tail(text, at + F.length(find)))
    ).otherwise(text)


def words_literal(values: list[str]) -> Column:
    """A string array literal: one split of one literal, folded when planned."""
    if any("\x1f" in v for v in values):
        raise ValueError("separator occurs in a value")
    return F.split(F.lit("\x1f".join(values)), "\x1f", -1)


def ints_literal(values: list[int]) -> Column:
    """An int array literal, built the same way."""
    return words_literal([str(v) for v in values]).cast("array<int>")
