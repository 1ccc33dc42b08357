"""Reading the provenance string a noisy line carries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODES = ("none", "legacy_one_comma", "min_steps", "max_steps")


def step_segments(steps: Column) -> Column:
    """The non-empty names of a steps string; null has none."""
    trimmed = F.transform(
        F.split(F.coalesce(steps, F.lit("")), ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")
    )
    return F.filter(trimmed, lambda s: s != "")


def passes(steps: Column, mode: str = "legacy_one_comma", low: int = 1, high: int = 1) -> Column:
    """Whether a row is kept; null counts as no steps in every mode."""
    if mode == "none":
        return F.lit(True)
    if mode == "legacy_one_comma":
        text = F.coalesce(steps, F.lit(""))
        return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) == 1
    if mode == "min_steps":
        return F.size(step_segments(steps)) >= low
    if mode == "max_steps":
        return F.size(step_segments(steps)) <= high
    raise ValueError(f"unknown steps filter {mode!r}; one of {', '.join(MODES)}")


def where_clause(steps: str, mode: str = "legacy_one_comma", low: int = 1, high: int = 1) -> str:
    """The same test as SQL text over a column name; empty when nothing is filtered."""
    text = f"coalesce({steps}, '')"
    count = (
        f"size(filter(split({text}, ','), s -> regexp_replace(s, '\\\\s+', '') != ''))"
    )
    if mode == "none":
        return ""
    if mode == "legacy_one_comma":
        return f"length({text}) - length(replace({text}, ',', '')) = 1"
    if mode == "min_steps":
        return f"{count} >= {low}"
    if mode == "max_steps":
        return f"{count} <= {high}"
    raise ValueError(f"unknown steps filter {mode!r}; one of {', '.join(MODES)}")
