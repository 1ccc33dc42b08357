"""Cleaning a noisy line before it is matched."""

from __future__ import annotations

import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicons import SEPARATORS

_COMBINING = {c: None for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c))}


@F.pandas_udf(T.StringType())
def _without_marks(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFD").str.translate(_COMBINING)


def strip_combining(text: Column) -> Column:
    """Decompose and drop characters of nonzero combining class; null stays null.

    Spark has no decomposition, so this is an Arrow function. Plain ASCII needs none: such
    rows cross to Python as nulls.
    """
    marked = F.when(text.rlike(r"[^\x00-\x7F]"), text)
    return F.coalesce(_without_marks(marked), text)


def squeeze_runs(text: Column) -> Column:
    """Runs of three or more equal characters become two."""
    return F.regexp_replace(text, r"(?s)(.)\1{2,}", "$1$1")


def specials_to_space(text: Column) -> Column:
    """Special characters become spaces, many spaces one, none at the ends."""
    specials = "".join(SEPARATORS)
    spaced = F.translate(text, specials, " " * len(specials))
    return F.trim(F.regexp_replace(spaced, " +", " "))


def clean_line(text: Column, specials: bool = True) -> Column:
    """Marks off, runs squeezed, special characters to spaces."""
    out = squeeze_runs(strip_combining(text))
    return specials_to_space(out) if specials else out


def fraction_glyphs(text: Column, table: dict[str, str]) -> Column:
    """Replace the two digits of every known fraction by its glyph."""
    for digits, glyph in table.items():
        text = F.replace(text, F.lit(digits), F.lit(glyph))
    return text
