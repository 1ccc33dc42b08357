"""Yes/no scores of a candidate and the score it is picked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import edit_similarity

POLICIES = ("min_nll_yes", "max_yes_no_margin", "encoder_margin_blend")

#: adds nll_yes and nll_no to rows of (noisy, candidate, prompt, ...)
Scorer = Callable[[DataFrame], DataFrame]


def policy_name(policy: str) -> str:
    name = policy.strip().lower()
    if name not in POLICIES:
        raise ValueError(f"pick policy must be one of {', '.join(POLICIES)}; got {policy!r}")
    return name


def edit_scorer(noisy: str = "noisy", candidate: str = "candidate") -> Scorer:
    """A model-free scorer: the edit similarity read as the chance of "yes"."""

    def score(df: DataFrame) -> DataFrame:
        near = edit_similarity(F.upper(noisy), F.upper(candidate))
        chance = F.greatest(F.least(near, F.lit(0.999999)), F.lit(0.000001))
        return (
            df.withColumn("_chance", chance)
            .withColumn("nll_yes", -F.log("_chance"))
            .withColumn("nll_no", -F.log(F.lit(1.0) - F.col("_chance")))
            .drop("_chance")
        )

    return score


def known_nll(nll: Column) -> Column:
    """A score that could not be had counts as infinite."""
    known = nll.cast("double")
    return F.when(known.isNull() | F.isnan(known), F.lit(float("inf"))).otherwise(known)


def failed(nll_yes: Column, nll_no: Column) -> Column:
    """Whether scoring failed: a cost is null or not a number, or both are infinite."""
    yes, no = known_nll(nll_yes), known_nll(nll_no)
    endless = (yes == float("inf")) & (no == float("inf"))
    return nll_yes.isNull() | nll_no.isNull() | F.isnan(nll_yes) | F.isnan(nll_no) | endless


def yes_no_label(nll_yes: Column, nll_no: Column) -> Column:
    """"yes" when yes costs less, "no" otherwise and on ties, "" when scoring failed."""
    return (
        F.when(failed(nll_yes, nll_no), "")
        .when(nll_yes < nll_no, "yes")
        .otherwise("no")
    )


def margin(nll_yes: Column, nll_no: Column) -> Column:
    """How much more "no" costs than "yes"; a row without scores has no lead."""
    return F.when(failed(nll_yes, nll_no), F.lit(float("nan"))).otherwise(nll_no - nll_yes)


def pick_score(
    policy: str, nll_yes: Column, nll_no: Column, cosine_norm: Column, weight: float = 2.0
) -> Column:
    """The score the highest of which wins; a failed row scores minus infinity."""
    name = policy_name(policy)
    if name == "min_nll_yes":
        score = -nll_yes
    elif name == "max_yes_no_margin":
        score = nll_no - nll_yes
    else:
        score = nll_no - nll_yes + F.lit(float(weight)) * cosine_norm
    lost = failed(nll_yes, nll_no) | score.isNull() | F.isnan(score)
    return F.when(lost, F.lit(float("-inf"))).otherwise(score)


def run_stamp(at: Column, compact: bool = False) -> Column:
    """``03DEC2025_05_20_02``, or ``20251203_052002``."""
    if compact:
        return F.date_format(at, "yyyyMMdd_HHmmss")
    return F.upper(F.date_format(at, "ddMMMyyyy_HH_mm_ss"))
