"""The row functions in SQL text: temporary SQL functions made from the same Column definitions.

A Column prints itself as SQL but for operators, which it prints as calls; with their names quoted they are
calls that SQL knows. So each function is written once, as a Column, and SQL sees the same plan.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import clean, draws, noise, similarity, steps

#: a quoted text, or the name of an operator that opens a call
_TOKEN = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(>=|<=>|<=|!=|==|[%+*/<>=!|&^~-]|and|or|not)\(", re.DOTALL)


def sql_text(column: Column) -> str:
    """A Column without table columns of other names than its own parameters, as SQL text."""
    printed = str(column)
    inner = printed[len("Column<'") : -len("'>")]
    return _TOKEN.sub(lambda m: m[0] if m[1] is None else f"`{m[1]}`(", inner)


def _create(spark: SparkSession, name: str, parameters: str, returns: str, body: Column) -> None:
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {sql_text(body)}"
    )


def register_noise(
    spark: SparkSession,
    only: Sequence[str] | None = None,
    options: Mapping[str, Mapping[str, object]] | None = None,
) -> list[str]:
    """Make the noise functions known to SQL: ``name(text, base)``, a struct of ``text`` and ``step``.

    Names are those of the steps. ``base`` comes from ``noise_base``. ``options`` holds arguments of noise
    functions by name, fixed for the session's SQL. Returns the names made.
    """
    names = list(noise.STEPS) if only is None else list(only)
    for name in names:
        made = noise.STEPS[name](F.col("text"), F.col("base"), **(options or {}).get(name, {}))
        _create(spark, name, "text STRING, base BIGINT", "STRUCT<text: STRING, step: STRING>", made)
    return names


def register_helpers(spark: SparkSession) -> list[str]:
    """Make what goes with them known to SQL.

    ``noise_base(seed, key, iteration, step)``: the base of a row's draws; ``step_count(steps)``: how many steps a
    steps text names; ``squeeze_runs``, ``specials_to_space`` of a text; ``edit_similarity(a, b)``.
    """
    text = F.col("text")
    parts = F.concat_ws("|", *(F.col(c).cast("string") for c in ("seed", "key", "iteration", "step")))
    base = F.conv(F.substring(F.md5(parts), 1, 8), 16, 10).cast("long") % draws.PRIME
    made = {
        "noise_base": ("seed BIGINT, key STRING, iteration INT, step INT", "BIGINT", base),
        "step_count": ("steps STRING", "INT", F.size(steps.step_segments(F.col("steps")))),
        "squeeze_runs": ("text STRING", "STRING", clean.squeeze_runs(text)),
        "specials_to_space": ("text STRING", "STRING", clean.specials_to_space(text)),
        "edit_similarity": ("a STRING, b STRING", "DOUBLE", similarity.edit_similarity(F.col("a"), F.col("b"))),
    }
    for name, (parameters, returns, body) in made.items():
        _create(spark, name, parameters, returns, body)
    return list(made)


def register_all(spark: SparkSession) -> list[str]:
    """All functions SQL text can call, ``jaro_winkler`` included."""
    similarity.register_functions(spark)
    return [*register_noise(spark), *register_helpers(spark), "jaro_winkler"]
