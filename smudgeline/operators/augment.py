"""Building noisy lines: samples, plans of steps, and the grid of lines by plans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations, permutations
from math import comb, perm

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import draws, noise
from ..functions.exprs import bind, words_literal
from .split import SORTED_ROWS, first_by

# Column names of a noisy table.
CANONICAL = "first_line"
NOISY = "malformed_first_line"
STEPS = "malformed_first_line_malform_steps"


#: own arguments of noise functions, by step name
StepOptions = Mapping[str, Mapping[str, object]]


def sample_lines(lines: DataFrame, n: int, seed: int = 42, key: str = "line_id") -> DataFrame:
    """The first ``n`` lines in an order drawn from the seed; ``key`` is unique.

    A large ``n`` is found as a cut in the draws, and the lines are filtered where they lie.
    """
    draw = draws.base(seed, F.col(key))
    return lines.orderBy(draw, key).limit(n) if n <= SORTED_ROWS else first_by(lines, draw, key, n)


def add_working_column(lines: DataFrame, canonical: str = CANONICAL, noisy: str = NOISY) -> DataFrame:
    """Copy the canonical column under the noisy name and start with no steps."""
    return lines.withColumn(noisy, F.col(canonical).cast("string")).withColumn(
        f"{noisy}_malform_steps", F.lit("")
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames, by column name; there must be one at least."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def unpack_step(df: DataFrame, result: str, noisy: str = NOISY) -> DataFrame:
    """Move a function's text to the noisy column and append its name to the steps."""
    steps = f"{noisy}_malform_steps"
    return (
        df.withColumn(noisy, F.col(result)["text"])
        .withColumn(steps, F.concat(F.col(steps), F.lit(", "), F.col(result)["step"]))
        .drop(result)
    )


def plan_lists(steps: Sequence[str], n: int, ordered: bool = False) -> list[list[str]]:
    """All selections of ``n`` steps without repeats, unordered unless asked."""
    pairs = permutations(steps, n) if ordered else combinations(steps, n)
    return [list(p) for p in pairs]


def plan_count(n_steps: int, most: int, ordered: bool = False) -> int:
    """How many plans of one to ``most`` of ``n_steps`` steps there are."""
    return sum((perm if ordered else comb)(n_steps, n) for n in range(1, most + 1))


def _longs(values: Sequence[int]) -> Column:
    return words_literal([str(v) for v in values]).cast("array<long>")


def plan_by_number(number: Column, steps: Sequence[str], most: int, ordered: bool = False) -> Column:
    """The plan of that number, from 0: single steps first, then pairs, each size in the order of the steps.

    The number is taken apart by counts of selections, so no list of plans is ever written out. A null
    for a number there is no plan of.
    """
    names, n = words_literal(list(steps)), len(steps)
    count = perm if ordered else comb
    sizes = [count(n, k) for k in range(1, most + 1)]
    firsts = [sum(sizes[:k]) for k in range(most)]
    size = F.size(F.filter(_longs(firsts), lambda f: f <= number))
    rest = number.cast("long") - F.get(_longs(firsts), size - 1)
    #: selections of k out of m, at m * (most + 1) + k
    table = _longs([count(m, k) for m in range(n + 1) for k in range(most + 1)])

    def ways(m: Column, k: Column) -> Column:
        return F.get(table, (m * (most + 1) + k).cast("int"))

    def combination(size: Column, rest: Column) -> Column:
        start = F.struct(rest.alias("rest"), size.alias("left"), F.array().cast("array<string>").alias("plan"))

        def step(s: Column, at: Column) -> Column:
            """Take the step, or pass over all selections that begin with it."""
            here = F.when(s["left"] > 0, ways(F.lit(n - 1) - at, s["left"] - 1)).otherwise(F.lit(0).cast("long"))
            taken = s["rest"] < here
            return F.struct(
                F.when(taken, s["rest"]).otherwise(s["rest"] - here).alias("rest"),
                F.when(taken, s["left"] - 1).otherwise(s["left"]).alias("left"),
                F.when(taken, F.concat(s["plan"], F.array(F.get(names, at)))).otherwise(s["plan"]).alias("plan"),
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), start, step, lambda s: s["plan"])

    def permutation(size: Column, rest: Column) -> Column:
        start = F.struct(rest.alias("rest"), names.alias("free"), F.array().cast("array<string>").alias("plan"))

        def step(s: Column, at: Column) -> Column:
            per_step = ways(F.lit(n - 1) - at, size - 1 - at)
            chosen = F.get(s["free"], F.floor(s["rest"] / per_step).cast("int"))
            return F.struct(
                (s["rest"] % per_step).alias("rest"),
                F.array_remove(s["free"], chosen).alias("free"),
                F.concat(s["plan"], F.array(chosen)).alias("plan"),
            )

        return F.aggregate(F.sequence(F.lit(0), size - 1), start, step, lambda s: s["plan"])

    make = permutation if ordered else combination
    made = bind(size, lambda k: bind(rest, lambda r: make(k, r)))
    return F.when((number >= 0) & (number < plan_count(n, most, ordered)), made)


def numbered_plans(
    spark: SparkSession, steps: Sequence[str], most: int, ordered: bool = False
) -> DataFrame:
    """``(plan_no, steps_arr, n_steps)`` of every plan of one to ``most`` steps; nothing passes the driver."""
    rows = spark.range(plan_count(len(steps), most, ordered)).withColumnRenamed("id", "plan_no")
    made = made_once(rows, "steps_arr", plan_by_number(F.col("plan_no"), steps, most, ordered))
    return made.withColumn("n_steps", F.size("steps_arr"))


def run_step(
    step: Column,
    text: Column,
    base: Column,
    only: Sequence[str],
    options: StepOptions | None = None,
) -> Column:
    """The text after the step named in ``step``; unknown or null names change nothing."""
    out = None
    for name in only:
        new = noise.STEPS[name](text, base, **(options or {}).get(name, {}))["text"]
        out = F.when(step == name, new) if out is None else out.when(step == name, new)
    return text if out is None else out.otherwise(text)


def steps_text(plan: Column) -> Column:
    """``", step"`` per step, leading comma included."""
    return F.concat_ws("", F.transform(plan, lambda s: F.concat(F.lit(", "), s)))


def _renamed(plan: Column, name: str, label: str) -> Column:
    return F.transform(plan, lambda s: F.when(s == name, label).otherwise(s))


def made_once(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Set a costly column so that later filters and projections read it and never repeat it.

    A filter is pushed through a projection by copying the expression; it is not pushed
    through the row generator used here.
    """
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.explode(F.array(value)).alias(column))


def apply_steps(
    lines: DataFrame,
    steps: Sequence[str],
    seed: int = 42,
    key: str = "line_id",
    noisy: str = NOISY,
    iteration: Column | None = None,
    options: StepOptions | None = None,
) -> DataFrame:
    """Apply the named steps in order, repeats allowed; earlier steps text starts over."""
    iteration = F.lit(0) if iteration is None else iteration
    out = lines.withColumn(f"{noisy}_malform_steps", F.lit(""))
    for at, name in enumerate(steps):
        base = draws.base(seed, F.col(key), iteration, F.lit(at))
        made = noise.STEPS[name](F.col(noisy), base, **(options or {}).get(name, {}))
        out = unpack_step(made_once(out, "_result", made), "_result", noisy)
    return out


def augment_grid(
    lines: DataFrame,
    plans: Sequence[Sequence[str]],
    iterations: int,
    seed: int = 42,
    key: str = "line_id",
    canonical: str = CANONICAL,
    noisy: str = NOISY,
    partitions: int | None = None,
    first_iteration: int = 1,
    first_row: int = 0,
    options: StepOptions | None = None,
) -> DataFrame:
    """Every line by every plan by every iteration, in one narrow pass.

    The grid is exploded inside each row, so nothing is shuffled or joined. ``partitions``
    spreads a small source before it grows; a large one is best left where it lies.
    Adds ``row_id, plan_no, iteration, steps_arr, n_steps`` and the noisy columns. A later
    grid over the same lines starts at a later iteration and row to give new texts and ids.
    ``options`` holds arguments of noise functions by step name.
    """
    lists = [list(p) for p in plans]
    depth = max((len(p) for p in lists), default=0)
    flat = words_literal(["\x1e".join(p) for p in lists])
    source = lines.repartition(partitions, key) if partitions else lines
    out = source.select("*", F.posexplode(flat).alias("plan_no", "_plan")).withColumn(
        "steps_arr",
        F.when(F.col("_plan") == "", F.array().cast("array<string>")).otherwise(F.split("_plan", "\x1e")),
    )
    names = [tuple(sorted({p[at] for p in lists if len(p) > at})) for at in range(depth)]
    return _run_plans(
        out.drop("_plan"), names, len(lists), iterations, seed, key, canonical, noisy, first_iteration, first_row, options
    )


def augment_grid_by_number(
    lines: DataFrame,
    steps: Sequence[str],
    most: int,
    iterations: int,
    seed: int = 42,
    ordered: bool = False,
    key: str = "line_id",
    canonical: str = CANONICAL,
    noisy: str = NOISY,
    partitions: int | None = None,
    first_iteration: int = 1,
    first_row: int = 0,
    options: StepOptions | None = None,
) -> DataFrame:
    """:func:`augment_grid` over every plan of one to ``most`` of the steps, made from its number in each row.

    A thousand plans or a million cost the plan of the job nothing: it names each step once a place.
    """
    total = plan_count(len(steps), most, ordered)
    source = lines.repartition(partitions, key) if partitions else lines
    numbered = source.select(
        "*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(total - 1).cast("long"))).alias("plan_no")
    )
    out = made_once(numbered, "steps_arr", plan_by_number(F.col("plan_no"), steps, most, ordered))
    names = [tuple(sorted(steps))] * most
    return _run_plans(
        out.withColumn("plan_no", F.col("plan_no").cast("int")), names, total, iterations, seed, key, canonical, noisy,
        first_iteration, first_row, options,
    )


def _run_plans(
    planned: DataFrame,
    names_at: Sequence[tuple[str, ...]],
    n_plans: int,
    iterations: int,
    seed: int,
    key: str,
    canonical: str,
    noisy: str,
    first_iteration: int,
    first_row: int,
    options: StepOptions | None,
) -> DataFrame:
    """Run the plan in ``steps_arr`` of each row, ``iterations`` times; ``names_at`` are the steps of each place."""
    last_iteration = first_iteration + iterations - 1
    out = (
        planned.select("*", F.explode(F.sequence(F.lit(first_iteration), F.lit(last_iteration))).alias("iteration"))
        .withColumn(
            "row_id",
            F.col(key) * F.lit(n_plans * iterations).cast("long")
            + F.col("plan_no") * iterations
            + (F.col("iteration") - first_iteration)
            + F.lit(first_row).cast("long"),
        )
        .withColumn(noisy, F.col(canonical).cast("string"))
    )
    built: dict[tuple[str, ...], Column] = {}
    for at, names in enumerate(names_at):
        if names not in built:
            built[names] = run_step(F.col("_step"), F.col(noisy), F.col("_base"), names, options)
        out = out.withColumns(
            {
                "_step": F.get("steps_arr", F.lit(at)),
                "_base": draws.base(seed, F.col(key), F.col("iteration"), F.lit(at)),
            }
        )
        out = made_once(out, noisy, built[names])
    for name, given in (options or {}).items():
        label = noise.step_label(name, **given)
        if label != name:
            out = out.withColumn("steps_arr", _renamed(F.col("steps_arr"), name, label))
    return (
        out.withColumn(f"{noisy}_malform_steps", steps_text(F.col("steps_arr")))
        .withColumn("n_steps", F.size("steps_arr"))
        .drop("_step", "_base")
    )
