"""Whole flows, sources and sinks."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smudgeline.config import MatchConfig
from smudgeline.functions.encoders import ngram_encoder
from smudgeline.operators.augment import CANONICAL, STEPS
from smudgeline.plans import build_noisy, match, registered
from smudgeline.session import scratch_path, stored
from smudgeline.sources import readers, writers


def test_build_and_match(spark, small):
    name, place = "flow_noisy", scratch_path(spark, "flow")
    lines = registered.lines(spark, small)
    added = build_noisy.build_noisy_table(spark, lines, name, place, "it's a test", iterations=1, sample=60)
    assert added == 60 * 13
    again = build_noisy.build_noisy_table(spark, lines, name, place, iterations=1, sample=60)
    assert again == added and spark.table(name).count() == 2 * added
    table = spark.table(name)
    assert table.select("row_id").distinct().count() == 2 * added
    texts = table.filter(F.col(STEPS) == ", add_random_text")
    assert texts.select("line_id", "malformed_first_line").distinct().count() == texts.count() == 120

    path = scratch_path(spark, "rows")
    build_noisy.noisy_rows(lines, iterations=2, sample=60).write.parquet(path)
    result = match.run(spark, MatchConfig(source_parquet=path, predictions_table="flow_predictions"))
    n_test = -(-60 * 13 * 2 // 10)
    assert result.records.count() == n_test and result.catalog.count() == 60
    assert 0.8 < result.accuracy <= result.top3_accuracy <= 1
    kept = result.negatives.groupBy("split").agg(F.count("*").alias("n"), F.max(F.size("hard_negatives")).alias("most"))
    assert {r.split: r.n for r in kept.collect()} == {"test": n_test, "train": 1560 - n_test}
    assert {r.split: r.most for r in kept.collect()} == {"test": 0, "train": 15}
    assert result.pairs.filter(F.size("input_ids") != 128).isEmpty()
    table = spark.table("flow_predictions")
    assert table.columns == [
        "noisy", "true_canonical", "predicted", "is_correct", "predicted_prefers_yes",
        "scores_json", "nll_yes_json", "nll_no_json", "jw_score",
    ]
    assert table.count() == n_test


def test_reading(spark, small):
    rows = registered.noisy(spark, small)
    name, path = "read_noisy", scratch_path(spark, "read")
    writers.create_noisy_table(spark, name, rows, scratch_path(spark, name))
    writers.append_noisy(rows, name)
    rows.write.parquet(path)
    for mode in ("none", "legacy_one_comma", "min_steps", "max_steps"):
        by_table = readers.read_lines(spark, MatchConfig(source_table=name, steps_filter=mode))
        by_path = readers.read_lines(spark, MatchConfig(source_parquet=path, steps_filter=mode))
        assert by_table.count() == by_path.count() > 0
    both = MatchConfig(source_table="no_such_table", source_parquet=path, max_rows=5)
    assert readers.read_lines(spark, both).count() == 5
    with pytest.raises(ValueError):
        readers.read_lines(spark, MatchConfig())
    with pytest.raises(ValueError):
        readers.read_lines(spark, MatchConfig(source_parquet=path, steps_filter="min_steps", steps_min=9))
    assert spark.table(name).select(STEPS).distinct().count() == 3


def test_failed_write_is_an_error(spark):
    with pytest.raises(Exception):
        writers.write_predictions(spark.range(1), "no_such_schema.predictions")


def test_grid_plan_is_narrow(spark, small):
    """The grid moves no rows: one spread of the small source, nothing else."""
    plan = build_noisy.noisy_rows(
        registered.lines(spark, small), iterations=2, sample=None
    )._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and "Python" not in plan


def test_filters_do_not_repeat_noise(spark, small):
    rows = registered.noisy(spark, small)
    plan = rows.filter("malformed_first_line != first_line")._jdf.queryExecution().executedPlan().toString()
    assert all("transform" not in line for line in plan.splitlines() if "Filter (" in line)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_flagship_by_brute_force(spark, small):
    """Shortlist, scores, blend and pick, recomputed without Spark from the same vectors."""
    asked = stored(registered.noisy_queries(spark, small), "asked")
    got = {r.steps: (r.n_rows, r.accuracy) for r in registered.flagship(spark, small).collect()}
    lines = registered.lines(spark, small).select(CANONICAL, ngram_encoder(registered.DIMS)(F.col(CANONICAL)).alias("vec"))
    cat = sorted(lines.distinct().collect())
    names, vecs = [r[0] for r in cat], np.array([r[1] for r in cat], float)
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    hits = {}
    for r in asked.withColumn("up", F.upper("noisy")).collect():
        q = np.array(r.vec, float)
        sims = np.round(vecs @ (q / (np.linalg.norm(q) or 1)), 9)
        order = sorted(range(len(names)), key=lambda i: (-sims[i], i))[:24]
        low, high = sims[order].min(), sims[order].max()
        best = None
        for place, i in enumerate(order):
            near = 1 - edits(r.up, names[i]) / max(len(r.up), len(names[i]), 1)
            p = max(min(near, 0.999999), 0.000001)
            score = -math.log(1 - p) + math.log(p) + 2 * (sims[i] - low) / max(high - low, 1e-8)
            if best is None or score > best[0] + 1e-9:
                best = (score, i)
        hits.setdefault(r.steps, []).append(names[best[1]] == r.truth)
    assert got == {k: (len(v), pytest.approx(sum(v) / len(v), abs=1.5 / len(v))) for k, v in hits.items()}


def test_worker_functions_travel_by_value():
    """Executors need not have the package: its functions are pickled whole."""
    from pyspark import cloudpickle

    assert "smudgeline" in cloudpickle.list_registry_pickle_by_value()
