"""Orders of reports, cuts without a sort, failed scores, hot keys handed in, scratch folders, counted label costs."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from smudgeline.functions import scoring, tokens
from smudgeline.operators import augment, backoff, ranking, reports, skew, split
from smudgeline.operators.augment import CANONICAL, NOISY, STEPS
from smudgeline.session import clear_made, made_folders, stored

# --- orders ------------------------------------------------------------------


@pytest.fixture(scope="module")
def report(spark):
    rng = random.Random(4)
    rows = []
    for k in range(200):
        steps = rng.choice([", a", ", b", ", a, b", ", c"])
        canonical = f"L{rng.randrange(9)}"
        rows.append((k, canonical, canonical + rng.choice(["", "x", "yy"]), steps, rng.choice([None, canonical]), canonical, rng.choice([0.2, 0.5, 1.0])))
    names = f"row_id LONG, {CANONICAL} STRING, {NOISY} STRING, {STEPS} STRING, predicted STRING, reference STRING, jw_score DOUBLE"
    return spark.createDataFrame(rows, names).repartition(7)


def test_reports_come_in_their_order(report):
    by_count = [tuple(r) for r in reports.step_distribution(report).collect()]
    assert by_count == sorted(by_count, key=lambda r: (-r[1], r[0])) and len(by_count) == 4
    lines = [tuple(r) for r in reports.line_distribution(report).collect()]
    assert lines == sorted(lines, key=lambda r: (-r[1], r[0])) and len(lines) == 9
    names = [r[0] for r in reports.line_distribution(report, by_name=True).collect()]
    assert names == sorted(names)
    means = [tuple(r) for r in reports.jw_by_steps(report).collect()]
    assert means == sorted(means, key=lambda r: (-r[1], r[0]))
    worst = [(r["jw_score"], r[CANONICAL], r[NOISY]) for r in reports.worst_examples(report, ", a").collect()]
    assert worst == sorted(worst) and worst


# --- cuts --------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 7, 499, 500, 900])
def test_first_rows_by_a_cut(spark, n):
    rng = random.Random(n)
    rows = [(k, rng.choice([rng.randrange(5), rng.randrange(2**31), rng.randrange(2**45)])) for k in range(500)]
    df = spark.createDataFrame(rows, "k LONG, draw LONG").repartition(5)
    got = sorted((r["draw"], r["k"]) for r in split.first_by(df, F.col("draw"), "k", n).collect())
    assert got == sorted((d, k) for k, d in rows)[:n]


def test_large_samples_and_limits_are_filters(spark, monkeypatch):
    lines = spark.createDataFrame([(k, f"L{k}") for k in range(300)], "line_id LONG, first_line STRING").repartition(4)
    want = {r["line_id"] for r in augment.sample_lines(lines, 40).collect()}
    first = {r["line_id"] for r in ranking.limit_eval(lines, 40, "line_id").collect()}
    monkeypatch.setattr(augment, "SORTED_ROWS", 10)
    monkeypatch.setattr(ranking, "SORTED_ROWS", 10)
    sample = augment.sample_lines(lines, 40)
    assert {r["line_id"] for r in sample.collect()} == want and len(want) == 40
    assert {r["line_id"] for r in ranking.limit_eval(lines, 40, "line_id").collect()} == first == set(range(40))
    assert "Sort" not in sample._jdf.queryExecution().executedPlan().toString()


# --- failed scores -----------------------------------------------------------


@pytest.mark.parametrize("policy", scoring.POLICIES)
def test_failed_candidates_come_last(spark, policy):
    inf, nan = math.inf, math.nan
    rows = [
        (1, 1, inf, inf), (1, 2, inf, 1.0),  # a cost without end still beats a failure
        (2, 1, None, 1.0), (2, 2, inf, 2.0), (2, 3, nan, 0.5), (3, 1, inf, inf), (3, 2, nan, nan), (4, 1, 3.0, 1.0), (4, 2, inf, 9.0),
    ]
    df = spark.createDataFrame([(q, p, f"c{p}", "n", "c2", 0.5, y, n) for q, p, y, n in rows],
                               "query_id INT, place INT, candidate STRING, noisy STRING, truth STRING, cosine DOUBLE, nll_yes DOUBLE, nll_no DOUBLE")
    best = {r["query_id"]: r for r in ranking.pick_best(ranking.add_pick_scores(df, policy)).collect()}
    assert [best[q]["predicted"] for q in (1, 2, 3, 4)] == ["c2", "c2", "c1", "c1"]
    assert best[1]["is_correct"] and not best[3]["predicted_prefers_yes"]


# --- joins -------------------------------------------------------------------


def test_hot_keys_may_be_handed_in(spark):
    facts = spark.createDataFrame([(k, "hot" if k % 2 else f"k{k % 7}") for k in range(100)], "row_id LONG, key STRING")
    dim = spark.createDataFrame([("hot", 1), ("k0", 2), ("k9", 3)], "key STRING, v INT")
    hot = spark.createDataFrame([("hot", 4)], "key STRING, _splits INT")
    known = {r["key"]: r["v"] for r in dim.collect()}
    for given in (hot, hot.limit(0), None):
        got = skew.skew_join(facts, dim, "key", "left", "row_id", hot=given).collect()
        assert len(got) == 100 and all(r["v"] == known.get(r["key"]) for r in got)


# --- scratch folders ---------------------------------------------------------


def test_made_folders_are_cleared(spark):
    before = len(made_folders(spark))
    stored(spark.range(3), "kept")
    at = len(made_folders(spark))
    frames = [stored(spark.range(5), "gone") for _ in range(2)]
    assert [f.count() for f in frames] == [5, 5]
    paths = made_folders(spark)[before:]
    assert clear_made(spark, at) == 2
    assert [os.path.exists(p.removeprefix("file:")) for p in paths] == [True, False, False]
    assert len(made_folders(spark)) == at


# --- counted label costs -----------------------------------------------------


def plain_costs(pairs, prompt, label, context):
    """Back-off by hand over characters; the end of a label is None."""
    counts: dict = {}
    for p, t in pairs:
        for at in range(len(t) + 1):
            before = (p + t[:at])[-context:] if context else ""
            for c in range(len(before) + 1):
                key = before[len(before) - c :]
                following = counts.setdefault(key, {})
                nxt = t[at] if at < len(t) else None
                following[nxt] = following.get(nxt, 0) + 1
    total = 0.0
    for at in range(len(label) + 1):
        before = (prompt + label[:at])[-context:] if context else ""
        nxt = label[at] if at < len(label) else None
        for c in range(len(before), -1, -1):
            seen = counts.get(before[len(before) - c :], {})
            if nxt in seen:
                total -= math.log(seen[nxt] / sum(seen.values()) * backoff.KEPT ** (context - c))
                break
        else:
            total -= math.log(backoff.KEPT ** (context + 1) / backoff.VOCABULARY)
    return total


@pytest.mark.parametrize("context", [0, 2, 5])
def test_label_costs_by_hand(spark, context):
    rng = random.Random(context)
    pairs = [("".join(rng.choice("ab") for _ in range(rng.randrange(7))), rng.choice(["yes", "yes", "no"])) for _ in range(60)]
    df = spark.createDataFrame([*pairs, (None, "yes"), ("ab", None)], "prompt STRING, target STRING").repartition(3)
    model = backoff.count_labels(df, context=context)
    asked = sorted({p for p, _ in pairs}) + ["zzz", "abz", "", None]
    rows = spark.createDataFrame([(k, p) for k, p in enumerate(asked)], "i LONG, prompt STRING").repartition(2)
    got = backoff.backoff_scorer(model, context=context)(rows).collect()
    assert len(got) == len(asked)
    for r in got:
        if r["prompt"] is None:
            assert r["nll_yes"] is None and r["nll_no"] is None
        else:
            for label in ("yes", "no"):
                assert r[f"nll_{label}"] == pytest.approx(plain_costs(pairs, r["prompt"], label, context), abs=1e-9)


def test_label_costs_as_a_scorer(spark):
    train = spark.createDataFrame([("x: good", "yes"), ("x: bad", "no")] * 5, "prompt STRING, target STRING")
    model = backoff.count_labels(train)
    cands = spark.createDataFrame([(1, "n", "t", 1, "good", 0.5, 1), (1, "n", "t", 2, "bad", 0.5, 2)],
                                  "query_id LONG, noisy STRING, truth STRING, cat_id LONG, candidate STRING, cosine DOUBLE, place INT")
    scored = {r["candidate"]: r["label"] for r in ranking.score_pairs(cands, backoff.backoff_scorer(model)).collect()}
    assert scored == {"good": "yes", "bad": "no"}
    assert tokens.EOS != tokens.PAD
