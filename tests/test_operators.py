"""Edges of the operators, each against a small brute-force answer."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from smudgeline.functions import clean, lexicons, scoring, similarity, steps, tokens
from smudgeline.functions.encoders import ngram_encoder
from smudgeline.operators import (
    augment,
    catalog,
    neighbors,
    negatives,
    pairs,
    ranking,
    reports,
    skew,
    split,
)


def column(spark, values, kind="STRING"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i LONG, v {kind}")


def run(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


# --- steps -------------------------------------------------------------------

STEPS = [None, "", ", a", ", a, b", "a,,b", " , ", ", \t"]


def test_step_segments(spark):
    got = run(column(spark, STEPS), steps.step_segments(F.col("v")))
    assert got == [[], [], ["a"], ["a", "b"], ["a", "b"], [], []]


@pytest.mark.parametrize(
    "mode,low,high,kept",
    [
        ("none", 1, 1, [0, 1, 2, 3, 4, 5, 6]),
        ("legacy_one_comma", 1, 1, [2, 5, 6]),
        ("min_steps", 2, 1, [3, 4]),
        ("max_steps", 1, 1, [0, 1, 2, 5, 6]),
    ],
)
def test_filters_agree(spark, mode, low, high, kept):
    df = column(spark, STEPS)
    got = df.filter(steps.passes(F.col("v"), mode, low, high))
    where = steps.where_clause("v", mode, low, high) or "true"
    assert [r.i for r in got.orderBy("i").collect()] == kept
    assert [r.i for r in df.filter(where).orderBy("i").collect()] == kept


def test_unknown_mode():
    for fn in (lambda: steps.passes(F.lit(""), "odd"), lambda: steps.where_clause("s", "odd")):
        with pytest.raises(ValueError):
            fn()


# --- cleaning ----------------------------------------------------------------


MARKS = ["\u0300", "\u0307", "\u0327", "\u0338", "\u20dd\u0301"]


def test_strip_combining(spark):
    """Any letter or digit under any marks of nonzero class is left bare; marks of class 0 stay."""
    bare = [c for c in map(chr, range(0x30, 0x7B)) if c.isalnum()]
    marked = [c + m for c in bare for m in MARKS]
    df = column(spark, [None, "", *marked])
    kept = [c + "".join(x for x in m if x == "\u20dd") for c in bare for m in MARKS]
    assert run(df, clean.strip_combining(F.col("v"))) == [None, "", *kept]


@pytest.mark.parametrize("times", range(1, 7))
def test_squeeze_runs(spark, times):
    for c in ("x", "0", " ", "\n", ".", "$", "\u00e9", "\U0001d518"):
        df = column(spark, [f"p{c * times}q{c}{c}", c * times])
        assert run(df, clean.squeeze_runs(F.col("v"))) == [f"p{c * min(times, 2)}q{c}{c}", c * min(times, 2)]


def test_clean(spark):
    specials = "".join(lexicons.SEPARATORS).replace(" ", "")
    df = column(spark, [None, *[f"{c}l{c}{c}r{c}" for c in specials], "plain", "q\u0301" * 4 + specials + "z"])
    spaced = run(df, clean.specials_to_space(F.col("v")))
    assert spaced[0] is None and spaced[1:-2] == ["l r"] * len(specials) and spaced[-2] == "plain"
    assert run(df, clean.clean_line(F.col("v")))[-1] == "qq z"
    assert run(df, clean.clean_line(F.col("v"), specials=False))[-1] == "qq" + clean_runs(specials) + "z"
    assert run(df, clean.fraction_glyphs(F.lit("12 OAK 34"), {"12": "\u00bd"}))[0] == "\u00bd OAK 34"


def clean_runs(text):
    out = ""
    for c in text:
        if not out.endswith(c * 2):
            out += c
    return out


# --- similarity --------------------------------------------------------------


def plain_jw(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used, ha = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                ha.append(c)
                break
    m = len(ha)
    if not m:
        return 0.0
    hb = [c for c, u in zip(b, used) if u]
    t = sum(x != y for x, y in zip(ha, hb)) // 2
    j = (m / len(a) + m / len(b) + (m - t) / m) / 3
    p = 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + 0.1 * p * (1 - j) if j > 0.7 else j


def test_jaro_winkler(spark):
    rng = np.random.default_rng(5)
    texts = ["", "MARTHA", "MARHTA", "DIXON", "DICKSONX", "é𝔘b", "𝔘éb", "x" * 300]
    texts += ["".join(rng.choice(list("ABC 12"), rng.integers(0, 25))) for _ in range(200)]
    rows = [(i, a, texts[int(rng.integers(len(texts)))]) for i, a in enumerate(texts)]
    rows += [(900, None, "A"), (901, None, None), (902, "A", None)]
    df = spark.createDataFrame(rows, "i LONG, a STRING, b STRING")
    got = run(df, similarity.jaro_winkler(F.col("a"), F.col("b")))
    want = [plain_jw(a or "", b or "") for _, a, b in sorted(rows)]
    assert np.allclose(got, want, atol=1e-12)


def test_cosine_of_zero(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0], [1.0, 2.0])], "i LONG, a ARRAY<FLOAT>, b ARRAY<FLOAT>")
    assert run(df, similarity.cosine(F.col("a"), F.col("b"))) == [0.0]
    assert run(df, similarity.unit(F.col("b")))[0] == pytest.approx([1 / 5**0.5, 2 / 5**0.5])


def test_encoder(spark):
    df = column(spark, ["MAIN ST", "main st", "", None, "𝔘"])
    got = run(df, ngram_encoder(32)(F.col("v")))
    assert got[0] == got[1] and len(got[0]) == 32
    assert np.linalg.norm(got[0]) == pytest.approx(1, abs=1e-6)
    assert sum(got[2]) == 0 and sum(got[3]) == 0 and sum(map(abs, got[4])) > 0


# --- tokens and pairs --------------------------------------------------------


def test_tokens(spark):
    df = column(spark, ["ab", "", "é"])
    ids = tokens.byte_tokens(F.col("v"))
    assert run(df, ids) == [[100, 101, 1], [1], [198, 172, 1]]
    assert run(df, tokens.pad(ids, 5))[0] == [100, 101, 1, 0, 0]
    assert run(df, tokens.pad(ids, 2))[0] == [100, 1]
    assert run(df, tokens.mask(ids, 5))[0] == [1, 1, 1, 0, 0]
    assert run(df, tokens.mask(ids, 2))[0] == [1, 1]
    words = run(column(spark, ["a b  a"]), tokens.word_tokens(F.col("v")))[0]
    assert len(words) == 4 and words[0] == words[2] != words[1] and words[-1] == 1


def test_prompt(spark):
    df = column(spark, ["x"])
    assert run(df, tokens.rank_prompt(F.col("v"), F.lit("y"))) == ["match product:\ninput: x\ncandidate: y"]
    assert run(df, tokens.rank_prompt(F.col("v"), F.lit("y"), "{candidate}<{noisy}>{noisy}")) == ["y<x>x"]


def test_pairs(spark):
    df = spark.createDataFrame(
        [(1, "t", "n", ["p", "q"]), (2, "u", "o", None)],
        "row_id LONG, first_line STRING, malformed_first_line STRING, hard_negatives ARRAY<STRING>",
    )
    got = pairs.make_pairs(df).orderBy("row_id", "pos").collect()
    assert [(r.row_id, r.pos, r.target) for r in got] == [(1, 0, "yes"), (1, 1, "no"), (1, 2, "no"), (2, 0, "yes")]
    assert got[2].prompt.endswith("input: n\ncandidate: q")
    volume = pairs.pair_volume(df.withColumn("split", F.lit("train"))).first()
    assert (volume.n_rows, volume.n_pairs) == (2, 4)


def test_jaro_winkler_in_sql(spark):
    similarity.register_functions(spark)
    df = spark.createDataFrame([("MARTHA", "MARHTA"), ("abc", "abc"), (None, ""), (None, "x")], "a STRING, b STRING")
    df.createOrReplaceTempView("name_pairs")
    got = spark.sql("SELECT jaro_winkler(a, b) AS v FROM name_pairs").collect()
    assert [round(r.v, 4) for r in got] == [0.9611, 1.0, 1.0, 0.0]


def test_allowed_next(spark):
    seqs = spark.createDataFrame([([5, 6, 1],), ([5, 7, 1, 0],), ([5, 6, 8, 1],)], "ids ARRAY<INT>")
    ask = [(0, []), (1, [0]), (2, [0, 5]), (3, [5, 6]), (4, [5, 7]), (5, [9]), (6, [5, 7, 1])]
    df = spark.createDataFrame(ask, "i LONG, prefix ARRAY<INT>")
    got = {r.i: r.allowed for r in pairs.allowed_next(df, seqs).collect()}
    assert got == {0: [5], 1: [5], 2: [6, 7], 3: [1, 8], 4: [1], 5: [1], 6: [1]}
    odd = spark.createDataFrame([(7, None), (8, [5] * 300)], "i LONG, prefix ARRAY<INT>")
    assert {r.i: r.allowed for r in pairs.allowed_next(odd, seqs).collect()} == {7: [1], 8: [1]}
    none = pairs.allowed_next(df.limit(0), seqs)
    assert none.columns == ["i", "prefix", "allowed"] and none.isEmpty()


def test_merge_tables(spark):
    first = spark.createDataFrame([("a", 9), ("b", 1), (None, 4)], "k STRING, v INT")
    later = spark.createDataFrame([("a", 2), ("a", 3), ("c", 5), (None, 0)], "k STRING, v INT")
    got = {r.k: r.v for r in lexicons.merge_tables(first, later, "k").collect()}
    assert got == {"a": 3, "b": 1, "c": 5, None: 0}


def test_step_options(spark):
    lines = spark.createDataFrame([(1, "12 OAK ST", "X")], "line_id LONG, first_line STRING, st STRING")
    name = "randomly_remove_vowels"
    options = {name: {"legacy_label": True}, "randomly_replace_spaces": {"substitutes": ["_"]}}
    grid = augment.augment_grid(
        lines, [[name], ["randomly_replace_spaces", name]], 3, options=options
    ).collect()
    assert {r[augment.STEPS] for r in grid} == {
        ", randomly_replace_vowels", ", randomly_replace_spaces, randomly_replace_vowels"
    }
    assert {c for r in grid for c in r[augment.NOISY]} <= set("12 OAKST_")
    assert any("_" in r[augment.NOISY] for r in grid)
    one = augment.apply_steps(
        augment.add_working_column(lines), [name, "randomly_replace_spaces"], options=options
    ).first()
    assert one[augment.STEPS] == ", randomly_replace_vowels, randomly_replace_spaces"


# --- split, catalog, skew ----------------------------------------------------


@pytest.mark.parametrize("share", [0.0, 0.1, 0.333, 1.0])
def test_exact_split(spark, share):
    df = spark.range(1003).withColumnRenamed("id", "row_id")
    sets = []
    for parts in (1, 8, 64):
        out = split.exact_split(df.repartition(parts), share, 7)
        sets.append({r.row_id for r in out.filter("split = 'test'").collect()})
    assert len(sets[0]) == math.ceil(share * 1003) and sets[0] == sets[1] == sets[2]
    if share == 0.1:
        other = split.exact_split(df, share, 8).filter("split = 'test'")
        assert {r.row_id for r in other.collect()} != sets[0]


def test_cut_inside_one_draw(spark):
    df = spark.range(50).withColumnRenamed("id", "row_id")
    same = F.lit(123456789).cast("long")
    assert split.smallest_cut(df, same, "row_id", 13) == (123456789, 12)


def test_catalog_in_stretches(spark):
    names = [f"{c}{i}é" for c in "bca" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in names * 2] + [(None,)], "first_line STRING")
    want = {n: i for i, n in enumerate(sorted(names))}
    for rows in (1_000_000, 50):
        got = {r.canonical: r.cat_id for r in catalog.distinct_catalog(df, rows_per_stretch=rows).collect()}
        assert got == want
    assert catalog.distinct_catalog(df.limit(0)).isEmpty()
    looked = catalog.catalog_lookup(
        spark.createDataFrame([(1, "a1é"), (2, "zz")], "row_id LONG, first_line STRING"),
        catalog.distinct_catalog(df),
    )
    assert {r.row_id: r.cat_id for r in looked.collect()} == {1: want["a1é"], 2: None}


def hot_rows(spark):
    """A third of the rows share one key."""
    rows = [(i, "hot" if i % 3 == 0 else f"k{i % 40}", f"n{i}") for i in range(900)]
    rows += [(1000, None, "x"), (1001, "hot", None)]
    return spark.createDataFrame(rows, "row_id LONG, first_line STRING, malformed_first_line STRING")


def test_skew_join(spark):
    facts = hot_rows(spark)
    dim = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "first_line STRING, d INT")
    for how in ("left", "inner"):
        want = sorted(map(str, facts.join(dim, "first_line", how).select("row_id", "d").collect()))
        for n in (10_000, 20):
            got = skew.skew_join(facts, dim, "first_line", how, rows_per_split=n)
            assert sorted(map(str, got.select("row_id", "d").collect())) == want


def test_grouping_of_a_hot_line(spark):
    facts = hot_rows(spark)
    want = {}
    for r in facts.orderBy("row_id").collect():
        if r[1] is not None and r[2] is not None:
            want.setdefault(r[1], []).append(r[2])
    got = {}
    for r in catalog.group_noisy(facts, per_list=70).orderBy("canonical", "part").collect():
        assert len(r.noisy_list) <= 70
        got.setdefault(r.canonical, []).extend(r.noisy_list)
    assert got == want
    ranked = skew.place_in_group(catalog.keep_known(facts, "first_line"), "first_line", "row_id", "at", span=100)
    by_key = {}
    for r in ranked.orderBy("row_id").collect():
        by_key.setdefault(r.first_line, []).append(r["at"])
    assert all(v == list(range(1, len(v) + 1)) for v in by_key.values())
    firsts = catalog.first_variants(facts, 3)
    for r in firsts.collect():
        assert want[r.canonical][r.variant - 1] == r.noisy and r.variant <= 3


# --- neighbours --------------------------------------------------------------


def brute(queries, lines, k):
    def unit(v):
        n = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(n == 0, 1, n)

    sims = np.round(unit(queries) @ unit(lines).T, 9)
    k = max(1, min(k, len(lines)))
    return {
        (q, c, at + 1)
        for q in range(len(queries))
        for at, c in enumerate(sorted(range(len(lines)), key=lambda c: (-sims[q, c], c))[:k])
    }


@pytest.mark.parametrize("options", [{}, {"chunk_rows": 30}, {"chunk_rows": 15, "cell_rows": 20}])
@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_is_exact(spark, options, clustered):
    rng = np.random.default_rng(1)
    lines = rng.normal(size=(240, 8))
    if clustered:
        lines = np.repeat(rng.normal(size=(8, 8)), 30, axis=0) + rng.normal(size=(240, 8)) * 0.05
    lines[7] = 0
    lines[100:180] = lines[5]  # a third of the catalog are copies of one line
    queries = np.vstack([lines[:40] + rng.normal(size=(40, 8)) * 0.01, np.zeros((1, 8)), lines[5:6]])
    lines, queries = lines.astype(np.float32), queries.astype(np.float32)
    left = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(queries)], "query_id LONG, vec ARRAY<FLOAT>"
    )
    right = spark.createDataFrame(
        [(i, v.tolist()) for i, v in enumerate(lines)], "cat_id LONG, vec ARRAY<FLOAT>"
    )
    got = neighbors.nearest(left, right, 6, **options).collect()
    want = brute(queries.astype(float), lines.astype(float), 6)
    assert {(r.query_id, r.cat_id, r.place) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("taken", [0, 3, 8, 20])
def test_top_pairs_against_all_cosines(taken):
    """The filter by short coordinates never loses a line, and scores few where vectors differ little."""
    rng = np.random.default_rng(6)
    both = neighbors._unit(rng.normal(size=(3000, 20)) * 0.7 ** np.arange(20), False)
    queries, lines = both[:1100], both
    axes = np.linalg.svd(both, full_matrices=False)[2][:taken].T if taken else None
    floor = np.full(len(queries), -np.inf)
    floor[5] = 2.0  # nothing reaches it
    rows, cols, sims, scored = neighbors.top_pairs(queries, lines, 7, axes, floor)
    cosines = np.round(queries @ lines.T, 9)
    for q in range(0, 1100, 50):
        want = sorted(range(3000), key=lambda c: (-cosines[q, c], c))[:7]
        assert cols[rows == q].tolist() == want and sims[rows == q].tolist() == cosines[q, want].tolist()
    assert not (rows == 5).any()
    if taken != 3:
        assert scored < 0.1 * cosines.size


def test_search_by_cells_reports_its_visits(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(12, 6))
    vecs = (np.repeat(centers, 50, axis=0) + rng.normal(size=(600, 6)) * 0.02).astype(np.float32)
    df = spark.createDataFrame([(i, f"L{i}", v.tolist()) for i, v in enumerate(vecs)], "cat_id LONG, canonical STRING, vec ARRAY<FLOAT>")
    visits: list = []
    got = neighbors.nearest_lines(df, 5, chunk_rows=50, cell_rows=25, visits=visits).collect()
    assert {(r.cat_id, r.near_id, r.place) for r in got} == brute(vecs.astype(float), vecs.astype(float), 5)
    assert [v["round"] for v in visits] == list(range(len(visits))) and visits[0]["cells"] == 600
    assert sum(v["pairs"] for v in visits) < 0.5 * visits[0]["of_pairs"]
    none = df.select(F.col("cat_id").alias("query_id"), "vec").limit(0)
    assert neighbors.nearest(none, df, 3, chunk_rows=50, cell_rows=25).count() == 0


def test_k_is_held_to_the_catalog(spark):
    df = spark.createDataFrame([(0, "a", [1.0, 0.0]), (1, "b", [0.0, 1.0])], "cat_id LONG, canonical STRING, vec ARRAY<FLOAT>")
    assert neighbors.nearest_lines(df, 10).count() == 4
    assert neighbors.nearest_lines(df, 0).count() == 2


def test_hard_negatives_by_hand(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(12, 4)).astype(np.float32)
    cat = spark.createDataFrame(
        [(i, f"L{i:02d}", v.tolist()) for i, v in enumerate(vecs)], "cat_id LONG, canonical STRING, vec ARRAY<FLOAT>"
    )
    rows = [(j, f"L{(j * j) % 11:02d}" if j % 9 else "gone", f"n{j}") for j in range(60)]
    train = spark.createDataFrame(rows, "row_id LONG, first_line STRING, malformed_first_line STRING")
    multimap = {}
    for _, c, n in rows:
        multimap.setdefault(c, []).append(n)
    near = {}
    for q, c, at in sorted(brute(vecs.astype(float), vecs.astype(float), 5), key=lambda t: (t[0], t[2])):
        near.setdefault(q, []).append(c)
    for limit in (1_000_000, 5):
        got = negatives.mine_hard_negatives(train, cat, 5, 2, 6, rows_per_split=limit).collect()
        assert len(got) == 60
        for r in got:
            want = []
            if r.first_line != "gone":
                for c in near[int(r.first_line[1:])]:
                    if c != int(r.first_line[1:]):
                        want += multimap.get(f"L{c:02d}", [])[:2]
            assert r.hard_negatives == want[:6], r


# --- ranking -----------------------------------------------------------------


def cand_rows(spark, rows):
    return spark.createDataFrame(
        rows, "query_id LONG, noisy STRING, truth STRING, cat_id LONG, candidate STRING, cosine DOUBLE, place INT"
    )


def test_inject_truth(spark):
    cat = spark.createDataFrame(
        [(i, c, [float(i), 1.0]) for i, c in enumerate("abcd")], "cat_id LONG, canonical STRING, vec ARRAY<FLOAT>"
    )
    rows = [
        (1, "x", "b", 0, "a", 0.9, 1), (1, "x", "b", 1, "b", 0.8, 2),
        (2, "y", "d", 0, "a", 0.9, 1), (2, "y", "d", 2, "c", 0.8, 2),
        (3, "z", "unknown", 0, "a", 0.7, 1), (3, "z", "unknown", 1, "b", 0.6, 2),
    ]
    vecs = spark.createDataFrame([(i, [1.0, 0.0]) for i in (1, 2, 3)], "query_id LONG, vec ARRAY<FLOAT>")
    out = ranking.inject_truth(cand_rows(spark, rows), cat, 2, vecs)
    got = {q: [] for q in (1, 2, 3)}
    for r in out.orderBy("query_id", "place").collect():
        got[r.query_id].append((r.candidate, r.place, r.was_injected))
        if r.was_injected:
            assert r.cosine == pytest.approx(3 / 10**0.5, abs=1e-8)
    assert got == {
        1: [("a", 1, False), ("b", 2, False)],
        2: [("d", 1, True), ("a", 2, False)],
        3: [("a", 1, False), ("b", 2, False)],
    }
    one = ranking.inject_truth(cand_rows(spark, rows).filter("place = 1"), cat, 1, vecs)
    assert {(r.query_id, r.candidate) for r in one.collect()} == {(1, "b"), (2, "d"), (3, "a")}


def test_norm_floor_and_ties(spark):
    rows = [(1, "x", "b", 0, "a", 0.5, 1), (2, "y", "b", 0, "a", 0.5, 1), (2, "y", "b", 1, "b", 0.5, 2)]
    normed = ranking.minmax_norm(cand_rows(spark, rows))
    assert {r.cosine_norm for r in normed.collect()} == {0.0}
    scored = cand_rows(spark, rows).withColumn("nll_yes", F.lit(1.0)).withColumn("nll_no", F.lit(1.0))
    best = ranking.pick_best(ranking.add_pick_scores(scored)).orderBy("query_id").collect()
    assert [r.predicted for r in best] == ["a", "a"] and not any(r.predicted_prefers_yes for r in best)


def test_failed_scores(spark):
    rows = [(1, "x", "b", 0, "a", 0.9, 1), (1, "x", "b", 1, "b", 0.8, 2)]

    def scorer(df):
        failed = F.when(F.col("candidate") == "b", F.lit(2.0))
        return df.withColumn("nll_yes", failed).withColumn("nll_no", failed + 1)

    scored = ranking.add_pick_scores(ranking.score_pairs(cand_rows(spark, rows), scorer)).withColumn("scored", F.lit(True))
    assert {r.candidate: r.label for r in scored.collect()} == {"a": "", "b": "yes"}
    record = ranking.evaluation_records(scored, " Encoder_Margin_Blend ", 2).first()
    assert record.predicted == "b" and record.nll_yes["a"] == math.inf and record.is_correct
    assert record.eval_pick_policy == "encoder_margin_blend" and list(record.shortlist) == ["a", "b"]


def test_policies():
    with pytest.raises(ValueError):
        scoring.policy_name("best")


def test_accuracies(spark):
    empty = spark.createDataFrame([], "is_correct BOOLEAN")
    assert reports.top1_accuracy(empty).first().accuracy == 0.0
    two = spark.createDataFrame([(True,), (None,)], "is_correct BOOLEAN")
    assert reports.top1_accuracy(two).first().accuracy == 0.5
    asked = spark.createDataFrame([(1,), (2,), (3,)], "query_id LONG")
    rows = cand_rows(
        spark,
        [(1, "", "c", 0, "a", 0.0, 1), (1, "", "c", 1, "b", 0.0, 2), (1, "", "c", 2, "c", 0.0, 3),
         (2, "", "a", 0, "a", 0.0, 1), (2, "", "a", 1, "b", 0.0, 2)],
    )
    scores = F.when(F.col("candidate") == "c", 5.0).when(F.col("query_id") == 2, None).otherwise(1.0)
    ranked = rows.withColumn("pick_score", scores).withColumn("nll_yes", F.lit(None).cast("double"))
    assert reports.topk_accuracy(asked, ranked, 1).first().accuracy == pytest.approx(2 / 3)
    assert reports.topk_accuracy(asked, ranked, 1, by_pick_score=False).first().accuracy == pytest.approx(1 / 3)
    assert reports.topk_accuracy(asked.limit(0), ranked.limit(0), 1).first().accuracy == 0.0
    labelled = rows.withColumn("label", F.when(F.col("candidate") == "a", "no").otherwise("yes"))
    assert reports.topk_accuracy_legacy(asked, labelled, 2).first().accuracy == pytest.approx(1 / 3)
    legacy = ranking.score_legacy(asked.withColumn("truth", F.lit("b")), labelled).orderBy("query_id").collect()
    assert [(r.predicted, r.is_correct) for r in legacy] == [("b", True), ("b", True), (None, False)]


def test_flat_records_hold_no_null(spark):
    record = spark.createDataFrame(
        [(1, None, "t", None, None, True, None, None, None, None, None, None, "p", None, None, None)],
        "query_id LONG, noisy STRING, true STRING, predicted STRING, predicted_prefers_yes BOOLEAN, is_correct BOOLEAN, "
        "scores MAP<STRING,STRING>, nll_yes MAP<STRING,DOUBLE>, nll_no MAP<STRING,DOUBLE>, margins MAP<STRING,DOUBLE>, "
        "pick_scores MAP<STRING,DOUBLE>, encoder_cosine MAP<STRING,DOUBLE>, eval_pick_policy STRING, "
        "eval_ranker_max_encoder_rank INT, ranker_pool ARRAY<STRING>, shortlist ARRAY<STRING>",
    )
    row = reports.to_flat_records(record).first().asDict()
    assert None not in row.values() and row["shortlist_json"] == "[]" and row["scores_json"] == "{}"
    assert row["predicted_prefers_yes"] is False and row["eval_ranker_max_encoder_rank"] == 0


def test_join_predictions_fans_out(spark):
    rows = hot_rows(spark).limit(3)
    twice = spark.createDataFrame([("n0", "p"), ("n0", "q")], "malformed_first_line STRING, predicted STRING")
    assert reports.join_predictions(rows, twice).count() == 4


def test_failed_scores_never_win(spark):
    inf, nan = float("inf"), float("nan")
    costs = [(inf, inf), (nan, 1.0), (None, 1.0), (1.0, nan), (3.0, 1.0)]
    rows = [(1, "n", "t", f"c{k}", k + 1, 0.9 - k / 10, a, b) for k, (a, b) in enumerate(costs)]
    cands = spark.createDataFrame(
        rows, "query_id int, noisy string, truth string, candidate string, place int, cosine double, "
        "nll_yes double, nll_no double",
    )
    for policy in ("min_nll_yes", "max_yes_no_margin", "encoder_margin_blend"):
        scored = ranking.add_pick_scores(cands, policy)
        assert ranking.pick_best(scored).first()["predicted"] == "c4"
        truth = scored.withColumn("truth", F.lit("c4"))
        assert reports.topk_accuracy(truth, truth, 1).first()["accuracy"] == 1.0
    labels = cands.select(scoring.yes_no_label(F.col("nll_yes"), F.col("nll_no")).alias("l")).collect()
    assert [r["l"] for r in labels] == ["", "", "", "", "no"]
    with pytest.raises(ValueError):
        ranking.evaluate_ranking(cands, cands, cands, scoring.edit_scorer())


def test_shared_folder_is_asked_for():
    from types import SimpleNamespace

    from smudgeline.session import scratch_root

    context = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=context)
    with pytest.raises(ValueError):
        scratch_root(cluster)
