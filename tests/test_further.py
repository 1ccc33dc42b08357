"""SQL functions, numbered plans, whole-catalog scoring, batches, tries, pooling and joins that repeat on both sides."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from smudgeline.functions import draws, noise, sql
from smudgeline.functions.tokens import EOS, PAD
from smudgeline.operators import augment, pooling, ranking, skew, trie
from smudgeline.sources import batches

ODD = [(0, None), (1, ""), (2, "A"), (3, "12345"), (4, "NOSPACES"), (5, "1 N O'MAIN ST NW"), (6, "112TH AND 12TH \\ 'x'"), (7, "É½ ROAD")]


@pytest.mark.parametrize("name", list(noise.STEPS))
def test_noise_in_sql_on_odd_lines(spark, name):
    lines = spark.createDataFrame(ODD, "line_id LONG, t STRING")
    lines.createOrReplaceTempView("odd_lines")
    sql.register_noise(spark, [name])
    sql.register_helpers(spark)
    got = spark.sql(f"SELECT line_id, {name}(t, noise_base(5, CAST(line_id AS STRING), 2, 1)) AS r FROM odd_lines ORDER BY 1")
    base = draws.base(5, F.col("line_id"), F.lit(2), F.lit(1))
    want = lines.select("line_id", noise.STEPS[name](F.col("t"), base).alias("r")).orderBy("line_id")
    assert got.collect() == want.collect()


def test_noise_in_sql_with_options(spark):
    sql.register_noise(spark, ["randomly_remove_vowels"], {"randomly_remove_vowels": {"legacy_label": True}})
    assert spark.sql("SELECT randomly_remove_vowels('ABE', 7L).step").first()[0] == "randomly_replace_vowels"
    sql.register_noise(spark, ["randomly_remove_vowels"])


def test_quotes_and_operators_in_sql_text(spark):
    made = F.when(F.col("text") == "a'b+(", F.lit("and(")).otherwise(F.concat(F.col("text"), F.lit("\\'=(")))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION odd_text(text STRING) RETURNS STRING RETURN {sql.sql_text(made)}")
    rows = spark.createDataFrame([("a'b+(",), ("z",)], "t STRING")
    rows.createOrReplaceTempView("odd_texts")
    assert [r[0] for r in spark.sql("SELECT odd_text(t) FROM odd_texts").collect()] == ["and(", "z\\'=("]


# --- plans by number ---------------------------------------------------------


@pytest.mark.parametrize(("n", "most", "ordered"), [(1, 1, False), (5, 5, False), (6, 3, False), (5, 3, True), (4, 4, True), (3, 5, False)])
def test_numbered_plans_against_all_selections(spark, n, most, ordered):
    steps = [f"step{k}" for k in range(n)]
    want = [p for k in range(1, most + 1) for p in augment.plan_lists(steps, k, ordered)]
    got = augment.numbered_plans(spark, steps, most, ordered).orderBy("plan_no").collect()
    assert [r["steps_arr"] for r in got] == want
    assert [r["plan_no"] for r in got] == list(range(len(want))) and augment.plan_count(n, most, ordered) == len(want)


def test_numbers_without_a_plan(spark):
    rows = spark.createDataFrame([(-1,), (3,), (None,), (0,)], "n LONG")
    got = rows.select(augment.plan_by_number(F.col("n"), ["a", "b"], 2).alias("p")).collect()
    assert [r["p"] for r in got] == [None, None, None, ["a"]]


def test_grid_by_number_equals_grid_by_list(spark):
    lines = spark.createDataFrame([(k, f"{k} NORTH OAK ST") for k in range(20)], "line_id LONG, first_line STRING")
    steps = ["change_case", "randomly_remove_vowels", "randomly_replace_spaces"]
    plans = [p for k in (1, 2, 3) for p in augment.plan_lists(steps, k)]
    by_list = augment.augment_grid(lines, plans, 2)
    by_number = augment.augment_grid_by_number(lines, steps, 3, 2)
    columns = ["row_id", "plan_no", "iteration", "steps_arr", "n_steps", augment.NOISY, augment.STEPS]
    assert by_list.select(columns).dtypes == by_number.select(columns).dtypes
    assert sorted(map(str, by_list.select(columns).collect())) == sorted(map(str, by_number.select(columns).collect()))


# --- the whole catalog -------------------------------------------------------


def test_whole_catalog_stops_early(spark):
    catalog = spark.createDataFrame([(k, f"L{k:03d}") for k in range(300)], "cat_id LONG, canonical STRING")
    # query q is answered by line 3 q and all after it; the last ones by none
    queries = spark.createDataFrame([(q, f"n{q}", f"L{3 * q:03d}" if q % 2 else "gone") for q in range(120)], "query_id LONG, noisy STRING, truth STRING")

    def scorer(df):
        yes = F.when(F.col("cat_id") >= 3 * F.col("query_id"), 0.1).otherwise(2.0)
        return df.withColumn("nll_yes", yes).withColumn("nll_no", F.lit(1.0))

    rounds: list = []
    got = ranking.score_legacy_whole(queries, catalog, scorer, block_lines=10, block_queries=16, rounds=rounds).collect()
    for r in got:
        found = f"L{3 * r['query_id']:03d}" if 3 * r["query_id"] < 300 else None
        assert r["predicted"] == found and r["is_correct"] == (found is not None and r["query_id"] % 2 == 1)
    assert len(got) == 120 and sum(x["pairs"] for x in rounds) < 0.8 * 120 * 300
    assert [x["blocks"] for x in rounds] == [1, 2, 4, 8, 15]
    assert [x["queries"] for x in rounds] == sorted((x["queries"] for x in rounds), reverse=True)
    none = ranking.score_legacy_whole(queries, catalog.limit(0), scorer).collect()
    assert len(none) == 120 and all(r["predicted"] is None and r["is_correct"] is False for r in none)
    assert ranking.score_legacy_whole(queries.limit(0), catalog, scorer).count() == 0


# --- batches -----------------------------------------------------------------


def test_batches_are_seen_once_and_whole(spark, tmp_path):
    place = str(tmp_path)
    rows = spark.createDataFrame([(k, f"t{k}", f"s{k % 3}") for k in range(30)], "row_id LONG, text STRING, st STRING")
    with pytest.raises(ValueError, match="no batch"):
        batches.read_batches(spark, place)
    broken = batches.write_attempt(rows, place)
    with pytest.raises(ValueError, match="no batch"):
        batches.read_batches(spark, place)
    assert batches.append_batch(rows.filter("row_id < 10"), place, "a")
    assert not batches.append_batch(rows.filter("row_id < 10"), place, "a")
    assert batches.append_batch(rows.filter("row_id >= 10"), place, "b")
    assert sorted(map(tuple, batches.read_batches(spark, place).select(rows.columns).collect())) == sorted(map(tuple, rows.collect()))
    assert batches.read_batches(spark, place, ["a"]).count() == 10
    assert batches.read_batches(spark, place, ["none"]).count() == 0
    assert batches.broken_attempts(spark, place) == [broken]


def test_two_tries_that_race_count_once(spark, tmp_path):
    place = str(tmp_path)
    rows = spark.createDataFrame([(1, "x", "s")], "row_id LONG, text STRING, st STRING")
    tries = [batches.write_attempt(rows, place) for _ in range(2)]
    for t in tries:
        batches.commit(spark, place, "a", t, rows)
    assert batches.committed(spark, place) == {"a": min(tries)}
    assert batches.read_batches(spark, place).count() == 1
    assert batches.broken_attempts(spark, place) == [max(tries)]


# --- tries -------------------------------------------------------------------


def test_trie_by_hand(spark, tmp_path):
    place = str(tmp_path / "trie")
    lines = [[5, 6, 7], [5, 6], [5, 8], [], None, [5, 6, 7], [PAD, 9, EOS, PAD]]
    df = spark.createDataFrame([(v,) for v in lines], "ids ARRAY<INT>")
    assert trie.extend(df.limit(3), place, "one") and trie.extend(df, place, "two") and not trie.extend(df, place, "two")
    made = trie.read(spark, place)
    bare = [[t for t in v if t not in (PAD, EOS)] + [EOS] for v in lines if v is not None]
    follow: dict = {}
    for v in bare:
        for k in range(len(v)):
            follow.setdefault(tuple(v[:k]), set()).add(v[k])
    assert made.count() == sum(map(len, follow.values())) == made.distinct().count()
    counts = {r["length"]: (r["n_nodes"], r["n_edges"]) for r in trie.nodes(made).collect()}
    for length in counts:
        mine = [f for p, f in follow.items() if len(p) == length]
        assert counts[length] == (len(mine), sum(map(len, mine)))
    asked = [[], [PAD], [PAD, 5], [5, 6], [5, 6, 7], [4], None] + [[PAD, 5]] * 50
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(asked)], "_key INT, prefix ARRAY<INT>")
    got = trie.allowed_next(df, made)
    assert got.columns == ["_key", "prefix", "allowed"] or "allowed" in got.columns
    for r in got.collect():
        p = r["prefix"]
        key = None if p is None else tuple(p[1:] if p[:1] == [PAD] else p)
        assert r["allowed"] == sorted(follow.get(key, {EOS}))
    assert got.count() == len(asked)


# --- pooling -----------------------------------------------------------------


def test_mean_over_tokens_by_hand(spark):
    vectors = {0: [1.0, 0.0], 1: [0.0, 1.0], 5: [3.0, 4.0], 6: [-1.0, 2.0]}
    table = spark.createDataFrame(list(vectors.items()), "token_id INT, vec ARRAY<FLOAT>")
    texts = [(1, [5, 6, 5, 1]), (2, [6]), (3, []), (4, None), (5, [99, 5])]
    df = spark.createDataFrame(texts, "id LONG, ids ARRAY<INT>")
    for padded in (False, True):
        batch = F.lit(0) if padded else None
        got = {r["id"]: r["vec"] for r in pooling.mean_over_tokens(df, table, "id", batch=batch, normalise=False).collect()}
        assert set(got) == {1, 2, 5}
        for key, ids in texts:
            if key in got:
                width = 4 if padded else len(ids)
                filled = ids + [PAD] * (width - len(ids))
                want = np.sum([vectors.get(t, [0, 0]) for t in filled], axis=0) / width
                assert np.allclose(got[key], want)
    unit = pooling.mean_over_tokens(df, table, "id", limit=2).collect()
    assert all(np.isclose(np.linalg.norm(r["vec"]), 1) for r in unit)


# --- joins that repeat on both sides -----------------------------------------


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("split", [3, 1000])
def test_many_to_many_join(spark, how, split):
    rng = random.Random(3)
    keys = ["hot"] * 40 + ["left only"] * 20 + [None] * 5 + [f"k{rng.randrange(10)}" for _ in range(40)]
    left = [(k, key) for k, key in enumerate(keys)]
    others = ["hot"] * 25 + ["right only"] * 9 + [None] * 4 + [f"k{rng.randrange(14)}" for _ in range(40)]
    right = [(k, key, f"p{k}") for k, key in enumerate(others)]
    got = skew.skew_join_many(
        spark.createDataFrame(left, "row_id LONG, key STRING"), spark.createDataFrame(right, "pid LONG, key STRING, said STRING"),
        "key", how, "row_id", "pid", split,
    )
    want = [(a, key, b, said) for a, key in left for b, other, said in right if key is not None and key == other]
    if how == "left":
        known = {key for _, key, _ in right if key is not None}
        want += [(a, key, None, None) for a, key in left if key not in known]
    rows = got.select("row_id", "key", "pid", "said").collect()
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    with pytest.raises(ValueError):
        skew.skew_join_many(got, got, "key", "full")
