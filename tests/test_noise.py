"""Properties every noise function keeps, on ordinary and odd lines."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from smudgeline.functions import draws, noise
from smudgeline.functions import lexicons as lx
from smudgeline.operators import augment

ODD = [
    None, "", "A", "12345", "NOSPACES", "BCD FGH", "X" * 70, "Y Z " * 20, "1 N MAIN ST NW",
    "112TH AND 12TH", "1021ST PL", "12 NORTH N. ST", "  ", "12 North N. ST Sth ", "é𝔘b ñ",
    "100 NW SMALL RING 21ST ST",
]
# names as the tables have them, capitalised and closed with a point
ODD += [f"{n}." for n in pq.read_table("/root/testdata/sf0.001/part.parquet")["p_name"].to_pylist()[:2]]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "line_id LONG, line STRING").repartition(3)


def made(df, fn, seed=1, times=1, **options):
    """line -> list of texts over ``times`` iterations."""
    out = df.withColumn("it", F.explode(F.sequence(F.lit(1), F.lit(times))))
    out = out.withColumn("b", draws.base(seed, F.col("line_id"), F.col("it"), F.lit(0)))
    rows = out.select("line_id", "it", "line", fn(F.col("line"), F.col("b"), **options).alias("r"))
    return [(r.line, r.r.text, r.r.step) for r in rows.orderBy("line_id", "it").collect()]


@pytest.mark.parametrize("name", list(noise.STEPS))
def test_never_fails_and_names_its_step(odd, name):
    rows = made(odd, noise.STEPS[name], times=5)
    assert len(rows) == 5 * len(ODD)
    for line, text, step in rows:
        assert step == name
        assert (text is None) == (line is None)
    assert rows == made(odd, noise.STEPS[name], times=5)
    if name not in ("convert_cardinal_directions",):
        assert rows != made(odd, noise.STEPS[name], seed=2, times=5)


def is_subsequence(small, big):
    it = iter(big)
    return all(c in it for c in small)


def known(rows):
    return [(a, b) for a, b, _ in rows if a is not None]


def test_remove_vowels(odd):
    for line, text in known(made(odd, noise.remove_vowels, times=8)):
        vowels = sum(c in "AEIOUaeiou" for c in line)
        assert is_subsequence(text, line)
        assert 1 <= len(line) - len(text) <= vowels if vowels else text == line
    assert made(odd, noise.remove_vowels, legacy_label=True)[0][2] == "randomly_replace_vowels"


def test_change_case(odd):
    for line, text in known(made(odd, noise.change_case, times=8)):
        assert text.lower() == line.lower()
        if any(c.isalpha() for c in line):
            assert text != line


def test_replace_spaces(odd):
    for line, text in known(made(odd, noise.replace_spaces, times=8)):
        if " " in line:
            assert text != line
        else:
            assert text == line
        assert is_subsequence(line.replace(" ", ""), text)


def test_add_special(odd):
    for line, text in known(made(odd, noise.add_special, times=8)):
        assert is_subsequence(line, text)
        most = max(70 - len(line), int(0.1 * len(line)))
        assert 1 <= len(text) - len(line) <= most
        extra = list(text)
        for c in line:
            extra.remove(c)
        assert set(extra) <= set(lx.SEPARATORS)


def test_repeat_part(odd):
    for line, text in known(made(odd, noise.repeat_part, times=8)):
        assert (1 <= len(text) - len(line) <= 8) if line else text == ""
    for line, text in known(made(odd, noise.repeat_part, times=8, max_len=20)):
        assert len(text) <= 20 or text == line


def test_repeat_characters(odd):
    for line, text in known(made(odd, noise.repeat_characters, times=8)):
        assert is_subsequence(line, text)
        assert len(text) <= (50 if len(line) < 49 else len(line) + 7)


def test_insert_random_word(odd):
    words = set(lx.word_list())
    for line, text in known(made(odd, noise.insert_random_word, times=8)):
        assert text.startswith(line) and len(text) <= max(70, len(line))
        added = text[len(line):]
        if added:
            assert added[0] in lx.SEPARATORS and added[1:] in words
            assert added[1].lower() not in line.lower()
    for line, text in known(made(odd, noise.insert_random_word, times=8, whole_word=True)):
        assert text[len(line) + 1 :] == "" or text[len(line) + 1 :].lower() not in line.lower()


def test_own_words(odd):
    rows = known(made(odd, noise.insert_random_word, times=8, words=("QQ", "QQQ")))
    assert {t[len(a) + 1 :] for a, t in rows} == {"", "QQ", "QQQ"}


def test_add_random_text(odd):
    for line, text in known(made(odd, noise.add_random_text, times=8)):
        if len(line) >= 70:
            assert text == line
        else:
            assert len(line) < len(text) <= 71 and is_subsequence(line, text)


def test_replace_char(odd):
    for line, text in known(made(odd, noise.replace_char, times=4)):
        if sum(c.isascii() and c.isalnum() for c in line) < 2:
            assert text == line
    rows = known(made(odd, noise.replace_char, times=8, table={c: ["*"] for c in lx.KEYS}))
    for line, text in rows:
        alnum = sum(c.isascii() and c.isalnum() for c in line)
        assert len(text) == len(line)
        changed = sum(a != b for a, b in zip(line, text))
        assert (1 <= changed <= alnum // 2) if alnum > 1 else changed == 0


def test_change_ordinals(odd):
    rows = known(made(odd, noise.change_ordinals, times=8))
    by_line = {}
    for line, text in rows:
        by_line.setdefault(line, set()).add(text)
    assert by_line["1021ST PL"] <= {"10" + s + " PL" for s in lx.ordinals()["21ST"]}
    assert by_line["112TH AND 12TH"] <= {s + " AND 12TH" for s in lx.ordinals()["112TH"]}
    assert by_line["BCD FGH"] == {"BCD FGH"}


def test_lower_case_ordinal_is_found_but_kept(spark):
    df = spark.createDataFrame([(1, "4 21st PL")], "line_id LONG, line STRING")
    assert made(df, noise.change_ordinals) == [("4 21st PL", "4 21st PL", "change_ordinal_numbers")]


def test_change_directions(odd):
    dirs = lx.directions()
    rows = known(made(odd, noise.change_directions, times=12))
    for line, text in rows:
        if line == "1 N MAIN ST NW":
            _, rest = text.split("1 ", 1)
            first, last = rest.split(" MAIN ST ", 1)
            assert first in dirs["N"] and first != "N"
            assert last.startswith(" ") and last[1:] in dirs["NW"] and last[1:] != "NW"
        elif line in ("BCD FGH", "NOSPACES"):
            assert text == line


def test_longest_direction_first(spark):
    df = spark.createDataFrame([(1, "1 N W A"), (2, "N W A"), (3, "9 NORTH N EAST B")], "line_id LONG, line STRING")
    dirs = lx.directions()
    for line, text in known(made(df, noise.change_directions, times=12)):
        if line == "1 N W A":
            assert text[2:-2] in dirs["NW"]
        elif line == "N W A":
            assert text.startswith("N ") and text[2:-2] in dirs["W"]
        else:
            words = text[2:-2]
            assert any(words.startswith(n + " ") and words[len(n) + 1 :] in dirs["NE"] for n in dirs["N"])


def test_convert_directions(odd):
    for line, text in known(made(odd, noise.convert_directions, times=8)):
        if line == "1 N MAIN ST NW":
            assert text in {f"1 {f} MAIN ST NW" for f in ("North", "Nrth", "N.")}


def test_insert_directions(odd):
    flat = [v for vs in lx.directions().values() for v in vs]
    for line, text in known(made(odd, noise.insert_random_directions, times=4)):
        assert is_subsequence(line, text)
        assert (text != line) == bool(line)
    guarded = known(made(odd, noise.insert_random_directions, times=4, skip_if_present=True))
    assert all(t == a for a, t in guarded if a == "1 N MAIN ST NW")
    for line, text in known(made(odd, noise.insert_direction, times=4)):
        if line == "1 N MAIN ST NW":
            assert text == line
        if line == "BCD FGH":
            assert any(f" {v} " in text for v in flat)


def test_draws_are_spread(spark):
    n = 20_000
    df = spark.range(n).select(draws.pick(draws.base(3, F.col("id")), 0, 10).alias("p"))
    counts = [r["count"] for r in df.groupBy("p").count().collect()]
    assert len(counts) == 10 and max(counts) < 1.1 * n / 10
    near = spark.range(50).select(draws.draw(F.lit(5).cast("long"), F.col("id")).alias("d"))
    assert near.distinct().count() == 50


def test_apply_steps_repeats_and_order(spark):
    df = spark.createDataFrame([(1, "100 MAPLE AVENUE EAST")], "line_id LONG, first_line STRING")
    src = augment.add_working_column(df)
    plan = ["randomly_remove_vowels", "randomly_remove_vowels", "change_case"]
    row = augment.apply_steps(src, plan).first()
    assert row[augment.STEPS] == "".join(f", {p}" for p in plan)
    again = augment.apply_steps(augment.apply_steps(src, plan), ["change_case"]).first()
    assert again[augment.STEPS] == ", change_case"


def test_grid_is_whole_and_stable(spark):
    df = spark.createDataFrame(
        [(i, f"{100 + i} NW MAPLE {i}TH ST") for i in range(20)], "line_id LONG, first_line STRING"
    )
    plans = [["change_case"], ["randomly_remove_vowels", "change_case"], []]
    one = augment.augment_grid(df, plans, 3, partitions=1)
    many = augment.augment_grid(df, plans, 3, partitions=7)
    key = ["row_id", augment.NOISY, augment.STEPS, "n_steps"]
    a, b = (sorted(map(tuple, d.select(*key).collect())) for d in (one, many))
    assert a == b and len({r[0] for r in a}) == 20 * 3 * 3
    assert {r[2].count(",") == r[3] for r in a} == {True}
    assert {(r[1] in {f"{100 + i} NW MAPLE {i}TH ST" for i in range(20)}) for r in a if r[3] == 0} == {True}


def test_plans():
    assert len(augment.plan_lists(noise.GRID_STEPS, 2)) == 78
    assert len(augment.plan_lists(noise.GRID_STEPS, 3, ordered=True)) == 13 * 12 * 11


def test_lexicon_rules():
    o = lx.ordinals()
    assert len(o) == 760 and o["21ST"] == ["TWENTY FIRST", "TWENTY 1ST"]
    assert o["40TH"] == ["FORTIETH"] and "312TH" in o and o["14TH"][1] == "4 TEENTH"
    assert len(o["124TH"]) == 6 and o["700TH"] == ["SEVEN HUNDREDTH", "7 HUNDREDTH"]
    assert {k: len(v) for k, v in lx.directions().items()} == {
        "N": 5, "S": 4, "E": 3, "W": 3, "NW": 30, "NE": 30, "SW": 24, "SE": 24
    }
    looks = lx.lookalikes()
    assert len(looks) == 36 and all(29 <= len(v) <= 265 and k in v for k, v in looks.items())
    assert len(lx.FRACTIONS) == 13 and len(lx.SEPARATORS) == 17 and len(lx.SPACE_SUBSTITUTES) == 32
    assert len(lx.word_list()) > 1500


def test_long_lines_are_stretched_and_marked(spark):
    lines = ["ABCDEFGHIJ" * 6 + " ROAD", "QWERTYUIOP" * 9]
    for line in lines:
        df = spark.range(20).select(
            noise.repeat_characters(F.lit(line), draws.base(3, F.col("id"))).alias("r"),
            noise.add_special(F.lit(line), draws.base(4, F.col("id"))).alias("s"),
        )
        for row in df.collect():
            assert len(line) < len(row["r"]["text"]) <= len(line) + 8
            left = iter(row["s"]["text"])
            assert all(c in left for c in line)
