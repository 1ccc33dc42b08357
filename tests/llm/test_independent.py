"""Plain versions of what the operators work out, written from their descriptions and not from their code."""

import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from smudgeline.llm import mixing, quality, secrets, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"
DIMS = 1 << 16

# toxicity ------------------------------------------------------------------------------------


def sentences_of(text):
    """Distinct words of each sentence as feature numbers."""
    parts = re.split(r"[.!?\n]+", text.lower())
    return [{zlib.crc32(w.encode()) % DIMS for w in re.findall(r"[^\W\d_]+", p)} for p in parts]


def sigmoid(x):
    return 1 / (1 + math.exp(-x))


def clean_chance(text, weights, bias, leak, telling):
    """Chance that no sentence offends and nothing unexplained does."""
    chance = 1 - sigmoid(leak)
    for words in sentences_of(text):
        if words & telling:
            chance *= 1 - sigmoid(bias + sum(weights.get(w, 0.0) for w in words))
    return chance


def test_noisy_or_against_plain_version(spark):
    rng = random.Random(2)
    words = [f"w{chr(97 + k)}" for k in range(20)]
    weights = {zlib.crc32(w.encode()) % DIMS: rng.uniform(-2, 6) for w in words[:8]}
    model = toxicity.SentenceModel(np.zeros(DIMS), -3.0, -4.0)
    for at, w in weights.items():
        model.weights[at] = w
    texts = ["", "...", "Wa. wb! 7wc\nwd_we"] + [
        "".join(rng.choice(words) + rng.choice([" ", " ", ". ", "!?", "\n"]) for _ in range(rng.randrange(40))) for _ in range(60)
    ]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    for r in toxicity.score(docs, model).collect():
        want = 1 - clean_chance(texts[r["doc_id"]], weights, -3.0, -4.0, set(weights))
        assert r["score"] == pytest.approx(want, abs=1e-9)
        assert r["n_sentences"] == len(sentences_of(texts[r["doc_id"]]))


def test_one_gradient_step_against_differences(spark):
    rng = random.Random(5)
    plain = [f"p{chr(97 + k)}" for k in range(15)]
    docs, labels = [], []
    for k in range(160):
        toxic = k % 4 == 0
        lines = [" ".join(rng.choices(plain, k=4)) for _ in range(3)]
        if toxic and k % 16:
            lines[1] += " vile"
        if k % 3 == 0 and toxic:
            lines[2] += " rotten"
        docs.append((k, ". ".join(lines)))
        labels.append((k, int(toxic)))
    given = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    before, after = (toxicity.fit(*given, dims=DIMS, iterations=n, step=0.3, decay=1e-3) for n in (0, 1))
    telling = set(np.flatnonzero(before.weights).tolist())
    assert zlib.crc32(b"vile") % DIMS in telling

    def loss(weights, bias, leak):
        total = 0.0
        for (_, text), (_, toxic) in zip(docs, labels, strict=True):
            clean = clean_chance(text, weights, bias, leak, telling)
            total -= math.log(1 - clean if toxic else clean)
        return total / len(docs) + 0.5e-3 * sum(w * w for w in weights.values())

    start = {k: float(before.weights[k]) for k in telling}
    h = 1e-5

    def slope(change):
        return (change(h) - change(-h)) / (2 * h)

    for k in telling:
        g = slope(lambda d, k=k: loss({**start, k: start[k] + d}, before.bias, before.leak))
        assert start[k] - after.weights[k] == pytest.approx(0.3 * g / (abs(g) + 1e-5), abs=2e-3)
    g = slope(lambda d: loss(start, before.bias + d, before.leak))
    assert before.bias - after.bias == pytest.approx(0.06 * g / (abs(g) + 1e-5), abs=2e-3)
    g = slope(lambda d: loss(start, before.bias, before.leak + d))
    assert before.leak - after.leak == pytest.approx(0.06 * g / (abs(g) + 1e-5), abs=2e-3)
    assert not np.flatnonzero(after.weights[[k for k in range(DIMS) if k not in telling]]).size


# quality -------------------------------------------------------------------------------------

MARKS = ".,;:!?'\"()-"


def kind_of(c):
    if c == "\n":
        return "line end"
    if c.isspace():
        return "blank"
    if c in MARKS:
        return "mark"
    if ord(c) < 65536:
        for name in ("islower", "isupper", "isalpha", "isdigit", "isprintable"):
            if getattr(c, name)():
                return name
    return "other"


def shares(counts):
    total = sum(counts.values())
    return {k: n / total for k, n in counts.items()}


def distance(p, q):
    total = 0.0
    for k in {*p, *q}:
        a, b = p.get(k, 0.0), q.get(k, 0.0)
        for x in (a, b):
            if x:
                total += x * math.log2(2 * x / (a + b))
    return math.sqrt(max(0.0, total / 2))


def plain(text):
    return [w.lower().strip(MARKS) for w in text.split()]


def test_distances_against_plain_version(spark):
    rng = random.Random(11)
    docs = []
    for lang, pool in (("en", 150), ("de", 90)):
        words = [f"{lang}{k}" for k in range(pool)]
        for _ in range(40):
            text = " ".join(rng.choices(words, [1 / (k + 1) for k in range(pool)], k=rng.randrange(20, 200)))
            docs.append((len(docs), text.capitalize() + rng.choice([".", "!\n", " (3)", "é一\U0001d518"]), lang, "a"))
    docs += [(900, "few", "rare", "a"), (901, "", "en", "a")]
    rules = quality.QualityRules()
    given = spark.createDataFrame(docs, SCHEMA)
    judged = quality.judge(given, quality.references(given, rules), rules).collect()
    by_class, by_word = {}, {}
    for lang in ("en", "de"):
        texts = [t for _, t, mark, _ in docs if mark == lang]
        by_class[lang] = shares(Counter(map(kind_of, "".join(texts))))
        counts = Counter(w for t in texts for w in plain(t))
        top = sorted(counts, key=lambda w: (-counts[w], w.encode()))[: rules.common_words]
        ref = {w: counts[w] / sum(counts.values()) for w in top}
        by_word[lang] = ref | {None: 1 - sum(ref.values())}
    compared = 0
    for r in judged:
        text, q = docs[[d[0] for d in docs].index(r["doc_id"])][1], r["quality"]
        assert (q["class_distance"] is None) == (len(text) < rules.min_chars_compared)
        assert (q["word_distance"] is None) == (len(text.split()) < rules.min_words_compared)
        if q["class_distance"] is not None:
            own = shares(Counter(map(kind_of, text)))
            assert q["class_distance"] == pytest.approx(min(distance(own, c) for c in by_class.values()), abs=1e-9)
        if q["word_distance"] is not None:
            compared += 1
            found = [shares(Counter(w if w in ref else None for w in plain(text))) for ref in by_word.values()]
            want = min(distance(p, ref) for p, ref in zip(found, by_word.values(), strict=True))
            assert q["word_distance"] == pytest.approx(want, abs=1e-9)
    assert compared > 40


# mixing --------------------------------------------------------------------------------------


def best_flow(sizes, members, quotas, most):
    """Largest amount, then least price, over all ways to hand out words; a word's r-th use costs (r - 1) squared."""
    options = []
    for size, sources in zip(sizes, members, strict=True):
        amounts = itertools.product(range(most * size + 1), repeat=len(sources))
        options.append([dict(zip(sources, a, strict=True)) for a in amounts if sum(a) <= most * size])
    best = (0, 0)
    for choice in itertools.product(*options):
        into = Counter()
        for part in choice:
            into.update(part)
        if any(into[s] > q for s, q in enumerate(quotas)):
            continue
        price = 0
        for size, part in zip(sizes, choice, strict=True):
            left = sum(part.values())
            for r in range(most):
                price += r * r * min(left, size)
                left -= min(left, size)
        best = min(best, (-sum(into.values()), price))
    return -best[0], best[1]


def test_flow_against_all_ways():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randrange(1, 4)
        sizes = [rng.randrange(0, 4) for _ in range(n)]
        members = [sorted(rng.sample(range(2), rng.randrange(1, 3))) for _ in range(n)]
        quotas = [rng.randrange(0, 8) for _ in range(2)]
        flow = mixing.route(sizes, members, quotas, lambda r: r * r, 2)
        amount = sum(flow.routed.values())
        price = sum(r * r * g for given in flow.given for r, g in enumerate(given))
        assert (amount, price) == best_flow(sizes, members, quotas, 2)
        for s, quota in enumerate(quotas):
            assert sum(v for (_, to), v in flow.routed.items() if to == s) <= quota
        for p, given in enumerate(flow.given):
            assert sum(v for (frm, _), v in flow.routed.items() if frm == p) == sum(given)
            assert all(0 <= g <= sizes[p] for g in given)


def test_equal_rows_are_dealt_in_lots(spark, monkeypatch):
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 7)
    docs = spark.createDataFrame([(None, "one two three", "en", "a")] * 50 + [(1, "x", "en", "b")], SCHEMA)
    rows = mixing.mix_documents(docs).collect()
    assert len(rows) == 51 and sum(r["doc_id"] is None for r in rows) == 50
    assert sum(r["taken"] for r in rows if r["doc_id"] is None) <= 2 * 150


# secrets -------------------------------------------------------------------------------------


def upper_tail(x, freedom):
    """Exact chi-squared tail."""
    if freedom % 2 == 0:
        return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(freedom // 2))
    total = math.erfc(math.sqrt(x / 2))
    term = math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    for k in range(1, freedom - 1, 2):
        total += term
        term *= x / (k + 2)
    return total


def combined(chances):
    """Fisher: the tail of minus twice the sum of logs, with two degrees for each test."""
    return upper_tail(-2 * sum(math.log(c) for c in chances), 2 * len(chances))


def two_sided(z):
    return 2 * (1 - 0.5 * (1 + math.erf(abs(z) / math.sqrt(2))))


def plain_battery(run, letters, digits_tell):
    values = [letters.index(c) for c in run]
    n, size = len(values), len(letters)
    groups = 4
    while groups * 2 <= min(size, n / 3):
        groups *= 2
    seen = Counter(v * groups // size for v in values)
    wide = Counter(v * groups // size for v in range(size))
    chi = sum((seen[g] - n * wide[g] / size) ** 2 / (n * wide[g] / size) for g in range(groups))
    high = [v >= size // 2 for v in values]
    n1 = sum(high)
    n0 = n - n1
    if not n0 or not n1:
        return 0.0
    runs = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False))
    mean = 1 + 2 * n0 * n1 / n
    spread = math.sqrt((mean - 1) * (mean - 2) / (n - 1))
    middle = sum(values) / n
    power = sum((v - middle) ** 2 for v in values)
    serial = sum((a - middle) * (b - middle) for a, b in zip(values, values[1:], strict=False)) / power
    chances = [upper_tail(chi, groups - 1), two_sided((runs - mean) / spread), two_sided((serial + 1 / n) * math.sqrt(n))]
    if digits_tell:
        share = sum(c.isdigit() for c in letters) / size
        chances.append(two_sided((sum(c.isdigit() for c in run) - n * share) / math.sqrt(n * share * (1 - share))))
    return combined(chances)


def test_battery_against_plain_version():
    rng = random.Random(13)
    lower = "abcdefghijklmnopqrstuvwxyz"
    forms = {16: "0123456789abcdef", 32: lower + "234567", 36: "0123456789" + lower,
             62: lower.upper() + lower + "0123456789", 64: lower.upper() + lower + "0123456789+/"}
    for size, letters in forms.items():
        for n in (16, 24, 40, 130):
            for kind in range(12):
                few = letters if kind < 8 else letters[: size // 2 + 2]
                run = "".join(rng.choice(few) for _ in range(n))
                # the library's chi-squared tail is an approximation
                assert secrets.randomness(run, size) == pytest.approx(plain_battery(run, letters, size > 16), abs=0.02)
    assert all(abs(secrets.chi_squared_tail(x, f) - upper_tail(x, f)) < 0.01 for x in (0.5, 3, 9, 20, 60) for f in (3, 7, 15, 31, 63))


def test_cut_controls_false_runs():
    """Even bins of keys, and words in the first one: the cut leaves few words in."""
    rng = random.Random(17)
    for words, keys in ((5000, 500), (300, 3000), (0, 1000)):
        counts = np.zeros(secrets.BINS)
        for _ in range(keys):
            counts[rng.randrange(secrets.BINS)] += 1
        counts[0] += words
        at = secrets.cut(counts, 0.05)
        assert (at > 0) == (words > 250)
        first = round(at * secrets.BINS)
        kept = counts[first:].sum()
        assert kept >= 0.9 * keys * (1 - at) and (words if first == 0 else 0) <= 0.05 * kept + 3 * math.sqrt(keys)
