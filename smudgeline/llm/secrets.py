"""Secret scans: fixed patterns, and a battery of randomness tests on token-like runs.

A run of key characters, parted at '=', is read in the smallest alphabet it fits (of 16, 32, 36, 62
and 64) and put to tests of being random: chi-squared uniformity of its alphabet, runs above and
below the middle, serial correlation, and the share of digits. A run that fails is parted at '/',
then at '_' and '-', and its parts are tested by themselves. Their combined chance is uniform for real keys and near 0 for words,
paths and counters. In every class of length and encoding the corpus-wide histogram of chances
tells how many runs above a cut are not random: keys fill all bins evenly, so what exceeds the
level of the upper half is false. The lowest cut with few enough false ones is taken.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import in_batches, texts

# The kinds of the base patterns, in order, and the least length of each.
KINDS = ("assign", "access", "hex")
RANDOM = "random"
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_LEAST = 6
# a run is taken whole, so asking for its least length in the pattern finds the same runs
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST)
PARTS = (re.compile(r"[^/]+"), re.compile(r"[^/_-]+"))
#: spelt as words are: too many of these share a class with keys, and keys hardly ever look so
PLAIN_WORD = re.compile(r"[A-Z]?[a-z]+")
#: below this chance a run is parted
PART_BELOW = 0.02
#: sizes of alphabets, the runs that fit them, and the value of each character, smallest first
ALPHABETS = [
    (16, re.compile(r"[0-9a-f]+|[0-9A-F]+"), "0123456789abcdef"),
    (32, re.compile(r"[a-z2-7]+|[A-Z2-7]+"), "abcdefghijklmnopqrstuvwxyz234567"),
    (36, re.compile(r"[a-z0-9]+|[A-Z0-9]+"), "0123456789abcdefghijklmnopqrstuvwxyz"),
    # keys in base 64 that hold none of its two marks are even over the others
    (62, re.compile(r"[A-Za-z0-9]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (64, re.compile(r"[A-Za-z0-9+/_-]+"), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
]
BINS = 50
#: lower ends of the length classes
LENGTHS = (LEAST, 20, 24, 32, 40, 64, 128)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, sorted."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def normal_tail(z: float) -> float:
    """Chance of a normal value further out than z on either side."""
    return math.erfc(abs(z) / math.sqrt(2))


def chi_squared_tail(x: float, freedom: int) -> float:
    """Upper tail by the cube-root approximation."""
    if x <= 0:
        return 1.0
    z = ((x / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 0.5 * math.erfc(z / math.sqrt(2))


def fisher(chances: list[float]) -> float:
    """Combined chance of independent tests."""
    half = -sum(math.log(max(c, 1e-300)) for c in chances)
    term = total = 1.0
    for k in range(1, len(chances)):
        term *= half / k
        total += term
    return math.exp(-half) * total


def value_table(letters: str) -> np.ndarray:
    """Values of ASCII codes; both cases where the alphabet has one, and the marks of both base 64s."""
    out = np.zeros(128, np.int64)
    for at, c in enumerate(letters):
        out[ord(c)] = at
        if len(letters) <= 36:
            out[ord(c.upper())] = at
    if len(letters) == 64:
        out[ord("-")], out[ord("_")] = 62, 63
    return out


VALUES = {size: value_table(letters) for size, _, letters in ALPHABETS}
DIGITS = {size: sum(c.isdigit() for c in letters) / size for size, _, letters in ALPHABETS}


def alphabet(run: str) -> int:
    """Size of the smallest alphabet a run fits."""
    return next(size for size, fits, _ in ALPHABETS if fits.fullmatch(run))


def randomness(run: str, size: int) -> float:
    """Combined chance that a random run of this length and alphabet looks less random."""
    codes = np.frombuffer(run.encode("ascii"), np.uint8)
    values = VALUES[size][codes]
    n = len(values)
    # uniformity over groups of the alphabet that expect at least about three members
    groups = max(4, min(size, 1 << int(math.log2(max(4, n / 3)))))
    seen = np.bincount(values * groups // size, minlength=groups)
    expected = np.bincount(np.arange(size) * groups // size) * n / size
    uniform = chi_squared_tail(float(((seen - expected) ** 2 / expected).sum()), groups - 1)
    above = values >= size // 2
    n1 = int(above.sum())
    n0 = n - n1
    if not n0 or not n1:
        return 0.0
    runs = 1 + int((above[1:] != above[:-1]).sum())
    mean = 2 * n0 * n1 / n + 1
    variance = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    by_runs = normal_tail((runs - mean) / math.sqrt(variance))
    centred = values - values.mean()
    power = float((centred**2).sum())
    serial = float((centred[1:] * centred[:-1]).sum()) / power if power else 1.0
    by_serial = normal_tail((serial + 1 / n) * math.sqrt(n))
    if size > 16:
        # a key mixes letters and digits as its alphabet does
        share = DIGITS[size]
        digits = int((codes < 58).sum() - (codes < 48).sum())
        by_digits = normal_tail((digits - n * share) / math.sqrt(n * share * (1 - share)))
        return fisher([uniform, by_runs, by_serial, by_digits])
    return fisher([uniform, by_runs, by_serial])


def candidates(text: str) -> list[tuple[int, int, int, float]]:
    """``(start, end, alphabet, chance)`` of runs that hold letters and are no plain words, or of the parts of failing ones."""
    out = []

    def test(start: int, end: int, depth: int) -> None:
        run = text[start:end].rstrip("=")
        if len(run) < LEAST or run.lower() == run.upper() or PLAIN_WORD.fullmatch(run):
            return
        size = alphabet(run)
        chance = randomness(run, size)
        if chance < PART_BELOW and size == 64:
            for k in range(depth, len(PARTS)):
                parts = [m.span() for m in PARTS[k].finditer(run)]
                if len(parts) > 1 or (parts and parts[0] != (0, len(run))):
                    for a, b in parts:
                        test(start + a, end if b == len(run) else start + b, k + 1)
                    return
        out.append((start, end, size, chance))

    for m in CANDIDATE.finditer(text):
        end = m.end()
        if end > len(m[0].rstrip("=")) + m.start() and text[end : end + 1].isalnum():
            end = m.start() + len(m[0].rstrip("="))  # a name before its value, not padding
        test(m.start(), end, 0)
    return out


def length_class(n: int) -> int:
    return sum(n >= least for least in LENGTHS) - 1


def cut(counts: np.ndarray, false_share: float) -> float:
    """The least chance kept, from a class's histogram of chances.

    Random runs fill the bins evenly, and the upper half of the histogram holds hardly anything
    else; ``false_share`` is the most that may be of other origin among those kept, beside what two
    standard deviations of the random ones account for.
    """
    level = counts[BINS // 2 :].sum() / (BINS - BINS // 2)
    kept = np.cumsum(counts[::-1])[::-1]  # from each bin up
    for at in range(BINS):
        even = level * (BINS - at)
        if kept[at] and (kept[at] - even) <= false_share * kept[at] + 2 * math.sqrt(even):
            return at / BINS
    return 0.5


def scan(documents: DataFrame, false_share: float = 0.05, least_chance: float = 0.002) -> DataFrame:
    """``(doc_id, base, found)`` per row: spans of the patterns, and of random runs beside them.

    Each is a list of ``(kind, start, end)`` in characters, the end exclusive, sorted by start
    and kind. A null text is empty. A random run that meets a base span is left to it. Rows that
    repeat are scanned alike; columns other than doc_id and text are not read. Cuts come from
    all runs of all rows: a class without any keeps nothing.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    run_type = pa.struct(
        [("start", pa.int64()), ("end", pa.int64()), ("alphabet", pa.int32()), ("chance", pa.float64()),
         ("size", pa.int32())]
    )
    schema = pa.schema([("doc_id", pa.int64()), ("base", pa.list_(span)), ("runs", pa.list_(run_type))])

    def work(batch: pa.RecordBatch) -> dict:
        base, runs = [], []
        for text in texts(batch.column(1)):
            spans = base_spans(text)
            base.append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans])
            runs.append(
                [
                    {"start": a, "end": b, "alphabet": h, "chance": p, "size": length_class(b - a)}
                    for a, b, h, p in candidates(text)
                    if not any(a < e and s < b for s, _, e in spans)
                ]
            )
        return {"doc_id": batch.column(0), "base": base, "runs": runs}

    tested = stored(
        documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
            in_batches(work, schema),
            "doc_id long, base array<struct<kind:string,start:long,end:long>>, "
            "runs array<struct<start:long,end:long,alphabet:int,chance:double,size:int>>",
        ),
        "secret-runs",
    )
    bins = (
        tested.select(F.explode("runs").alias("r"))
        .groupBy(
            F.col("r.alphabet").alias("alphabet"), F.col("r.size").alias("size"),
            F.least(F.floor(F.col("r.chance") * BINS), F.lit(BINS - 1)).cast("int").alias("bin"),
        )
        .count()
    )
    histograms: dict[tuple, np.ndarray] = {}
    for r in bins.collect():  # alphabets x length classes x bins
        histograms.setdefault((r["alphabet"], r["size"]), np.zeros(BINS))[r["bin"]] = r["count"]
    cuts = {k: max(least_chance, cut(c, false_share)) for k, c in histograms.items()}

    def limit(run):
        out = F.lit(2.0)
        for (letters, size), value in cuts.items():
            out = F.when((run["alphabet"] == letters) & (run["size"] == size), F.lit(value)).otherwise(out)
        return out

    found = F.transform(
        F.filter("runs", lambda r: r["chance"] >= limit(r)),
        lambda r: F.struct(F.lit(RANDOM).alias("kind"), r["start"].alias("start"), r["end"].alias("end")),
    )
    return tested.select("doc_id", "base", found.alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts, the hash of the base spans, and all spans as one text."""

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))),
            ",",
        )

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    order = (*KINDS, RANDOM)
    ranked = F.transform(
        F.array_sort(
            F.transform(
                F.concat("base", "found"),
                lambda s: F.struct(
                    s["start"].alias("start"),
                    F.array_position(F.array(*map(F.lit, order)), s["kind"]).alias("rank"),
                    s["end"].alias("end"), s["kind"].alias("kind"),
                ),
            )
        ),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")),
    )
    return scanned.select(
        "doc_id",
        *(count(k) for k in KINDS),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(ranked).alias("spans"),
        F.size("found").cast("long").alias("n_random"),
    )

