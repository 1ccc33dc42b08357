"""Quality rules: plain counts, and Jensen-Shannon distance to references of each language.

A reference holds two histograms taken over every document of a language: classes of characters,
and the language's commonest words against all others. A document is held against the nearest
reference, so a wrong language mark does no harm. Rows without a known mark and marks with few
documents or words make no reference, so junk is not measured by itself. Texts too short for a histogram to mean
anything are judged by the counts alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import ascii_words, texts

SYMBOLS = "#*$%&|<>"
CLASSES = 9
#: marks that name no language
UNKNOWN = ("", "und", "unk", "unknown", "mis", "mul", "zxx", "xx", "none", "null", "n/a", "other", "?", "-")
MARKS = ".,;:!?'\"()-"


@dataclass
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    common_words: int = 100
    #: words and characters below which a histogram is not compared
    min_words_compared: int = 50
    min_chars_compared: int = 300
    max_class_distance: float = 0.25
    #: a short text strays from any reference by chance: the slack is divided by the root of its words
    max_word_distance: float = 0.35
    word_slack: float = 1.2
    #: documents with words, and words, below which a mark makes no reference
    min_reference_documents: int = 20
    min_reference_words: int = 2000


@dataclass
class Reference:
    classes: np.ndarray
    words: dict[bytes, int] = field(default_factory=dict)
    shares: np.ndarray = field(default_factory=lambda: np.ones(1))


def class_table() -> np.ndarray:
    """Class of each code point of the first plane; later planes are class 8."""
    out = np.full(1 << 16, 8, np.uint8)
    for at in range(1 << 16):
        c = chr(at)
        if c == "\n":
            out[at] = 5
        elif c.isspace():
            out[at] = 4
        elif c in MARKS:
            out[at] = 6
        elif c.islower():
            out[at] = 0
        elif c.isupper():
            out[at] = 1
        elif c.isalpha():
            out[at] = 2
        elif c.isdigit():
            out[at] = 3
        elif c.isprintable():
            out[at] = 7
    return out


def class_counts(batch: list[str], of: np.ndarray) -> np.ndarray:
    """A row of class counts for each text, worked out for a few hundred texts at a time."""
    if len(batch) > 256:
        parts = [class_counts(batch[k : k + 256], of) for k in range(0, len(batch), 256)]
        return np.concatenate(parts)
    lengths = np.fromiter(map(len, batch), np.int64, len(batch))
    codes = np.frombuffer("".join(batch).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = of[np.minimum(codes, (1 << 16) - 1)].astype(np.int64)
    kinds[codes >= 1 << 16] = 8
    kinds += np.repeat(np.arange(len(batch)) * CLASSES, lengths)
    return np.bincount(kinds, minlength=CLASSES * len(batch)).reshape(len(batch), CLASSES)


def plain_words(words: list[bytes]) -> list[bytes]:
    """Words without the marks around them, in lower-case ASCII."""
    marks = MARKS.encode()
    return [w.lower().strip(marks) for w in words]


def references(documents: DataFrame, rules: QualityRules) -> dict[str, Reference]:
    """One reference per known language with enough documents and words, over all its documents.

    Where no known mark has enough, unmarked rows (null or '') are the reference if there are enough of
    them; without any reference no distance is taken. Counts are added up in each task before they are shuffled; what reaches the driver is the
    histogram of each language, not of any document.
    """
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
    flush_at = 300_000

    def run(batches):
        of = class_table()
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        spoken = Counter()

        def out():
            keys = [(lang, w, n) for lang, c in words.items() for w, n in c.items()]
            keys += [
                (lang, b"\n%d" % k, int(n)) for lang, row in classes.items() for k, n in enumerate(row)
            ]
            keys += [(lang, b"\n%d" % CLASSES, n) for lang, n in spoken.items()]
            words.clear()
            classes.clear()
            spoken.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*keys, strict=True), schema.types, strict=True)]
                if keys else [pa.array([], t) for t in schema.types],
                schema=schema,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            langs, batch_texts = texts(batch.column(0)), texts(batch.column(1))
            for lang, row in zip(langs, class_counts(batch_texts, of), strict=True):
                classes[lang] = classes.get(lang, 0) + row
            for lang, text in zip(langs, batch_texts, strict=True):
                found = plain_words(ascii_words(text))
                words.setdefault(lang, Counter()).update(found)
                spoken[lang] += bool(found)
            if sum(map(len, words.values())) > flush_at:
                yield from out()
        yield from out()

    counts = (
        documents.select(F.col("lang").cast("string"), F.col("text").cast("string"))
        .mapInArrow(run, "lang string, word binary, n long")
        .groupBy("lang", "word")
        .agg(F.sum("n").alias("n"))
    )
    is_class = F.substring("word", 1, 1) == F.lit(b"\n")
    place = Window.partitionBy("lang", "_class").orderBy(F.desc("n"), "word")
    # read three times: texts are gone through once
    kept = stored(counts.withColumn("_class", is_class), "word-counts")
    sums = kept.groupBy("lang", "_class").agg(F.sum("n").alias("total"))
    # marks with too few documents or words never reach the driver, however many marks there are
    spoken_mark = F.col("word") == F.lit(b"\n%d" % CLASSES)
    large_enough = (
        kept.groupBy("lang")
        .agg(
            F.max(F.when(spoken_mark, F.col("n"))).alias("documents"),
            F.sum(F.when(~F.col("_class"), F.col("n"))).alias("words"),
        )
        .filter((F.col("documents") >= rules.min_reference_documents) & (F.col("words") >= rules.min_reference_words))
        .select("lang")
    )
    # the first few of each mark are found before marks are compared, so no task meets all words of one
    top = (
        kept.withColumn("_at", F.row_number().over(place))
        .filter(F.col("_at") <= F.lit(max(rules.common_words, CLASSES + 1)))
        .drop("_at")
        .join(sums, ["lang", "_class"])
        .join(large_enough, "lang", "left_semi")
    )
    out: dict[str, Reference] = {}
    common: dict[str, list] = {}
    enough: dict[str, list[bool]] = {}
    for r in sorted(top.collect(), key=lambda r: (r["lang"], -r["n"], bytes(r["word"]))):
        ref = out.setdefault(r["lang"], Reference(np.zeros(CLASSES)))
        at = int(bytes(r["word"])[1:]) if r["_class"] else None
        if at == CLASSES:
            enough.setdefault(r["lang"], []).append(r["n"] >= rules.min_reference_documents)
        elif at is not None:
            ref.classes[at] = r["n"]
        elif len(common.setdefault(r["lang"], [])) < rules.common_words:
            if not common[r["lang"]]:
                enough.setdefault(r["lang"], []).append(r["total"] >= rules.min_reference_words)
            common[r["lang"]].append((bytes(r["word"]), r["n"] / r["total"]))
    large = {lang for lang, ok in enough.items() if all(ok)}
    admitted = {lang for lang in large if lang.strip().lower() not in UNKNOWN} or large & {""}
    for lang, ref in list(out.items()):
        if not ref.classes.sum() or lang not in common or lang not in admitted:
            del out[lang]
            continue
        ref.classes = ref.classes / ref.classes.sum()
        ref.words = {w: k for k, (w, _) in enumerate(common[lang])}
        shares = [s for _, s in common[lang]]
        ref.shares = np.array([*shares, max(0.0, 1 - sum(shares))])
    return out


def js_distance(p: np.ndarray, q: np.ndarray) -> float:
    """Square root of the Jensen-Shannon divergence in bits: 0 for equals, 1 for strangers."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum()
        right = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, (left + right) / 2)))


def word_histogram(words: list[bytes], ref: Reference) -> np.ndarray:
    """Shares of the reference's words in a text, and of all others."""
    other = len(ref.words)
    got = Counter(map(ref.words.get, words))
    row = np.zeros(other + 1)
    for k, n in got.items():
        row[other if k is None else k] += n
    return row / max(1, len(words))


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """Characters in words, symbols, repeated lines, and words in windows of three that repeat."""
    word_chars = len(text) - sum(text.count(c) for c in "\x20\x09\x0a\x0b\x0c\x0d")
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip("\x20\x09\x0b\x0c\x0d")]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        found = Counter(windows)
        end = 0
        for at, window in enumerate(windows):
            if found[window] > 1:
                repeated += at + 3 - max(at, end)
                end = at + 3
    return word_chars, symbols, len(lines) - len(set(lines)), repeated


def assess(text: str, classes: np.ndarray, refs: dict[str, Reference], rules: QualityRules) -> tuple:
    """Counts, verdict and distances of one text, in the order of :data:`COLUMNS`."""
    words = ascii_words(text)
    counts = base_counts(text, words)
    n = len(words)
    failed = n < rules.min_words or 100 * counts[3] > rules.max_repeat_percent * n
    by_class = by_word = None
    if refs and len(text) >= rules.min_chars_compared:
        shares = classes / classes.sum()
        by_class = min(js_distance(shares, r.classes) for r in refs.values())
    if refs and n >= rules.min_words_compared:
        plain = plain_words(words)
        by_word = min(js_distance(word_histogram(plain, r), r.shares) for r in refs.values())
    far = (by_class is not None and by_class > rules.max_class_distance) or (
        by_word is not None and by_word > rules.max_word_distance + rules.word_slack / np.sqrt(n)
    )
    return (n, *counts, failed, not failed and not bool(far), by_class, by_word)


COLUMNS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean",
    "class_distance": "double", "word_distance": "double",
}


def judge(
    documents: DataFrame,
    refs: dict[str, Reference],
    rules: QualityRules,
    text: str = "text",
    into: str = "quality",
) -> DataFrame:
    """The rows with counts, distances and verdict of a text column added as one struct.

    A null text has no words and fails the word minimum. Distances are null where a text is too
    short to compare or there is no reference; then they reject nothing. Equal rows get equal
    verdicts; other columns pass through unread.
    """

    @F.pandas_udf(", ".join(f"{n} {t}" for n, t in COLUMNS.items()))
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        of = class_table()
        for batch in batches:
            given = [t if isinstance(t, str) else "" for t in batch]
            counts = class_counts(given, of) if given else []
            rows = [assess(t, c, refs, rules) for t, c in zip(given, counts, strict=True)]
            yield pd.DataFrame(rows, columns=list(COLUMNS))

    return documents.withColumn(into, verdicts(F.col(text).cast("string")))


def keep_good(documents: DataFrame, rules: QualityRules | None = None) -> DataFrame:
    """The rows that pass, with all their columns and no others."""
    rules = rules or QualityRules()
    judged = judge(documents, references(documents, rules), rules, into="_quality_verdict")
    return judged.filter("_quality_verdict.kept").drop("_quality_verdict")
