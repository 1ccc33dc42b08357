"""Word, direction, ordinal and look-alike tables, built by rule.

Python lists here are small and bounded; the DataFrame forms and the array literals used by
the noise functions are both derived from them.
"""

from __future__ import annotations

import string
import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters put between a line and what is added to it.
SEPARATORS = [" ", "-", "_", ":", ".", ",", "/", "!", "?", "(", ")", "[", "]", "{", "}", "|", "@"]

# What a space may become; " " means the space goes, "]" has double weight.
SPACE_SUBSTITUTES = [
    "`", "~", "@", "#", "$", "%", "^", "&", "*", "(", ")", "_", "+", "=", "-", "{",
    "}", "|", ":", "<", ">", "?", "/", ".", ",", "'", ";", "\\", "]", "[", "]", " ",
]

# characters that may stand for any letter: all ASCII punctuation
WILDCARDS = list(string.punctuation)

# Spellings of the four directions, and what joins two of them.
NORTHS = ["N", "NORTH", "NTH", "NRTH", "NOTH"]
SOUTHS = ["S", "SOUTH", "STH", "SOTH"]
EASTS = ["E", "EAST", "EST"]
WESTS = ["W", "WEST", "WST"]
JOINERS = [" ", ""]

# Mixed-case spellings of the four directions.
MIXED_DIRECTIONS = {
    "North": ["North", "N", "Nrth", "N."],
    "South": ["South", "S", "Sth", "S."],
    "East": ["East", "E", "Est", "E."],
    "West": ["West", "W", "Wst", "W."],
}
# Spellings found without spaces around them; "Est" is never looked for.
FOUND_ANYWHERE = {"North", "South", "Sth", "East", "West", "Wst"}
NEVER_FOUND = {"Est"}

# Two digits and the fraction glyph they may become.
FRACTIONS = {
    "03": "↉", "12": "½", "13": "⅓", "14": "¼", "15": "⅕", "16": "⅙", "17": "⅐",
    "18": "⅛", "19": "⅑", "23": "⅔", "25": "⅖", "35": "⅗", "45": "⅘",
}

KEYS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ1234567890"
DIRECTION_GROUPS = ["N", "S", "E", "W", "NW", "NE", "SW", "SE"]
LAST_ORDINAL = 760

UNITS = (
    "ZERO ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN TWELVE THIRTEEN FOURTEEN "
    "FIFTEEN SIXTEEN SEVENTEEN EIGHTEEN NINETEEN"
).split()
TENS = "TEN TWENTY THIRTY FORTY FIFTY SIXTY SEVENTY EIGHTY NINETY".split()
IRREGULAR = {"ONE": "FIRST", "TWO": "SECOND", "THREE": "THIRD", "FIVE": "FIFTH",
             "EIGHT": "EIGHTH", "NINE": "NINTH", "TWELVE": "TWELFTH"}


# --- ordinals ---------------------------------------------------------------


def ordinal_suffix(n: int) -> str:
    if n % 100 in (11, 12, 13):
        return "TH"
    return {1: "ST", 2: "ND", 3: "RD"}.get(n % 10, "TH")


def ordinal_key(n: int) -> str:
    return f"{n}{ordinal_suffix(n)}"


def ordinal_word(n: int) -> str:
    """The word for 1 to 99."""
    if n < 20:
        word = UNITS[n]
        return IRREGULAR.get(word, word + "TH")
    tens, rest = TENS[n // 10 - 1], n % 10
    return f"{tens} {ordinal_word(rest)}" if rest else tens[:-1] + "IETH"


def ordinal_spellings(n: int) -> list[str]:
    """Upper-case spellings of 1 to 999, plain words first."""
    hundreds, rest = divmod(n, 100)
    if not hundreds:
        if 14 <= n <= 19:
            return [ordinal_word(n), f"{n - 10} TEENTH"]
        if n > 20 and n % 10:
            return [ordinal_word(n), f"{TENS[n // 10 - 1]} {ordinal_key(n % 10)}"]
        return [ordinal_word(n)]
    leads = [f"{UNITS[hundreds]} HUNDRED", f"{hundreds} HUNDRED"]
    if not rest:
        return [lead + "TH" for lead in leads]
    if rest > 20 and rest % 10:
        tails = [ordinal_word(rest), f"{TENS[rest // 10 - 1]} {ordinal_key(rest % 10)}"]
        return [f"{a} {b}" for a in leads for b in tails] + [
            f"{a} {ordinal_key(rest)}" for a in leads
        ]
    return [f"{a} {b}" for a in leads for b in (ordinal_word(rest), ordinal_key(rest))]


@lru_cache
def ordinals() -> dict[str, list[str]]:
    """``"21ST"`` to its spellings, 1 to LAST_ORDINAL."""
    return {ordinal_key(n): ordinal_spellings(n) for n in range(1, LAST_ORDINAL + 1)}


# --- directions -------------------------------------------------------------


@lru_cache
def directions() -> dict[str, list[str]]:
    """Group to its spellings, without the padding spaces, sorted."""
    groups = {"N": set(NORTHS), "S": set(SOUTHS), "E": set(EASTS), "W": set(WESTS)}
    for first, heads in (("N", NORTHS), ("S", SOUTHS)):
        for second, tails in (("W", WESTS), ("E", EASTS)):
            groups[first + second] = {a + j + b for a in heads for b in tails for j in JOINERS}
    return {g: sorted(groups[g]) for g in DIRECTION_GROUPS}


# --- look-alikes ------------------------------------------------------------

#: first code points of alphabets that hold A-Z, then a-z
_TWO_CASE_ALPHABETS = [
    (0x1D400, 0x1D41A), (0x1D434, 0x1D44E), (0x1D468, 0x1D482), (0x1D4D0, 0x1D4EA),
    (0x1D538, 0x1D552), (0x1D56C, 0x1D586), (0x1D5A0, 0x1D5BA), (0x1D5D4, 0x1D5EE),
    (0x1D608, 0x1D622), (0x1D63C, 0x1D656), (0x1D670, 0x1D68A), (0xFF21, 0xFF41),
    (0x24B6, 0x24D0),
]
#: alphabets of one case only
_ONE_CASE_ALPHABETS = [0x1F130, 0x1F150, 0x1F170, 0x1F1E6, 0x249C, 0x1F110]
#: first code points of digit rows that start at zero
_DIGIT_ROWS = [
    0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6, 0xFF10, 0x2080, 0x0660, 0x06F0, 0x0966,
    0x09E6, 0x0A66, 0x0AE6, 0x0C66, 0x0CE6, 0x0D66, 0x0E50, 0x0ED0, 0x0F20, 0x1040, 0x17E0,
]
#: first code points of digit rows that start at one
_COUNTING_ROWS = [0x2460, 0x2474, 0x2488, 0x2776, 0x2780, 0x278A, 0x2160, 0x2170]
#: marks drawn over or under a letter
_OVERLAYS = [0x0332, 0x0333, 0x0335, 0x0336, 0x0337, 0x0338, 0x0353, 0x033D, 0x0305, 0x033F]
#: blocks searched for letters with marks
_MARKED_BLOCKS = [(0x00C0, 0x0250), (0x1E00, 0x1F00)]
#: drawn with keyboard characters
_DRAWN = {
    "A": ["4", "/\\", "/-\\", "^"], "B": ["8", "13", "|3"], "C": ["(", "<"], "D": ["|)", "|]"],
    "E": ["3"], "F": ["|=", "PH"], "G": ["6", "9"], "H": ["|-|", "#"], "I": ["1", "|", "!"],
    "J": ["_|"], "K": ["|<", "|{"], "L": ["1", "|_"], "M": ["|\\/|", "/V\\"], "N": ["|\\|", "/V"],
    "O": ["0", "()"], "P": ["|>", "|D"], "Q": ["0,", "(,)"], "R": ["|2", "12"], "S": ["5", "$"],
    "T": ["7", "+"], "U": ["|_|", "V"], "V": ["\\/", "U"], "W": ["\\/\\/", "VV"], "X": ["><", "%"],
    "Y": ["`/", "J"], "Z": ["2", "7_"], "1": ["I", "l", "|"], "2": ["Z"], "3": ["E"], "4": ["A"],
    "5": ["S"], "6": ["G", "b"], "7": ["T"], "8": ["B"], "9": ["g", "q"], "0": ["O", "o"],
}


def _assigned(code: int) -> bool:
    return unicodedata.category(chr(code)) != "Cn"


@lru_cache
def _marked_letters() -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for first, stop in _MARKED_BLOCKS:
        for code in range(first, stop):
            plain = unicodedata.normalize("NFD", chr(code))
            if len(plain) > 1 and plain[0].isascii() and plain[0].isalpha():
                found.setdefault(plain[0].upper(), []).append(chr(code))
    return found


@lru_cache
def lookalikes() -> dict[str, list[str]]:
    """Key character to its stand-ins, distinct and sorted."""
    table: dict[str, list[str]] = {}
    for key in KEYS:
        alts = {key, *_DRAWN.get(key, [])}
        if key.isalpha():
            at = ord(key) - ord("A")
            alts |= {key.lower(), *WILDCARDS, *_marked_letters().get(key, [])}
            codes = [c + at for pair in _TWO_CASE_ALPHABETS for c in pair]
            codes += [c + at for c in _ONE_CASE_ALPHABETS]
            alts |= {c + chr(m) for c in (key, key.lower()) for m in _OVERLAYS}
        else:
            digit = int(key)
            codes = [row + digit for row in _DIGIT_ROWS]
            codes += [row + digit - 1 for row in _COUNTING_ROWS] if digit else [0x24EA, 0x24FF]
            alts |= {UNITS[digit].lower(), *(key + chr(m) for m in _OVERLAYS)}
        table[key] = sorted(alts | {chr(c) for c in codes if _assigned(c)})
    return table


# --- words ------------------------------------------------------------------

_TOPICS = {
    "month": ["JANUARY", "FEBRUARY", "MARCH", "APRIL", "MAY", "JUNE", "JULY", "AUGUST", "SEPTEMBER",
              "OCTOBER", "NOVEMBER", "DECEMBER"],
    "weekday": ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"],
    "planet": ["MERCURY", "VENUS", "EARTH", "MARS", "JUPITER", "SATURN", "URANUS", "NEPTUNE"],
    "element": ["HYDROGEN", "HELIUM", "CARBON", "NITROGEN", "OXYGEN", "IRON", "COPPER", "ZINC", "SILVER",
                "TIN", "GOLD", "LEAD", "XENON"],
    "spelling": ["ALFA", "BRAVO", "CHARLIE", "DELTA", "ECHO", "FOXTROT", "GOLF", "HOTEL", "INDIA",
                 "JULIETT", "KILO", "LIMA", "MIKE", "NOVEMBER", "OSCAR", "PAPA", "QUEBEC", "ROMEO",
                 "SIERRA", "TANGO", "UNIFORM", "VICTOR", "WHISKEY", "XRAY", "YANKEE", "ZULU"],
    "tree": ["ALDER", "ASH", "BEECH", "ELM", "FIR", "HAZEL", "LARCH", "MAPLE", "PINE", "ROWAN", "YEW"],
}
_NUMBERED = ["BERTH", "BLOCK", "CABIN", "DOCK", "HANGAR", "LOCKER", "PIER", "STALL", "WING"]
LAST_NUMBERED = 150


def _letter_codes() -> list[str]:
    letters = [chr(c) for c in range(ord("A"), ord("Z") + 1)]
    return letters + ["A" + c for c in letters]


@lru_cache
def words() -> dict[str, list[str]]:
    """Category to upper-case words: short lists plus numbered and lettered templates."""
    table = {k: list(v) for k, v in _TOPICS.items()}
    for noun in _NUMBERED:
        table[noun.lower()] = [f"{noun} {n}" for n in range(1, LAST_NUMBERED + 1)] + [
            f"{noun} {c}" for c in _letter_codes()
        ]
    return table


@lru_cache
def word_list() -> tuple[str, ...]:
    """All distinct words, by first letter, then length, then spelling."""
    flat = {w for ws in words().values() for w in ws}
    return tuple(sorted(flat, key=lambda w: (w[0], len(w), w)))


# --- DataFrame forms --------------------------------------------------------


def direction_table(spark: SparkSession) -> DataFrame:
    """(dir_group, variant), variants padded with one space on both sides."""
    rows = [(g, f" {v} ") for g, vs in directions().items() for v in vs]
    return spark.createDataFrame(rows, "dir_group STRING, variant STRING")


def ordinal_table(spark: SparkSession) -> DataFrame:
    """(ordinal, alts)."""
    return spark.createDataFrame(list(ordinals().items()), "ordinal STRING, alts ARRAY<STRING>")


def lookalike_table(spark: SparkSession) -> DataFrame:
    """(ch, alts)."""
    return spark.createDataFrame(list(lookalikes().items()), "ch STRING, alts ARRAY<STRING>")


def word_table(spark: SparkSession) -> DataFrame:
    """(word, category)."""
    rows = [(w, c) for c, ws in words().items() for w in ws]
    return spark.createDataFrame(rows, "word STRING, category STRING")


def fraction_table(spark: SparkSession) -> DataFrame:
    """(digits, glyph)."""
    return spark.createDataFrame(list(FRACTIONS.items()), "digits STRING, glyph STRING")


def merge_tables(first: DataFrame, later: DataFrame, *keys: str) -> DataFrame:
    """Rows of two tables by key; the later table wins, and of its repeats the highest row."""
    rest = [c for c in first.columns if c not in keys]
    rows = first.select(*keys, F.struct(F.lit(0).alias("_side"), *rest).alias("_row")).unionByName(
        later.select(*keys, F.struct(F.lit(1).alias("_side"), *rest).alias("_row"))
    )
    best = rows.groupBy(*keys).agg(F.max("_row").alias("_row"))
    return best.select(*keys, *[F.col("_row")[c].alias(c) for c in rest])
