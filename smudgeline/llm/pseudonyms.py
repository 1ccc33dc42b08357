"""Personal data as format-preserving pseudonyms: keyed Feistel permutations, in Spark expressions.

Payment cards (13 to 19 digits, check digit right, also beside other groups of digits), telephone
numbers (North American, and any with + and a country code), social security numbers, IPv4 addresses and
dates that exist are permuted within their format: a real value becomes a real one (cards keep their issuer
and get their check digit), equal values stay equal in all documents, and no two values meet. Names
in e-mail addresses have no fixed format; they become a keyed code, with the domain kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: dates of 270 x 270 days from this one on are permuted among themselves
DATE_START, DATE_SIDE = "1900-01-01", 270

#: tried where a run of name characters begins, or where the last find ended, so long runs are read once
EMAIL = r"(?:\G|(?<![\p{L}\p{N}._%+-]))[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
DATE = (
    r"(?<![\w.-])(?:\d{4}-\d{2}-\d{2}(?=[Tt_]\d{2})"
    r"|(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\w-]|[./]\w))"
)
IPV4 = r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"
#: with an area code in brackets, by + and country code (7 to 15 digits), and plain
PHONE = (
    r"(?<!\w)\+?1[ .-]?\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w+])\+(?!\d+\.\d+(?:[\s,;]|$))[1-9](?:(?:[ .-]|[ .-]?\(|\)[ .-]?)?\d){6,14}(?!\w)"
    r"|(?<![\w.+-])(?:1[.-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4})(?![\w-]|\.\d)"
    r"|(?<![\w.+-])(?<!\d )(?:1[ -])?[2-9]\d{2}[ -][2-9]\d{2}[ -]\d{4}(?![\w-]|\.\d| \d)"
)
#: country codes of one and two digits; all others have three
SHORT_CODES = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_GROUP = r"\d++(?![A-Za-z_]|\.\d|-(?!\d))"
#: a whole run of digit groups, of whatever length, with 13 digits at least
CARD = rf"(?<![\w.-])(?=\d(?:[ -]?\d){{12}}){_GROUP}(?:[ -]{_GROUP})*+"
#: how cards are written; asked of groups of digits that do not begin their run
CARD_SHAPE = (
    r"^(?=[3-6]|2[2-7])(?:\d{13,19}|\d{8}[ -]\d{8}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,4}(?:\1\d{1,3})?"
    r"|\d{4}([ -])\d{6}\2\d{4,5})$"
)
ANY = "|".join(f"(?:{p})" for p in (EMAIL, DATE, IPV4, PHONE, SSN, CARD))
#: a cheap look for what any of these must hold
HINT = r"@|\d\.\d|\d\)|\d{2}[-/]\d{2}|\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d[ -]?\d"


def let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def keyed(key: str, tweak: str, *parts: Column) -> Column:
    """60 bits of a keyed hash, as a long."""
    code = F.sha2(F.concat_ws("|", F.lit(f"{key}|{tweak}"), *(p.cast("string") for p in parts)), 256)
    return F.conv(F.substring(code, 1, 15), 16, 10).cast("long")


def feistel(
    value: Column, left: int | Column, right: int | Column, key: str, tweak: str, *parts: Column
) -> Column:
    """A keyed permutation of the numbers below ``left * right``.

    The value is a pair of digits in bases ``left`` and ``right``; each round adds a keyed hash
    of one digit to the other, which can be taken off again, so no two values meet. Even rounds
    move the left digit and odd ones the right. ``parts`` go into the hash.
    """
    left, right = (F.lit(x).cast("long") if isinstance(x, int) else x for x in (left, right))
    start = F.struct(((value - value % right) / right).cast("long").alias("a"), (value % right).alias("b"))

    def turn(at: Column, r: Column) -> Column:
        a, b = at["a"], at["b"]
        return F.when(
            r % 2 == 0,
            F.struct(((a + keyed(key, tweak, r, b, *parts)) % left).alias("a"), b.alias("b")),
        ).otherwise(F.struct(a.alias("a"), ((b + keyed(key, tweak, r, a, *parts)) % right).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda at: at["a"] * right + at["b"])


def padded(number: Column, width: Column | int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def check_digit(payload: Column) -> Column:
    """The digit that makes a card number's weighted sum a multiple of ten."""
    doubled = F.transform(
        F.split(F.reverse(payload), ""),
        lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2).otherwise(c.cast("int")),
    )
    total = F.aggregate(doubled, F.lit(0), lambda s, d: s + F.when(d > 9, d - 9).otherwise(d))
    return ((10 - total % 10) % 10).cast("string")


def into_places(pattern: Column, digits: Column) -> Column:
    """New digits in the places of the old ones; everything between them stays."""
    return let(
        digits,
        lambda new: F.aggregate(
            F.split(pattern, ""),
            F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
            lambda s, c: F.when(
                c.rlike("[0-9]"),
                F.struct(F.concat(s["out"], F.substring(new, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
            ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
            lambda s: s["out"],
        ),
    )


def power_of_ten(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), "0").cast("long")


def permute_digits(digits: Column, key: str, tweak: str, *parts: Column) -> Column:
    """A permutation of digit strings of one length, up to 18 digits; another one for other ``parts``."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    return padded(feistel(digits.cast("long"), power_of_ten(n - half), power_of_ten(half), key, tweak, *parts), n)


def permute_north_american(digits: Column, key: str) -> Column:
    """A permutation of ten digits under which real numbers stay real.

    Area code and exchange begin with 2 to 9: 800 x 800 x 10,000 numbers, moved among themselves; the
    others, 200 x 1,000 x 10,000 by area code and 800 x 200 x 10,000 by exchange, likewise.
    """
    area, exchange, line = (F.substring(digits, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))

    def joined(area: Column, exchange: Column, line: Column) -> Column:
        return F.concat(padded(area, 3), padded(exchange, 3), padded(line, 4))

    def parts(n: Column, exchanges: int) -> tuple[Column, Column, Column]:
        line = n % 10_000
        rest = (n - line) / 10_000
        return F.floor(rest / exchanges), rest.cast("long") % exchanges, line

    def real(n: Column) -> Column:
        a, e, k = parts(n, 800)
        return joined(a + 200, e + 200, k)

    def unreal(n: Column) -> Column:
        by_area, by_exchange = parts(n, 1000), parts(n - 2_000_000_000, 200)
        return F.when(n < 2_000_000_000, joined(*by_area)).otherwise(
            joined(by_exchange[0] + 200, by_exchange[1], by_exchange[2])
        )

    index = ((area - 200) * 800 + exchange - 200) * 10_000 + line
    other = F.when(area < 200, (area * 1000 + exchange) * 10_000 + line).otherwise(
        2_000_000_000 + ((area - 200) * 200 + exchange) * 10_000 + line
    )
    return F.when(
        (area >= 200) & (exchange >= 200), let(feistel(index, 80_000, 80_000, key, "phone"), real)
    ).otherwise(let(feistel(other, 60_000, 60_000, key, "phone"), unreal))


def is_card(written: Column) -> Column:
    """Whether 13 to 19 digits end with their check digit."""
    return let(
        digits_of(written),
        lambda digits: F.length(digits).between(13, 19)
        & (check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.substring(digits, -1, 1)),
    )


def new_card(written: Column, key: str) -> Column:
    """The issuer's first six digits stay, the account is permuted and the check digit made anew."""

    def of(digits: Column) -> Column:
        issuer = F.substring(digits, 1, 6)
        account = F.substring(digits, F.lit(7), F.length(digits) - 7)
        # the issuer is part of the key: equal accounts of two issuers do not show as equal
        new = let(permute_digits(account, key, "card", issuer), lambda n: F.concat(issuer, n))
        return into_places(written, let(new, lambda n: F.concat(n, check_digit(n))))

    return let(digits_of(written), of)


def card(found: Column, key: str) -> Column:
    """The cards of a run of digit groups: at each group the longest valid one that starts there.

    Groups within a run must look like a card besides, so tables of numbers stay.
    """

    def of(groups: Column) -> Column:  # each with the mark before it
        n = F.size(groups)

        def joined(start: Column, count: Column) -> Column:
            return F.array_join(F.slice(groups, start, count), "")

        def longest(at: Column, free: Column) -> Column:
            """Groups of the longest card from one on; 0 for none."""

            def fits(count: Column) -> Column:
                written = F.regexp_replace(joined(at, count), "^[ -]", "")
                return is_card(written) & (free | written.rlike(CARD_SHAPE))

            counts = F.sequence(F.lit(1), F.least(n - at + 1, F.lit(19)))
            return F.coalesce(F.array_max(F.filter(counts, fits)), F.lit(0))

        def step(s: Column, at: Column) -> Column:
            def taken(count: Column) -> Column:
                whole = joined(at, count)
                mark = F.regexp_extract(whole, "^[ -]?", 0)
                new = F.concat(mark, new_card(F.regexp_replace(whole, "^[ -]", ""), key))
                return F.when(
                    count > 0, F.struct(F.concat(s["out"], new).alias("out"), (at + count).alias("next"))
                ).otherwise(F.struct(F.concat(s["out"], F.get(groups, at - 1)).alias("out"), s["next"].alias("next")))

            # right at the start or after a card any grouping will do
            return F.when(at < s["next"], s).otherwise(let(longest(at, at == s["next"]), taken))

        start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["out"])

    return let(F.regexp_extract_all(found, F.lit(r"[ -]?\d+"), F.lit(0)), of)


def phone(found: Column, key: str) -> Column:
    """The country code stays and so does a bracketed 0; the digits after it are permuted."""
    trunk = F.regexp_replace(found, r"\(0\)", "(\u0001)")

    def of(digits: Column) -> Column:
        by_plan = F.when(digits.rlike(SHORT_CODES), F.length(F.regexp_extract(digits, SHORT_CODES, 0))).otherwise(3)
        size = F.when(found.startswith("+"), by_plan).otherwise(F.length(digits) - 10)
        code = F.substring(digits, F.lit(1), size)
        rest = F.substring(digits, size + 1, F.length(digits))
        american = (F.length(rest) == 10) & code.isin("", "1")
        new = F.when(american, permute_north_american(rest, key)).otherwise(permute_digits(rest, key, "phone"))
        return into_places(trunk, F.concat(code, new))

    return F.replace(let(digits_of(trunk), of), F.lit("\u0001"), F.lit("0"))


def ssn(found: Column, key: str) -> Column:
    """Numbers that can be given out are moved among themselves; all others stay."""
    digits = digits_of(found)
    area, group, serial = (F.substring(digits, at, n).cast("long") for at, n in ((1, 3), (4, 2), (6, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    # areas 000, 666 and 9xx do not exist, nor do group 00 and serial 0000
    at = area - F.when(area > 666, 2).otherwise(1)
    number = (at * 99 + group - 1) * 9_999 + serial - 1

    def written(new: Column) -> Column:
        last = new % 9_999
        rest = ((new - last) / 9_999).cast("long")
        index = F.floor(rest / 99)
        back = index + F.when(index >= 665, 2).otherwise(1)
        return F.concat(padded(back, 3), padded(rest % 99 + 1, 2), padded(last + 1, 4))

    new = let(feistel(number, 898, 99 * 9_999, key, "ssn"), written)
    return F.when(valid, into_places(found, new)).otherwise(found)


def ipv4(found: Column, key: str) -> Column:
    parts = F.transform(F.split(found, r"\."), lambda p: p.cast("int"))
    valid = F.forall(parts, lambda p: p < 256)
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda s, p: s * 256 + p)
    quad = let(
        feistel(number, 65536, 65536, key, "ipv4"),
        lambda new: F.concat_ws(
            ".", *(F.shiftright(new, 8 * k).bitwiseAND(F.lit(255)).cast("string") for k in (3, 2, 1, 0))
        ),
    )
    return F.when(valid, quad).otherwise(found)


def date(found: Column, key: str) -> Column:
    """Dates as year-month-day or day, month and year with points or strokes.

    With strokes a month above twelve is read the other way round.
    """
    iso = found.rlike("^[0-9]{4}")
    mark = F.substring(found, 3, 1)
    first, second = F.substring(found, 1, 2), F.substring(found, 4, 2)
    swapped = ~iso & (mark == "/") & (second.cast("int") > 12)
    day, month = F.when(swapped, second).otherwise(first), F.when(swapped, first).otherwise(second)
    text = F.when(iso, found).otherwise(F.concat_ws("-", F.substring(found, 7, 4), month, day))
    at = F.datediff(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"), F.lit(DATE_START).cast("date"))
    valid = (at >= 0) & (at < DATE_SIDE**2)

    def written(new: Column) -> Column:
        d, m, y = (F.date_format(new, p) for p in ("dd", "MM", "yyyy"))
        other = F.concat(F.when(swapped, m).otherwise(d), mark, F.when(swapped, d).otherwise(m), mark, y)
        return F.when(iso, F.date_format(new, "yyyy-MM-dd")).otherwise(other)

    moved = feistel(at.cast("long"), DATE_SIDE, DATE_SIDE, key, "date").cast("int")
    new = let(F.date_add(F.lit(DATE_START).cast("date"), moved), written)
    return F.when(F.coalesce(valid, F.lit(False)), new).otherwise(found)


def email(found: Column, key: str) -> Column:
    """The name becomes a keyed code; names that differ in case only stay one."""
    name = F.lower(F.substring_index(found, "@", 1))
    code = padded(keyed(key, "email", name, F.lower(F.substring_index(found, "@", -1))), 19)
    return F.concat(F.lit("user"), code, F.lit("@"), F.substring_index(found, "@", -1))


def pseudonym(found: Column, key: str) -> Column:
    """The pseudonym of one found value; a value that fails its check stays."""
    return (
        F.when(found.contains("@"), email(found, key))
        .when(found.rlike(f"^(?:{IPV4})$"), ipv4(found, key))
        .when(found.rlike(f"^(?:{DATE})$"), date(found, key))
        .when(found.rlike(f"^(?:{PHONE})$"), phone(found, key))
        .when(found.rlike(f"^(?:{SSN})$"), ssn(found, key))
        .otherwise(card(found, key))
    )


def pseudonymise(text: Column, key: str) -> Column:
    """A text with all personal values replaced; null stays null, other characters stay."""
    found = F.regexp_extract_all(text, F.lit(f"({ANY})"), F.lit(1))
    new = F.transform(found, lambda v: pseudonym(v, key))
    pieces = F.zip_with(F.split(text, ANY, -1), new, lambda gap, v: F.concat(gap, F.coalesce(v, F.lit(""))))
    joined = F.array_join(pieces, "")
    return F.when(text.rlike(HINT), joined).otherwise(text)


def pseudonymise_documents(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The rows with their text replaced, other columns as they are.

    Narrow: no shuffle, no Python. Null and empty texts stay; equal values get equal pseudonyms
    in every row, so rows that repeat stay equal. The key must be kept: with it values can be
    permuted back.
    """
    return documents.withColumn(text, pseudonymise(F.col(text).cast("string"), key))
