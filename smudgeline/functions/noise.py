"""The fourteen noise functions.

Each takes ``(text, base)``, where ``base`` comes from :func:`draws.base`, and returns
``STRUCT<text STRING, step STRING>``. Texts too short or odd for a function come back
unchanged with the step still named; null stays null. All of it is built-in expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cache
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .draws import mixed, pick, spot
from .exprs import bind, head, ints_literal, part, replace_first, tail, upto, words_literal

# slots of one base: single draws first, then one range per use of a position
COUNT, PLACE, SIDE, LEFT, RIGHT, WORD = 0, 1, 2, 3, 4, 5
AT = 16
ALT = 1_000_000

MARK = "\u0001"
ALNUM = "[A-Za-z0-9]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"

Body = Callable[[Column, Column], Column]


def _result(name: str, text: Column, base: Column, body: Body) -> Column:
    new = bind(text, lambda t: bind(base, lambda b: F.coalesce(body(t, b), t)))
    return F.struct(new.alias("text"), F.lit(name).alias("step"))


def _choose(
    chars: Column,
    b: Column,
    hit: Callable[[Column], Column],
    k: Callable[[Column], Column],
    new: Callable[[Column, Column, Column], Column],
) -> Column:
    """Rebuild a text with ``k`` of its hits chosen by draw.

    ``new(c, i, is_chosen)`` gives what stands in place of each character; ``k`` takes the
    number of hits. The chosen hits are those of the k highest draws.
    """
    spots = F.transform(chars, lambda c, i: F.when(hit(c), spot(b, i + AT)))
    return bind(
        F.transform(spots, mixed),
        lambda hits: bind(
            F.get(F.sort_array(hits, asc=False), k(F.size(F.array_compact(hits))) - 1),
            lambda cut: F.array_join(
                F.transform(chars, lambda c, i: new(c, i, F.get(hits, i) >= cut)), ""
            ),
        ),
    )


def _marks(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit(MARK), F.lit("")))


def _before_mark(marked: Column, nth: Column) -> Column:
    """Characters before the nth mark, counted from one."""
    return F.length(F.call_function("substring_index", marked, F.lit(MARK), nth))


def _times(most: Column, b: Column) -> Column:
    """``[1, ..., k]`` for a drawn k between 1 and ``most``; empty when most is below one."""
    return bind(most, lambda m: F.when(m >= 1, upto(pick(b, COUNT, m) + 1)).otherwise(upto(F.lit(0))))


def _int(value: Column) -> Column:
    return F.floor(value).cast("int")


# --- positions chosen k of n -------------------------------------------------


def change_case(text: Column, base: Column, max_share: float = 1.0) -> Column:
    """Flip the case of a random share of the letters, at least one."""
    letter = r"\p{L}"

    def flipped(c: Column) -> Column:
        is_lower = (c == F.lower(c)) & (c != F.upper(c))
        return F.when(is_lower, F.upper(c)).otherwise(F.lower(c))

    def body(t: Column, b: Column) -> Column:
        share = pick(b, COUNT, int(round(max_share * 1000)) + 1)
        return bind(
            F.split(t, ""),
            lambda cs: _choose(
                cs,
                b,
                lambda c: c.rlike(letter),
                lambda n: F.greatest(_int(share * n / 1000), F.lit(1)),
                lambda c, i, is_chosen: F.when(is_chosen, flipped(c)).otherwise(c),
            ),
        )

    return _result("change_case", text, base, body)


def step_label(name: str, legacy_label: bool = False, **_) -> str:
    """What a step writes, which is its name but for the older label of removed vowels."""
    older = legacy_label and name == "randomly_remove_vowels"
    return "randomly_replace_vowels" if older else name


def remove_vowels(text: Column, base: Column, legacy_label: bool = False) -> Column:
    """Drop 1 to all of the vowels."""

    def body(t: Column, b: Column) -> Column:
        return bind(
            F.split(t, ""),
            lambda cs: _choose(
                cs,
                b,
                lambda c: F.call_function("instr", F.lit("AEIOUaeiou"), c) > 0,
                lambda n: pick(b, COUNT, n) + 1,
                lambda c, i, is_chosen: F.when(is_chosen, "").otherwise(c),
            ),
        )

    return _result(step_label("randomly_remove_vowels", legacy_label), text, base, body)


def replace_spaces(
    text: Column, base: Column, substitutes: list[str] | None = None
) -> Column:
    """Turn 1 to all of the spaces into a listed character; a listed space means none."""
    subs = substitutes or lx.SPACE_SUBSTITUTES

    def body(t: Column, b: Column) -> Column:
        table = words_literal(subs)

        def swapped(i: Column) -> Column:
            sub = F.get(table, pick(b, i + ALT, len(subs)))
            return F.when(sub == " ", "").otherwise(sub)

        return bind(
            F.split(t, ""),
            lambda cs: _choose(
                cs,
                b,
                lambda c: c == " ",
                lambda n: pick(b, COUNT, n) + 1,
                lambda c, i, is_chosen: F.when(is_chosen, swapped(i)).otherwise(c),
            ),
        )

    return _result("randomly_replace_spaces", text, base, body)


def add_special(
    text: Column, base: Column, max_len: int = 70, max_share: float = 0.1
) -> Column:
    """Insert 1 to K special characters at random places.

    Inserting one after another at random makes every interleaving equally likely, so the
    final places are drawn at once: k of the n + k.
    """
    table = words_literal(lx.SEPARATORS)

    def body(t: Column, b: Column) -> Column:
        n = F.length(t)
        most = F.greatest(F.lit(max_len) - n, _int(n * F.lit(max_share)))

        def placed(k: Column) -> Column:
            spots = F.transform(upto(n + k), lambda i: spot(b, i + AT))
            # a draw has 31 bits and a place has no more: one long orders as the pair does
            slots = F.transform(spots, lambda x, i: mixed(x) * (1 << 32) + i + 1)
            places = F.sort_array(
                F.transform(F.slice(F.sort_array(slots), F.lit(1), k), lambda v: (v % (1 << 32)).cast("int"))
            )
            return bind(
                places,
                lambda at: F.concat(
                    F.array_join(
                        F.transform(
                            at,
                            lambda p, j: bind(
                                F.when(j > 0, F.get(at, j - 1) - j).otherwise(F.lit(0)),
                                lambda before: F.concat(
                                    part(t, before + 1, p - j - 1 - before),
                                    F.get(table, pick(b, j + ALT, len(lx.SEPARATORS))),
                                ),
                            ),
                        ),
                        "",
                    ),
                    tail(t, F.get(at, k - 1) - k + 1),
                ),
            )

        return F.when(most < 1, t).otherwise(bind(pick(b, COUNT, most) + 1, placed))

    return _result("add_special_characters", text, base, body)


# --- one draw of a place -----------------------------------------------------


def repeat_part(
    text: Column, base: Column, max_insert: int = 7, max_len: int | None = None
) -> Column:
    """Copy a short slice back in at a place inside itself.

    The character at that place is doubled too. ``max_len`` leaves longer results out.
    """

    def body(t: Column, b: Column) -> Column:
        n = F.length(t)

        def spliced(first: Column, last: Column, at: Column) -> Column:
            return F.concat(head(t, at + 1), part(t, first + 1, last - first), tail(t, at + 1))

        new = bind(
            pick(b, PLACE, n),
            lambda first: bind(
                F.least(first + pick(b, COUNT, max_insert + 1), n - 1),
                lambda last: spliced(first, last, first + pick(b, SIDE, last - first + 1)),
            ),
        )
        fits = F.lit(True) if max_len is None else F.length(new) <= max_len
        return F.when((n >= 1) & fits, new)

    return _result("repeat_part_of_address", text, base, body)


def add_random_text(text: Column, base: Column, max_len: int = 70) -> Column:
    """Insert random letters and digits, with up to two separators around them."""
    table = words_literal(lx.SEPARATORS)

    def separator(b: Column, slot: int) -> Column:
        return F.get(table, pick(b, slot, len(lx.SEPARATORS)))

    def body(t: Column, b: Column) -> Column:
        n = F.length(t)
        room = F.lit(max_len) - n
        at = pick(b, PLACE, n + 1)

        def inserted(size: Column) -> Column:
            spare = room - size
            on_left = pick(b, SIDE, 2) == 0
            left = F.when((spare >= 2) | ((spare == 1) & on_left), separator(b, LEFT))
            right = F.when((spare >= 2) | ((spare == 1) & ~on_left), separator(b, RIGHT))
            noise = F.transform(
                upto(size),
                lambda i: part(F.lit(ALPHABET), pick(b, i + AT, len(ALPHABET)) + 1, 1),
            )
            return F.concat(
                head(t, at + 1), F.coalesce(left, F.lit("")), F.array_join(noise, ""),
                F.coalesce(right, F.lit("")), tail(t, at + 2),
            )

        return F.when(room >= 1, bind(pick(b, COUNT, room + 1) + 1, inserted))

    return _result("add_random_text", text, base, body)


@cache
def _word_tables(words: tuple[str, ...], max_len: int) -> tuple[list[str], list[int], list[int]]:
    """Initials, where each starts in ``words``, and how many of each are at most L long."""
    initials = sorted({w[0] for w in words})
    starts = [next(i for i, w in enumerate(words) if w[0] == c) for c in initials]
    counts = []
    for c in initials:
        lengths = [len(w) for w in words if w[0] == c]
        counts += list(accumulate(lengths.count(n) for n in range(max_len + 1)))
    return initials, starts, counts


def insert_random_word(
    text: Column,
    base: Column,
    words: tuple[str, ...] | None = None,
    max_len: int = 70,
    whole_word: bool = False,
) -> Column:
    """Append a separator and a word that fits; "no word" is always one of the options.

    A word may be used when its first letter is not in the line. ``whole_word`` asks instead
    that the word itself is not in the line. Words are counted per initial and length, so a
    draw walks the initials and not the list.
    """
    words = tuple(sorted(set(words or lx.word_list()), key=lambda w: (w[0], len(w), w)))

    def by_initial(t: Column, b: Column) -> Column:
        initials, starts, counts = _word_tables(words, max_len)
        room = F.greatest(F.lit(max_len) - F.length(t) - 1, F.lit(0))
        letters, firsts, sizes = words_literal(initials), ints_literal(starts), ints_literal(counts)
        low = F.lower(t)
        free = F.filter(
            F.sequence(F.lit(0), F.lit(len(initials) - 1)),
            lambda i: ~F.contains(low, F.lower(F.get(letters, i))),
        )
        fitting = F.transform(
            free, lambda i: F.struct(i.alias("i"), F.get(sizes, i * (max_len + 1) + room).alias("n"))
        )

        def walk(options: Column) -> Column:
            total = F.aggregate(options, F.lit(0), lambda acc, o: acc + o["n"])
            # a negative state is the chosen word, stored as -(index + 1)
            left = F.aggregate(
                options,
                pick(b, WORD, total + 1),
                lambda s, o: F.when(s < 0, s)
                .when(s < o["n"], -(F.get(firsts, o["i"]) + s) - 1)
                .otherwise(s - o["n"]),
            )
            return bind(left, lambda s: F.get(words_literal(list(words)), -s - 1))

        return bind(fitting, walk)

    def by_word(t: Column, b: Column) -> Column:
        room = F.lit(max_len) - F.length(t) - 1
        free = F.filter(
            words_literal(list(words)),
            lambda w: (F.length(w) <= room) & ~F.contains(F.lower(t), F.lower(w)),
        )
        return bind(free, lambda ws: F.get(ws, pick(b, WORD, F.size(ws) + 1)))

    def body(t: Column, b: Column) -> Column:
        separator = F.get(words_literal(lx.SEPARATORS), pick(b, LEFT, len(lx.SEPARATORS)))
        return F.concat(t, separator, (by_word if whole_word else by_initial)(t, b))

    return _result("insert_random_words", text, base, body)


# --- texts that change as draws go on ----------------------------------------


def replace_char(
    text: Column,
    base: Column,
    table: dict[str, list[str]] | None = None,
    max_share: float = 0.5,
) -> Column:
    """Swap 1 to half of the letters and digits, one at a time, for look-alikes."""
    table = table or lx.lookalikes()
    keys = "".join(table)
    sizes = [len(v) for v in table.values()]
    starts = [0, *accumulate(sizes)][:-1]

    def swap(b: Column, s: Column, i: Column, marked: Column, n: Column) -> Column:
        at = _before_mark(marked, pick(b, i + AT, n) + 1) + 1

        def swapped(p: Column) -> Column:
            key = F.call_function("instr", F.lit(keys), F.upper(part(s, p, 1))) - 1
            alts = words_literal([a for v in table.values() for a in v])
            return bind(
                key,
                lambda j: F.concat(
                    head(s, p - 1),
                    F.get(
                        alts,
                        F.get(ints_literal(starts), j)
                        + pick(b, i + ALT, F.get(ints_literal(sizes), j)),
                    ),
                    tail(s, p + 1),
                ),
            )

        return F.when(n > 0, F.coalesce(bind(at, swapped), s)).otherwise(s)

    def body(t: Column, b: Column) -> Column:
        most = _int(F.length(F.regexp_replace(t, "[^A-Za-z0-9]", "")) * F.lit(max_share))
        return F.aggregate(
            _times(most, b),
            t,
            lambda s, i: bind(
                F.regexp_replace(s, ALNUM, MARK),
                lambda marked: bind(_marks(marked), lambda n: swap(b, s, i, marked, n)),
            ),
        )

    return _result("replace_char", text, base, body)


def repeat_characters(
    text: Column,
    base: Column,
    max_share: float = 0.33333,
    max_copies: int = 7,
    max_len: int = 50,
) -> Column:
    """Stretch characters that have no copy of themselves close by, one at a time.

    Lines stay below ``max_len`` characters; one that is there already may grow by ``max_copies``.
    Places are drawn from the two at either end that qualify, then from the inner ones. Inner
    ones differ from the two characters before and after; one pattern marks each of them, at
    the place two before it.
    """
    inner = r"(?s)(.)(?=(.)(?!\1|\2)(.)(?!\3|.\3)..)"

    def at_ends(s: Column, n: Column) -> Column:
        """The 0-based places among the first and last two that qualify."""

        def differ(i: Column, j: Column) -> Column:
            return part(s, i + 1, 1) != part(s, j + 1, 1)

        first, second, last = F.lit(0), F.lit(1), n - 1
        near = last - 1
        rules = [
            (first, differ(first, second) & differ(first, F.lit(2))),
            (second, differ(second, F.lit(2)) & (differ(second, first) | differ(second, F.lit(3)))),
            (near, differ(near, near - 1) & (differ(near, last) | differ(near, near - 2))),
            (last, differ(last, near) & differ(last, near - 1)),
        ]
        return F.array_compact(F.array(*[F.when(ok, i) for i, ok in rules]))

    def stretched(b: Column, s: Column, i: Column, limit: Column) -> Column:
        n = F.length(s)
        room = limit - n
        copies = F.when(room <= max_copies, room).otherwise(pick(b, i + ALT, max_copies) + 1)

        def chosen(ends: Column, marked: Column) -> Column:
            nth = pick(b, i + AT, F.size(ends) + _marks(marked))
            return bind(
                nth,
                lambda r: F.coalesce(
                    F.get(ends, r),
                    F.when(
                        _marks(marked) > 0, _before_mark(marked, r - F.size(ends) + 1) + 2
                    ),
                ),
            )

        return bind(
            at_ends(s, n),
            lambda ends: bind(
                F.regexp_replace(s, inner, MARK),
                lambda marked: bind(
                    chosen(ends, marked),
                    lambda p: F.concat(
                        head(s, p), F.repeat(part(s, p + 1, 1), copies), tail(s, p + 2)
                    ),
                ),
            ),
        )

    def body(t: Column, b: Column) -> Column:
        long = F.length(t) >= max_len - 1
        limit = F.when(long, F.length(t) + max_copies + 1).otherwise(max_len)
        return F.aggregate(
            _times(_int(F.length(t) * F.lit(max_share)), b),
            t,
            # one free place means one copy of one character: nothing changes
            lambda s, i: F.when(F.length(s) >= limit - 1, s).otherwise(
                F.coalesce(stretched(b, s, i, limit), s)
            ),
        )

    return _result("repeat_characters", text, base, body)


# --- ordinals ----------------------------------------------------------------


def change_ordinals(text: Column, base: Column) -> Column:
    """Spell out the longest ordinal found, wherever it stands in upper case."""
    spellings = lx.ordinals()
    sizes = [len(v) for v in spellings.values()]
    starts = [0, *accumulate(sizes)][:-1]

    def suffix(n: Column) -> Column:
        return (
            F.when((n % 100).between(11, 13), "TH")
            .when(n % 10 == 1, "ST")
            .when(n % 10 == 2, "ND")
            .when(n % 10 == 3, "RD")
            .otherwise("TH")
        )

    def endings(found: Column) -> Column:
        """Ordinals a match such as 021ST ends with: 21ST and 1ST."""
        return F.filter(
            F.transform(F.sequence(F.lit(3), F.length(found)), lambda n: F.right(found, n)),
            lambda e: (part(e, 1, 1) != "0")
            & bind(
                F.regexp_substr(e, F.lit("^[0-9]+")).cast("int"),
                lambda n: (n <= lx.LAST_ORDINAL) & (F.right(e, F.lit(2)) == suffix(n)),
            ),
        )

    def body(t: Column, b: Column) -> Column:
        matches = F.regexp_extract_all(
            F.upper(t), F.lit("[0-9]{1,3}(?:ST|ND|RD|TH)"), F.lit(0)
        )
        options = F.transform(
            F.flatten(F.transform(matches, endings)),
            lambda e: F.struct(F.length(e).alias("n"), e.alias("key")),
        )

        def respelled(key: Column) -> Column:
            at = F.regexp_substr(key, F.lit("^[0-9]+")).cast("int") - 1
            alts = words_literal([a for v in spellings.values() for a in v])
            spelling = F.get(
                alts,
                F.get(ints_literal(starts), at) + pick(b, WORD, F.get(ints_literal(sizes), at)),
            )
            return F.replace(t, key, spelling)

        return bind(F.array_max(options)["key"], respelled)

    return _result("change_ordinal_numbers", text, base, body)


# --- directions --------------------------------------------------------------


def _direction_arrays() -> tuple[list[str], list[int], list[int]]:
    """All spellings in group order; start and size of the group of each."""
    flat, starts, sizes = [], [], []
    for variants in lx.directions().values():
        starts += [len(flat)] * len(variants)
        sizes += [len(variants)] * len(variants)
        flat += variants
    return flat, starts, sizes


def convert_directions(text: Column, base: Column) -> Column:
    """Rewrite mixed-case direction words; a form seen before is not chosen again."""

    def one_direction(original: Column, current: Column, b: Column, at: int, forms: list[str]):
        def seen(form: str) -> Column:
            if form in lx.NEVER_FOUND:
                return F.lit(False)
            return F.contains(original, F.lit(form if form in lx.FOUND_ANYWHERE else f" {form} "))

        padded = [f" {f} " for f in forms]
        found = F.array_compact(
            F.array(*[F.when(seen(f), F.lit(p)) for f, p in zip(forms, padded)])
        )

        def rewritten(fs: Column, s: Column, i: Column) -> Column:
            left = F.array_except(words_literal(padded), F.slice(fs, F.lit(1), i))
            return bind(
                left,
                lambda ls: F.coalesce(
                    replace_first(
                        s, F.get(fs, i - 1), F.get(ls, pick(b, i + (AT + 16 * at), F.size(ls)))
                    ),
                    s,
                ),
            )

        return bind(
            found,
            lambda fs: F.aggregate(
                upto(F.size(fs)), current, lambda s, i: rewritten(fs, s, i)
            ),
        )

    def body(t: Column, b: Column) -> Column:
        new = t
        for at, forms in enumerate(lx.MIXED_DIRECTIONS.values()):
            new = one_direction(t, new, b, at, forms)
        return new

    return _result("convert_cardinal_directions", text, base, body)


def change_directions(text: Column, base: Column) -> Column:
    """Rewrite every direction that follows a space, longest spelling first.

    One that ends the line gets a second space before it.
    """
    flat, starts, sizes = _direction_arrays()

    def body(t: Column, b: Column) -> Column:
        def where(word: Column) -> Column:
            return F.coalesce(F.array_position(words_literal(flat), word), F.lit(0)).cast("int")

        def other(position: Column, i: Column) -> Column:
            """Another spelling of the same group."""
            at = position - 1
            start = F.get(ints_literal(starts), at)
            nth = pick(b, i + AT, F.get(ints_literal(sizes), at) - 1)
            return F.get(
                words_literal(flat), start + nth + F.when(nth >= at - start, 1).otherwise(0)
            )

        def rewritten(ws: Column, pairs: Column, w: Column, i: Column) -> Column:
            last = F.size(ws) - 1
            single = F.when(i >= 1, where(w)).otherwise(F.lit(0))

            def placed(new: Column, end: Column) -> Column:
                return F.when(end == last, F.concat(F.lit(" "), new)).otherwise(new)

            return (
                F.when((i >= 2) & (F.get(pairs, i - 1) > 0), F.lit(None).cast("string"))
                .when(F.get(pairs, i) > 0, placed(other(F.get(pairs, i), i), i + 1))
                .otherwise(
                    bind(
                        single,
                        lambda p: F.when(p > 0, placed(other(p, i), i)).otherwise(w),
                    )
                )
            )

        def with_pairs(ws: Column) -> Column:
            pairs = F.transform(
                ws,
                lambda w, i: F.when(
                    (i >= 1) & (i + 1 < F.size(ws)),
                    where(F.concat(w, F.lit(" "), F.get(ws, i + 1))),
                ).otherwise(F.lit(0)),
            )
            return bind(
                pairs,
                lambda ps: F.array_join(F.transform(ws, lambda w, i: rewritten(ws, ps, w, i)), " "),
            )

        return bind(F.split(t, " "), with_pairs)

    return _result("change_cardinal_directions", text, base, body)


def _holds_direction(t: Column) -> Column:
    """Whether a spelling stands between two spaces, in any case."""
    flat, _, _ = _direction_arrays()
    return bind(
        F.split(F.upper(t), " "),
        lambda ws: F.exists(
            F.slice(ws, F.lit(2), F.greatest(F.size(ws) - 2, F.lit(0))),
            lambda w: F.array_contains(words_literal(flat), w),
        ),
    )


def insert_random_directions(
    text: Column, base: Column, skip_if_present: bool = False
) -> Column:
    """Insert directions before 1 to all of the spaces, the end counting as one."""
    flat, _, _ = _direction_arrays()

    def body(t: Column, b: Column) -> Column:
        def spelled(i: Column) -> Column:
            word = F.get(words_literal(flat), pick(b, i + ALT, len(flat)))
            return F.concat(F.lit(" "), word)

        # a mark after the text stands for its end
        spots = F.when(F.endswith(t, F.lit(" ")), t).otherwise(F.concat(t, F.lit(MARK)))

        def put(c: Column, i: Column, is_chosen: Column) -> Column:
            return F.concat(
                F.when(is_chosen, spelled(i)).otherwise(F.lit("")),
                F.when(c == MARK, "").otherwise(c),
            )

        def inserted(cs: Column) -> Column:
            return _choose(
                cs,
                b,
                lambda c: (c == " ") | (c == MARK),
                lambda n: pick(b, COUNT, n) + 1,
                put,
            )

        new = F.when(F.length(t) >= 1, bind(F.split(spots, ""), inserted))
        return F.when(_holds_direction(t), t).otherwise(new) if skip_if_present else new

    return _result("insert_random_cardinal_directions", text, base, body)


def insert_direction(text: Column, base: Column) -> Column:
    """Add one direction to a line that has none: at the start, the end or a space."""
    flat, _, _ = _direction_arrays()

    def body(t: Column, b: Column) -> Column:
        padded = F.concat(
            F.lit(" "), F.get(words_literal(flat), pick(b, WORD, len(flat))), F.lit(" ")
        )

        def inserted(option: Column) -> Column:
            def at_space(before: Column) -> Column:
                return F.concat(
                    before, F.lit(" "), padded, F.lit(" "), tail(t, F.length(before) + 2)
                )

            return (
                F.when(option == 0, F.concat(padded, F.lit(" "), t))
                .when(option == 1, F.concat(t, F.lit(" "), padded))
                .otherwise(
                    bind(
                        F.call_function("substring_index", t, F.lit(" "), option - 1), at_space
                    )
                )
            )

        choice = pick(b, PLACE, F.regexp_count(t, F.lit(" ")) + 2)
        return F.when(~_holds_direction(t), bind(choice, inserted))

    return _result("insert_cardinal_directions", text, base, body)


# The names written to the data, in the order the grid runs their functions.
STEPS: dict[str, Callable[[Column, Column], Column]] = {
    "replace_char": replace_char,
    "repeat_characters": repeat_characters,
    "repeat_part_of_address": repeat_part,
    "insert_random_words": insert_random_word,
    "add_random_text": add_random_text,
    "convert_cardinal_directions": convert_directions,
    "change_case": change_case,
    "add_special_characters": add_special,
    "change_ordinal_numbers": change_ordinals,
    "change_cardinal_directions": change_directions,
    "insert_random_cardinal_directions": insert_random_directions,
    "randomly_remove_vowels": remove_vowels,
    "randomly_replace_spaces": replace_spaces,
    "insert_cardinal_directions": insert_direction,
}

#: the steps of the default grid: all but the last
GRID_STEPS = list(STEPS)[:-1]
