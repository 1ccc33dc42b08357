"""The same queries as SQL another engine can run on the same tables.

The noise functions are written relationally here (rows of characters, ranks, recursive
steps), not as the array expressions the library uses, so that the two check each other.
"""

from __future__ import annotations

from ..functions import lexicons as lx
from ..functions.draws import PRIME, STRIDE
from ..functions.noise import ALPHABET, GRID_STEPS
from ..operators.augment import NOISY, STEPS
from . import registered as r

SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def draw(at: str, slot: str | int) -> str:
    return (
        f"list_transform([({at} + ({slot})::BIGINT * {STRIDE}) % {PRIME}], "
        f"lambda z: z * ((z * z) % {PRIME}) % {PRIME})[1]"
    )


def pick(at: str, slot: str | int, n: str | int) -> str:
    return f"({draw(at, slot)} % greatest(({n})::BIGINT, 1))"


def base(*parts: str) -> str:
    text = "concat_ws('|', " + ", ".join([f"'{r.SEED}'", *parts]) + ")"
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT % {PRIME})"


def duck(text: str) -> str:
    return text.replace("CAST(floor(p_partkey / 16) AS INT)", "CAST(p_partkey // 16 AS INT)")


def lines_cte(text: str = r.LINE) -> str:
    return f"lines AS (SELECT p_partkey AS line_id, {duck(text)} AS first_line, p_type AS st FROM part)"


def source_cte(text: str = r.LINE) -> str:
    """``src(rid, b, t)``: what a noise query reads."""
    return (
        f"{lines_cte(text)}, src AS (SELECT line_id AS rid, {base('line_id', '1', '0')} AS b, "
        f"first_line AS t FROM lines)"
    )


CHARS = (
    "SELECT rid, b, t, i, substr(t, i::INT, 1) AS c FROM {src}, "
    "unnest(range(1, length(t) + 1)) AS u(i)"
)


def ranked_hits(src: str, hit: str) -> str:
    """Characters with ``v`` for the hits, their rank by draw and their number."""
    return (
        f"SELECT *, row_number() OVER (PARTITION BY rid, v ORDER BY d DESC) AS rk, "
        f"sum(v::INT) OVER (PARTITION BY rid) AS nv FROM (SELECT *, coalesce({hit}, false) AS v, "
        f"{draw('b', 'i + 15')} AS d FROM ({CHARS.format(src=src)}))"
    )


def vowels(src: str) -> str:
    hit = "c IN ('A', 'E', 'I', 'O', 'U', 'a', 'e', 'i', 'o', 'u')"
    return (
        f"SELECT rid, coalesce(string_agg(CASE WHEN v AND rk <= 1 + {pick('b', 0, 'nv')} THEN '' "
        f"ELSE c END, '' ORDER BY i), '') AS text FROM ({ranked_hits(src, hit)}) GROUP BY rid"
    )


def spaces(src: str) -> str:
    subs = sql_list(lx.SPACE_SUBSTITUTES)
    sub = f"{subs}[{pick('b', 'i - 1 + 1000000', len(lx.SPACE_SUBSTITUTES))} + 1]"
    sub = f"CASE WHEN {sub} = ' ' THEN '' ELSE {sub} END"
    hit = "c = ' '"
    return (
        f"SELECT rid, string_agg(CASE WHEN v AND rk <= 1 + {pick('b', 0, 'nv')} THEN {sub} "
        f"ELSE c END, '' ORDER BY i) AS text FROM ({ranked_hits(src, hit)}) GROUP BY rid"
    )


def case_flip(src: str, permille: int) -> str:
    hit = "regexp_matches(c, '[A-Za-z]')"
    k = f"greatest(floor({pick('b', 0, permille + 1)} * nv / 1000.0), 1)"
    flip = "CASE WHEN c = lower(c) THEN upper(c) ELSE lower(c) END"
    return (
        f"SELECT rid, string_agg(CASE WHEN v AND rk <= {k} THEN {flip} ELSE c END, '' ORDER BY i) "
        f"AS text FROM ({ranked_hits(src, hit)}) GROUP BY rid"
    )


def specials(src: str) -> str:
    chars = sql_list(lx.SEPARATORS)
    char = f"{chars}[{pick('b', 'j - 1 + 1000000', len(lx.SEPARATORS))} + 1]"
    most = "greatest(70 - length(t), floor(length(t) * 0.1::DOUBLE)::BIGINT)"
    return (
        f"SELECT rid, string_agg(CASE WHEN s THEN {char} ELSE substr(t, (i - j)::INT, 1) END, '' ORDER BY i) AS text "
        f"FROM (SELECT *, sum(s::INT) OVER (PARTITION BY rid ORDER BY i) AS j FROM ("
        f"SELECT *, row_number() OVER (PARTITION BY rid ORDER BY {draw('b', 'i + 16')}) <= k AS s FROM ("
        f"SELECT rid, b, t, k, i FROM (SELECT *, 1 + {pick('b', 0, most)} AS k FROM {src}), "
        f"unnest(range(1, length(t) + k + 1)) AS u(i)))) GROUP BY rid"
    )


def part_again(src: str) -> str:
    return (
        "SELECT rid, substr(t, 1, p + 1) || substr(t, f + 1, e - f) || substr(t, p + 1) AS text FROM ("
        f"SELECT *, (f + {pick('b', 2, 'e - f + 1')})::INT AS p FROM ("
        f"SELECT *, least(f + {pick('b', 0, 8)}, length(t) - 1)::INT AS e FROM ("
        f"SELECT *, {pick('b', 1, 'length(t)')}::INT AS f FROM {src})))"
    )


def random_text(src: str) -> str:
    seps, n = sql_list(lx.SEPARATORS), len(lx.SEPARATORS)
    noise = (
        "array_to_string(list_transform(range(1, size + 1), lambda i: "
        f"substr('{ALPHABET}', ({pick('b', 'i + 16', 62)} + 1)::INT, 1)), '')"
    )
    left, right = (f"{seps}[{pick('b', s, n)} + 1]" for s in (3, 4))
    return (
        "SELECT rid, substr(t, 1, p + 1) || CASE WHEN spare >= 2 OR (spare = 1 AND side = 0) THEN "
        f"{left} ELSE '' END || {noise} || CASE WHEN spare >= 2 OR (spare = 1 AND side = 1) THEN "
        f"{right} ELSE '' END || substr(t, p + 2) AS text FROM (SELECT *, 70 - length(t) - size AS spare "
        f"FROM (SELECT *, 1 + {pick('b', 0, '71 - length(t)')} AS size, {pick('b', 2, 2)} AS side, "
        f"{pick('b', 1, 'length(t) + 1')}::INT AS p FROM {src}))"
    )


def word(src: str, whole: bool = False) -> str:
    seps, n = sql_list(lx.SEPARATORS), len(lx.SEPARATORS)
    absent = "w" if whole else "w[1]"
    options = (
        f"list_filter({sql_list(lx.word_list())}, lambda w: length(w) <= 69 - length(t) "
        f"AND NOT contains(lower(t), lower({absent})))"
    )
    return (
        f"SELECT rid, coalesce(t || {seps}[{pick('b', 3, n)} + 1] || o[{pick('b', 5, 'len(o) + 1')} + 1], t) "
        f"AS text FROM (SELECT *, {options} AS o FROM {src})"
    )


def lookalike(src_cte: str) -> str:
    table = "MAP {" + ", ".join(f"{quoted(k)}: {sql_list(v)}" for k, v in lx.lookalikes().items()) + "}"
    return f"""WITH RECURSIVE {src_cte}, alts AS (SELECT unnest(map_entries({table})) AS e),
      look AS (SELECT e.key AS ch, e.value AS vs FROM alts),
      start AS (SELECT rid, b, t, 1 + {pick('b', 0, "floor(length(regexp_replace(t, '[^A-Za-z0-9]', '', 'g')) * 0.5)")} AS k FROM src),
      walk AS (
        SELECT rid, b, k, 0 AS i, t AS s FROM start
        UNION ALL
        SELECT rid, b, k, i + 1, substr(s, 1, p - 1) || vs[{pick('b', 'i + 1 + 1000000', 'len(vs)')} + 1] || substr(s, p + 1)
        FROM (SELECT *, list_filter(range(1, length(s) + 1), lambda x: regexp_matches(substr(s, x::INT, 1), '[A-Za-z0-9]')) AS ps FROM walk) w,
          LATERAL (SELECT ps[{pick('b', 'i + 1 + 16', 'len(ps)')} + 1]::INT AS p) q
          JOIN look ON look.ch = upper(substr(s, p, 1))
        WHERE i < k)
      SELECT rid AS line_id, s AS text, 'replace_char' AS step FROM walk WHERE i = k"""


def stretched(src_cte: str) -> str:
    def ne(offset: int) -> str:
        return f"substr(s, x::INT, 1) <> substr(s, (x + {offset})::INT, 1)"

    inner = f"{ne(-1)} AND {ne(1)} AND {ne(-2)} AND {ne(2)}"
    ends = (
        f"CASE WHEN x = 1 THEN {ne(1)} AND {ne(2)} WHEN x = 2 THEN {ne(1)} AND ({ne(-1)} OR {ne(2)}) "
        f"WHEN x = n THEN {ne(-1)} AND {ne(-2)} ELSE {ne(-1)} AND ({ne(1)} OR {ne(-2)}) END"
    )
    places = (
        f"list_concat(list_filter([1, 2, n - 1, n], lambda x: {ends}), "
        f"list_filter(range(3, n - 1), lambda x: {inner}))"
    )
    return f"""WITH RECURSIVE {src_cte},
      start AS (SELECT rid, b, t, 1 + {pick('b', 0, 'floor(length(t) * 0.33333::DOUBLE)')} AS k FROM src),
      walk AS (
        SELECT rid, b, k, 0 AS i, t AS s FROM start
        UNION ALL
        SELECT rid, b, k, i + 1, CASE WHEN n >= 49 OR len(ps) = 0 THEN s ELSE
          substr(s, 1, p - 1) || repeat(substr(s, p, 1), CASE WHEN 50 - n <= 7 THEN 50 - n ELSE 1 + {pick('b', 'i + 1 + 1000000', 7)} END) || substr(s, p + 1) END
        FROM (SELECT *, ps[{pick('b', 'i + 1 + 16', 'len(ps)')} + 1]::INT AS p FROM (
          SELECT *, {places} AS ps FROM (
            SELECT *, length(s) AS n FROM walk)))
        WHERE i < k)
      SELECT rid AS line_id, s AS text, 'repeat_characters' AS step FROM walk WHERE i = k"""


def ordinal_words(src: str) -> str:
    table = "MAP {" + ", ".join(f"{quoted(k)}: {sql_list(v)}" for k, v in lx.ordinals().items()) + "}"
    return (
        f"SELECT rid, CASE WHEN key IS NULL THEN t ELSE replace(t, key, (m[key])[{pick('b', 5, 'len(m[key])')} + 1]) END AS text "
        f"FROM (SELECT *, list_filter(map_keys(m), lambda x: contains(upper(t), x)) AS ks, "
        f"list_reduce(list_transform(ks, lambda x: lpad(length(x)::VARCHAR, 2, '0') || x), lambda x, y: greatest(x, y), '')[3:] AS key0, "
        f"CASE WHEN key0 = '' THEN NULL ELSE key0 END AS key FROM (SELECT *, {table} AS m FROM {src}))"
    )


def mixed_directions(src_cte: str) -> str:
    rows = []
    for d, forms in enumerate(lx.MIXED_DIRECTIONS.values()):
        for f in forms:
            looked = f if f in lx.FOUND_ANYWHERE else f" {f} "
            found = "false" if f in lx.NEVER_FOUND else "true"
            rows.append(f"({len(rows)}, {d}, {quoted(f' {f} ')}, {quoted(looked)}, {found})")
    return f"""WITH RECURSIVE {src_cte}, forms(j, d, form, looked, ok) AS (VALUES {', '.join(rows)}),
      walk AS (
        SELECT rid, b, t, 0 AS j, t AS s FROM src
        UNION ALL
        SELECT rid, b, t, j + 1, CASE WHEN nth = 0 OR len(free) = 0 OR instr(s, form) = 0 THEN s ELSE
          substr(s, 1, instr(s, form)::INT - 1) || free[{pick('b', 'nth + 16 + 16 * d', 'len(free)')} + 1] || substr(s, (instr(s, form) + length(form))::INT) END
        FROM (SELECT w.*, f.d, f.form,
            CASE WHEN f.ok AND contains(w.t, f.looked) THEN len(list_filter(a.ls, lambda x: x.ok AND x.d = f.d AND x.j <= f.j AND contains(w.t, x.looked))) ELSE 0 END AS nth,
            list_transform(list_filter(a.ls, lambda x: x.d = f.d AND NOT (x.ok AND x.j <= f.j AND contains(w.t, x.looked))), lambda x: x.form) AS free
          FROM walk w JOIN forms f ON f.j = w.j, (SELECT list(forms ORDER BY j) AS ls FROM forms) a))
      SELECT rid AS line_id, s AS text, 'convert_cardinal_directions' AS step FROM walk WHERE j = 16"""


def direction_rows() -> str:
    rows = []
    for g, vs in lx.directions().items():
        for at, v in enumerate(vs):
            rows.append(f"({len(rows)}, {quoted(g)}, {at}, {len(vs)}, {quoted(v)})")
    return f"dirs(n, g, nr, size, v) AS (VALUES {', '.join(rows)})"


N_DIRS = sum(len(v) for v in lx.directions().values())
ALL_DIRS = sql_list([v for vs in lx.directions().values() for v in vs])


def other_directions(src_cte: str) -> str:
    nth = f"{pick('b', 'i + 16', 'size - 1')}"
    return f"""WITH {src_cte}, {direction_rows()},
      ws AS (SELECT rid, b, i - 1 AS i, w[i] AS w, w[i + 1] AS nx, len(w) AS n FROM (SELECT *, string_split(t, ' ') AS w FROM src), unnest(range(1, len(w) + 1)) AS u(i)),
      hit AS (SELECT ws.*, p.n IS NOT NULL AND i >= 1 AS pair, s.n IS NOT NULL AND i >= 1 AS single,
        coalesce(p.g, s.g) AS g, coalesce(p.nr, s.nr) AS nr, coalesce(p.size, s.size) AS size
        FROM ws LEFT JOIN dirs p ON ws.w || ' ' || ws.nx = p.v LEFT JOIN dirs s ON ws.w = s.v),
      marked AS (SELECT *, coalesce(lag(pair) OVER (PARTITION BY rid ORDER BY i), false) AS gone FROM hit),
      named AS (SELECT *, CASE WHEN pair OR single THEN {nth} + CASE WHEN {nth} >= nr THEN 1 ELSE 0 END END AS pos FROM marked)
      SELECT rid AS line_id, string_agg(CASE WHEN gone THEN NULL WHEN pos IS NULL THEN w
          WHEN i + pair::INT = named.n - 1 THEN ' ' || dirs.v ELSE dirs.v END, ' ' ORDER BY i) AS text,
        'change_cardinal_directions' AS step
      FROM named LEFT JOIN dirs ON dirs.g = named.g AND dirs.nr = named.pos GROUP BY rid"""


def has_direction(t: str) -> str:
    return (
        f"len(list_filter(string_split(upper({t}), ' ')[2:-2], lambda w: list_contains({ALL_DIRS}, w))) > 0"
    )


def new_directions(src: str, guard: bool = False) -> str:
    marked = f"(SELECT rid, b, CASE WHEN t LIKE '% ' THEN t ELSE t || chr(1) END AS t FROM {src})"
    hit = "c = ' ' OR c = chr(1)"
    name = f"' ' || {ALL_DIRS}[{pick('b', 'i - 1 + 1000000', N_DIRS)} + 1]"
    made = (
        f"SELECT rid, string_agg(CASE WHEN v AND rk <= 1 + {pick('b', 0, 'nv')} THEN {name} ELSE '' END "
        f"|| CASE WHEN c = chr(1) THEN '' ELSE c END, '' ORDER BY i) AS text "
        f"FROM ({ranked_hits(marked, hit)}) GROUP BY rid"
    )
    if not guard:
        return made
    return f"SELECT rid, CASE WHEN {has_direction('t')} THEN t ELSE m.text END AS text FROM ({made}) m JOIN {src} USING (rid)"


def one_direction(src: str) -> str:
    padded = f"(' ' || {ALL_DIRS}[{pick('b', 5, N_DIRS)} + 1] || ' ')"
    n = "(length(t) - length(replace(t, ' ', '')))"
    return (
        f"SELECT rid, CASE WHEN {has_direction('t')} THEN t WHEN o = 0 THEN p || ' ' || t WHEN o = 1 THEN t || ' ' || p "
        f"ELSE array_to_string(string_split(t, ' ')[1:o - 1], ' ') || ' ' || p || ' ' || array_to_string(string_split(t, ' ')[o:], ' ') END AS text "
        f"FROM (SELECT *, {padded} AS p, {pick('b', 1, n + ' + 2')} AS o FROM {src})"
    )


def noise_query(body: str, step: str, text: str = r.LINE) -> str:
    return f"WITH {source_cte(text)} SELECT rid AS line_id, text, '{step}' AS step FROM ({body})"


SQL |= {
    "noise_replace_char": lookalike(source_cte()),
    "noise_repeat_characters": stretched(source_cte()),
    "noise_repeat_part": noise_query(part_again("src"), "repeat_part_of_address"),
    "noise_insert_random_word": noise_query(word("src"), "insert_random_words"),
    "noise_insert_absent_word": noise_query(word("src", True), "insert_random_words"),
    "noise_add_random_text": noise_query(random_text("src"), "add_random_text"),
    "noise_convert_directions": mixed_directions(source_cte(r.MIXED_LINE)),
    "noise_change_case": noise_query(case_flip("src", 1000), "change_case"),
    "noise_change_half_case": noise_query(case_flip("src", 500), "change_case"),
    "noise_add_special": noise_query(specials("src"), "add_special_characters"),
    "noise_change_ordinals": noise_query(ordinal_words("src"), "change_ordinal_numbers"),
    "noise_change_directions": other_directions(source_cte()),
    "noise_insert_random_directions": noise_query(
        new_directions("src"), "insert_random_cardinal_directions"
    ),
    "noise_insert_directions_if_absent": noise_query(
        new_directions("src", True), "insert_random_cardinal_directions"
    ),
    "noise_remove_vowels": noise_query(vowels("src"), "randomly_remove_vowels"),
    "noise_replace_spaces": noise_query(spaces("src"), "randomly_replace_spaces"),
    "noise_insert_direction": noise_query(one_direction("src"), "insert_cardinal_directions"),
}


# --- the small noisy table ---------------------------------------------------


def noisy_cte(lines: str = "lines", plans: int = 3, iterations: int = r.ITERATIONS) -> str:
    """``noisy(row_id, line_id, first_line, st, NOISY, STEPS, n_steps)`` over ``lines``."""
    row = f"line_id * {plans * iterations} + plan_no * {iterations} + iteration - 1"
    keys = (
        f"grid AS (SELECT *, {row} AS row_id FROM {lines}, unnest(range(0, {plans})) AS p(plan_no), "
        f"unnest(range(1, {iterations + 1})) AS q(iteration))"
    )

    def src(name: str, frm: str, text: str, where: str, at: int) -> str:
        return (
            f"{name} AS (SELECT row_id AS rid, {base('line_id', 'iteration', str(at))} AS b, "
            f"{text} AS t FROM {frm} WHERE {where})"
        )

    ctes = [
        keys,
        src("a_src", "grid", "first_line", "plan_no IN (0, 2)", 0),
        f"a AS ({vowels('a_src')})",
        src("b_src", "grid", "first_line", "plan_no = 1", 0),
        f"b AS ({spaces('b_src')})",
        src("c_src", "grid JOIN a ON a.rid = row_id", "a.text", "plan_no = 2", 1),
        f"c AS ({spaces('c_src')})",
        f"noisy AS (SELECT grid.row_id, grid.line_id, grid.first_line, grid.st, "
        f"CASE plan_no WHEN 0 THEN a.text WHEN 1 THEN b.text ELSE c.text END AS {NOISY}, "
        f"CASE plan_no WHEN 0 THEN ', randomly_remove_vowels' WHEN 1 THEN ', randomly_replace_spaces' "
        f"ELSE ', randomly_remove_vowels, randomly_replace_spaces' END AS {STEPS}, "
        f"CASE plan_no WHEN 2 THEN 2 ELSE 1 END AS n_steps "
        f"FROM grid LEFT JOIN a ON a.rid = row_id LEFT JOIN b ON b.rid = row_id LEFT JOIN c ON c.rid = row_id)",
    ]
    return ", ".join(ctes)


NOISY_CTE = f"{lines_cte()}, {noisy_cte()}"
NAMES_CTE = (
    "lines AS (SELECT p_partkey AS line_id, upper(p_name) AS first_line, p_type AS st FROM part), "
    + noisy_cte(plans=2, iterations=1)
)


def on_noisy(body: str) -> str:
    return f"WITH {NOISY_CTE} {body}"


SQL |= {
    "apply_steps": (
        f"WITH {source_cte()}, one AS ({vowels('src')}), two AS (SELECT rid, "
        f"{base('rid', '1', '1')} AS b, text AS t FROM one) SELECT rid AS line_id, text AS {NOISY}, "
        f"', randomly_remove_vowels, randomly_replace_spaces' AS {STEPS} FROM ({spaces('two')})"
    ),
    "augment_grid": on_noisy(f"SELECT row_id, line_id, {NOISY}, {STEPS}, n_steps FROM noisy"),
    "augment_all_steps": (
        f"SELECT unnest({sql_list(GRID_STEPS)}) AS step, n AS n_rows, n AS n_lines "
        f"FROM (SELECT count(*) AS n FROM part)"
    ),
    "step_plans": (
        f"WITH s AS (SELECT unnest(range(0, {len(GRID_STEPS)})) AS i, unnest({sql_list(GRID_STEPS)}) AS step), "
        f"t AS (SELECT p_type AS st, count(*) AS n_rows FROM part GROUP BY 1) "
        f"SELECT st, a.step || ',' || b.step AS plan, n_rows FROM t, s a JOIN s b ON a.i < b.i"
    ),
    "step_permutations": (
        f"WITH s AS (SELECT unnest({sql_list(GRID_STEPS)}) AS step) SELECT a.step AS first_step, "
        f"count(*) AS n_plans, (count(*) * (SELECT count(*) FROM part))::BIGINT AS n_rows FROM s a JOIN s b ON b.step <> a.step "
        f"JOIN s c ON c.step NOT IN (a.step, b.step) GROUP BY 1"
    ),
    "sample_lines": (
        f"WITH {lines_cte()} SELECT line_id, first_line FROM lines ORDER BY {base('line_id')}, line_id LIMIT 1000"
    ),
    "add_working_column": (
        f"WITH {lines_cte()} SELECT line_id, first_line AS {NOISY}, '' AS {STEPS} FROM lines"
    ),
    "unpack_step": (
        f"WITH {source_cte()} SELECT rid AS line_id, text AS {NOISY}, ', randomly_remove_vowels' AS {STEPS} "
        f"FROM ({vowels('src')})"
    ),
}


# --- lexicons ----------------------------------------------------------------

WORDS_CTE = (
    f"{lines_cte()}, split_ AS (SELECT line_id, string_split(first_line, ' ') AS ws FROM lines), "
    "spoken AS (SELECT DISTINCT line_id, word FROM (SELECT line_id, unnest(ws) AS word FROM split_ UNION ALL "
    "SELECT line_id, ws[i] || ' ' || ws[i + 1] FROM split_, unnest(range(1, len(ws))) AS u(i))), "
    "uses AS (SELECT word, count(*) AS n_lines FROM spoken GROUP BY 1)"
)


def _units() -> str:
    return sql_list(lx.UNITS[1:])


def _values(pairs) -> str:
    return ", ".join("(" + ", ".join(quoted(v) for v in p) + ")" for p in pairs)


_SIDES = {
    side: ", ".join(f"({quoted(v)})" for v in vs)
    for side, vs in (("n", lx.NORTHS), ("s", lx.SOUTHS), ("e", lx.EASTS), ("w", lx.WESTS))
}
_FIRST_WORDS = sql_list([lx.ordinal_word(n) for n in range(1, 20)])
_TENS_WORDS = sql_list(lx.TENS)

SQL |= {
    "direction_variants": (
        f"WITH {WORDS_CTE}, " + ", ".join(f"{s}(v) AS (VALUES {v})" for s, v in _SIDES.items())
        + ", j(v) AS (VALUES (' '), ('')), made AS (SELECT 'N' AS g, v FROM n UNION ALL SELECT 'S', v FROM s "
        "UNION ALL SELECT 'E', v FROM e UNION ALL SELECT 'W', v FROM w "
        + "".join(
            f"UNION SELECT '{(a + b).upper()}', {a}.v || j.v || {b}.v FROM {a}, j, {b} "
            for a in "ns" for b in "we"
        )
        + ") SELECT g AS dir_group, ' ' || v || ' ' AS variant, coalesce(n_lines, 0) AS n_lines "
        "FROM made LEFT JOIN uses ON uses.word = made.v"
    ),
    "lookalike_table": (
        f"WITH {lines_cte()}, c AS (SELECT unnest(string_split(upper(first_line), '')) AS ch FROM lines), "
        "n AS (SELECT ch, count(*) AS n_uses FROM c GROUP BY 1), look(ch, alt) AS (VALUES "
        + _values((k, a) for k, v in lx.lookalikes().items() for a in v)
        + ") SELECT ch, n_uses, alt FROM n JOIN look USING (ch)"
    ),
    "ordinal_table": (
        f"WITH u AS (SELECT p_size AS n, concat(p_size, {r.SUFFIX}) AS ordinal, count(*) AS n_lines FROM part GROUP BY ALL), "
        f"k AS (SELECT {_FIRST_WORDS} AS f, {_TENS_WORDS} AS t), s AS (SELECT ordinal, n_lines, CASE "
        "WHEN n BETWEEN 14 AND 19 THEN [f[n], (n - 10)::VARCHAR || ' TEENTH'] WHEN n < 20 THEN [f[n]] "
        "WHEN n % 10 = 0 THEN [t[n // 10][:-2] || 'IETH'] ELSE [t[n // 10] || ' ' || f[n % 10], t[n // 10] || ' ' || "
        "(n % 10)::VARCHAR || CASE n % 10 WHEN 1 THEN 'ST' WHEN 2 THEN 'ND' WHEN 3 THEN 'RD' ELSE 'TH' END] END AS alts "
        "FROM u, k) SELECT ordinal, n_lines, (i - 1)::INT AS at, alts[i] AS alt FROM s, unnest(range(1, len(alts) + 1)) AS x(i)"
    ),
    "word_table": (
        f"WITH {WORDS_CTE}, t(word, category) AS (VALUES "
        + _values((w, c) for c, ws in lx.words().items() for w in ws)
        + ") SELECT t.word, category, coalesce(n_lines, 0) AS n_lines FROM t LEFT JOIN uses USING (word)"
    ),
    "fraction_glyphs": (
        f"WITH {lines_cte()} SELECT line_id, "
        + "replace(" * len(lx.FRACTIONS) + "first_line"
        + "".join(f", '{d}', '{g}')" for d, g in lx.FRACTIONS.items()) + " AS text FROM lines"
    ),
    "dedupe_alts": (
        f"WITH {lines_cte()}, c AS (SELECT DISTINCT line_id, unnest(string_split(first_line, '')) AS c FROM lines) "
        "SELECT line_id, string_agg(c, '' ORDER BY c) AS alts FROM c GROUP BY 1"
    ),
    "merge_maps": (
        f"WITH {lines_cte()}, w AS (SELECT line_id, string_split(first_line, ' ') AS ws FROM lines), "
        "a AS (SELECT word, min(line_id) AS v FROM w, unnest(ws) AS u(word) GROUP BY 1), "
        "b AS (SELECT ws[3] AS word, max(line_id) AS v FROM w WHERE len(ws) >= 3 GROUP BY 1) "
        "SELECT word, coalesce(b.v, a.v) AS value FROM a FULL JOIN b USING (word)"
    ),
}


# --- steps, filters, counts --------------------------------------------------

ODD = (
    "odd AS (SELECT p_partkey AS line_id, CASE p_partkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ', a' "
    "WHEN 3 THEN ', a, b' WHEN 4 THEN 'a,,b' WHEN 5 THEN ' , ' WHEN 6 THEN ', a, b, c' ELSE 'a' END "
    f"AS {STEPS} FROM part), seg AS (SELECT *, list_filter(list_transform(string_split(coalesce({STEPS}, ''), ','), "
    "lambda x: trim(x)), lambda x: x <> '') AS names FROM odd)"
)
ONE_COMMA = f"length({STEPS}) - length(replace({STEPS}, ',', '')) = 1"

for _kind in ("filter_steps", "filter_steps_sql"):
    SQL |= {
        f"{_kind}_none": f"WITH {ODD} SELECT line_id, {STEPS} FROM odd",
        f"{_kind}_one_comma": f"WITH {ODD} SELECT line_id, {STEPS} FROM odd WHERE {ONE_COMMA}",
        f"{_kind}_min": f"WITH {ODD} SELECT line_id, {STEPS} FROM seg WHERE len(names) >= 2",
        f"{_kind}_max": f"WITH {ODD} SELECT line_id, {STEPS} FROM seg WHERE len(names) <= 1",
    }

PER_LINE = "SELECT first_line, count(*) AS record_count FROM noisy GROUP BY 1"

SQL |= {
    "step_segments": (
        f"WITH {ODD} SELECT line_id, len(names)::INT AS n, array_to_string(names, '+') AS segments FROM seg"
    ),
    "keep_known": f"WITH {ODD} SELECT line_id, {STEPS} AS noisy FROM odd WHERE {STEPS} <> ''",
    "as_text": "SELECT p_partkey::VARCHAR AS key, p_size::VARCHAR AS text FROM part",
    "create_and_append_noisy": on_noisy(f"SELECT st, {STEPS}, count(*) AS n_rows FROM noisy GROUP BY ALL"),
    "read_noisy_table": on_noisy(f"SELECT row_id, {NOISY}, {STEPS} FROM noisy WHERE {ONE_COMMA}"),
    "read_noisy_parquet": on_noisy(f"SELECT row_id, {NOISY}, {STEPS} FROM noisy WHERE n_steps >= 2"),
    "temp_view": on_noisy(PER_LINE),
    "limit_rows": (
        "SELECT 'None' AS cap, count(*) AS n_rows FROM part UNION ALL SELECT '0', count(*) FROM part "
        "UNION ALL SELECT '100', least(count(*), 100) FROM part"
    ),
    "union_all": (
        f"SELECT unnest([', randomly_remove_vowels', ', randomly_replace_spaces']) AS {STEPS}, n AS n_rows "
        "FROM (SELECT count(*) AS n FROM part)"
    ),
    "step_distribution": on_noisy(f"SELECT {STEPS}, count(*) AS record_count FROM noisy GROUP BY 1"),
    "line_distribution": on_noisy(PER_LINE),
    "line_distribution_by_name": (
        "SELECT upper(p_name) AS first_line, count(*) AS record_count FROM part GROUP BY 1"
    ),
    "row_count": on_noisy("SELECT count(*) AS n_rows, count(DISTINCT first_line) AS n_originals FROM noisy"),
    "distinct_catalog": on_noisy(
        "SELECT row_number() OVER (ORDER BY first_line) - 1 AS cat_id, first_line AS canonical "
        "FROM (SELECT DISTINCT first_line FROM noisy)"
    ),
    "distinct_catalog_of_names": (
        "SELECT row_number() OVER (ORDER BY p_name) - 1 AS cat_id, p_name AS canonical "
        "FROM (SELECT DISTINCT p_name FROM part)"
    ),
    "catalog_lookup": (
        "WITH c AS (SELECT row_number() OVER (ORDER BY p_name) - 1 AS cat_id, p_name FROM "
        "(SELECT DISTINCT p_name FROM part)), a AS (SELECT p_partkey, p_name FROM part UNION ALL "
        "SELECT -s_suppkey - 1, s_name FROM supplier) "
        "SELECT p_partkey, p_name, cat_id FROM a LEFT JOIN c USING (p_name)"
    ),
    "rank_noisy": (
        f"WITH {NAMES_CTE} SELECT first_line AS canonical, {NOISY} AS noisy, row_id, "
        "row_number() OVER (PARTITION BY first_line ORDER BY row_id) AS place FROM noisy"
    ),
    "group_noisy": (
        f"WITH {NAMES_CTE}, p AS (SELECT *, row_number() OVER (PARTITION BY first_line ORDER BY row_id) AS place FROM noisy) "
        f"SELECT first_line AS canonical, ((place - 1) // 25)::INT AS part, count(*)::INT AS n, "
        f"string_agg({NOISY}, chr(10) ORDER BY place) AS texts FROM p GROUP BY ALL"
    ),
    "first_m_per_group": (
        f"WITH {NAMES_CTE} SELECT first_line AS canonical, {NOISY} AS noisy, "
        "row_number() OVER (PARTITION BY first_line ORDER BY row_id)::INT AS variant FROM noisy QUALIFY variant <= 5"
    ),
}


# --- cleaning and strings ----------------------------------------------------


def _squeezed(source: str) -> str:
    return (
        f"SELECT doc_id, string_agg(c, '' ORDER BY i) AS out FROM (SELECT *, lag(c) OVER w AS c1, lag(c, 2) OVER w AS c2 FROM ("
        f"SELECT doc_id, unnest(range(1, length(t) + 1)) AS i, unnest(string_split(t, '')) AS c FROM {source}) "
        f"WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE NOT (c = c1 AND c = c2) OR c1 IS NULL OR c2 IS NULL GROUP BY 1"
    )


_SPECIALS = "".join(lx.SEPARATORS)


def _spaced(text: str) -> str:
    return (
        f"trim(regexp_replace(translate({text}, '{_SPECIALS}', '{' ' * len(_SPECIALS)}'), ' +', ' ', 'g'), ' ')"
    )


SQL |= {
    "strip_combining": (
        "SELECT doc_id, length(o)::INT AS n, md5(o) AS digest FROM (SELECT doc_id, strip_accents(text) AS o FROM documents)"
    ),
    "squeeze_runs": (
        "WITH s AS (SELECT doc_id, text AS t FROM documents), q AS (" + _squeezed("s") + ") "
        "SELECT doc_id, length(out)::INT AS n, md5(out) AS digest FROM q"
    ),
    "specials_to_space": (
        f"SELECT doc_id, length(o)::INT AS n, md5(o) AS digest FROM (SELECT doc_id, {_spaced('text')} AS o FROM documents)"
    ),
    "clean_line": (
        "WITH s AS (SELECT doc_id, strip_accents(text) AS t FROM documents), q AS (" + _squeezed("s") + ") "
        f"SELECT doc_id, length(o)::INT AS n, md5(o) AS digest FROM (SELECT doc_id, {_spaced('out')} AS o FROM q)"
    ),
    "jaro_winkler": on_noisy(
        f"SELECT row_id, round(jaro_winkler_similarity(first_line, {NOISY}), 9) AS jw_score FROM noisy"
    ),
    "rank_prompt": on_noisy(
        f"SELECT row_id, 'match product:' || chr(10) || 'input: ' || {NOISY} || chr(10) || 'candidate: ' || first_line AS prompt FROM noisy"
    ),
    "run_stamp": (
        f"WITH {lines_cte()}, s AS (SELECT line_id, make_timestamp((1764739202 + line_id * 86461) * 1000000) AS a FROM lines) "
        "SELECT line_id, upper(strftime(a, '%d%b%Y_%H_%M_%S')) AS stamp, strftime(a, '%Y%m%d_%H%M%S') AS compact FROM s"
    ),
    "json_text": (
        """SELECT c_custkey, '{"' || c_name || '":"' || c_mktsegment || '","segment é":"' || c_name || '"}' AS json FROM customer"""
    ),
}

_BYTES = (
    "list_transform(range(0, octet_length(encode({t}))), lambda i: ('0x' || substr(hex(encode({t})), (2 * i + 1)::INT, 2))::INT + 3)"
)


def _byte_ids(text: str, width: int) -> str:
    ids = f"list_append({_BYTES.format(t=text)}, 1)"
    cut = f"CASE WHEN len({ids}) > {width} THEN list_append(({ids})[1:{width - 1}], 1) ELSE {ids} END"
    return f"list_resize({cut}, {width}, 0)"


SQL |= {
    "tokenize_pad": (
        f"WITH t AS (SELECT conv_id, turn, {_byte_ids('text', 128)} AS ids, least(octet_length(encode(text)) + 1, 128)::INT AS n_tokens, "
        f"{_byte_ids('role', 32)} AS labels FROM conversations) SELECT conv_id, turn, array_to_string(ids, ' ') AS input_ids, "
        "n_tokens, array_to_string(labels, ' ') AS labels FROM t"
    ),
    "tokenize_words": (
        "WITH w AS (SELECT conv_id, turn, list_append(list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), "
        "lambda x: (('0x' || substr(md5(x), 1, 8))::BIGINT % 32000 + 3)::INT), 1) AS ids FROM conversations) "
        "SELECT conv_id, turn, array_to_string(list_resize(CASE WHEN len(ids) > 32 THEN list_append(ids[1:31], 1) ELSE ids END, 32, 0), ' ') AS input_ids, "
        "repeat('1', least(len(ids), 32)) || repeat('0', 32 - least(len(ids), 32)) AS mask FROM w"
    ),
    "allowed_next": (
        "WITH n AS (SELECT DISTINCT p_name FROM part), f AS (SELECT DISTINCT substr(p_name, 1, i::INT) AS h, "
        "coalesce(ascii(nullif(substr(p_name, i::INT + 1, 1), '')) + 3, 1) AS nx FROM n, unnest(range(0, length(p_name) + 1)) AS u(i)), "
        "g AS (SELECT h, string_agg(nx::VARCHAR, ' ' ORDER BY nx) AS allowed FROM f GROUP BY 1), "
        "w AS (SELECT p_partkey, substr(p_name, 1, i::INT) AS h FROM part, unnest(range(0, length(p_name) + 1)) AS u(i)) "
        "SELECT p_partkey, length(h)::BIGINT AS n_ids, allowed FROM w JOIN g USING (h)"
    ),
    "embed_lines": (
        f"WITH {lines_cte()}, p AS (SELECT line_id, ' ' || upper(first_line) || ' ' AS t FROM lines), "
        "g AS (SELECT line_id, ((unicode(substr(t, i::INT, 1))::BIGINT * 961 + unicode(substr(t, i::INT + 1, 1)) * 31 + unicode(substr(t, i::INT + 2, 1))) "
        f"* 48271 % 2147483647) % {r.DIMS} AS slot FROM p, unnest(range(1, length(t) - 1)) AS u(i)), "
        "c AS (SELECT line_id, slot, count(*) AS n FROM g GROUP BY ALL) "
        "SELECT line_id, slot, round((n / sqrt(sum(n * n) OVER (PARTITION BY line_id)))::FLOAT::DOUBLE, 5) AS w FROM c"
    ),
}


# --- vectors -----------------------------------------------------------------


def _near(k: int) -> str:
    return (
        "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, 'line ' || lpad(vec_id::VARCHAR, 8, '0') AS line FROM embeddings), "
        "sims AS (SELECT q.vec_id AS query_id, c.vec_id AS cat_id, c.line AS candidate, "
        "round(list_cosine_similarity(q.e, c.e), 9) AS cosine FROM v q, v c), "
        "near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, cat_id)::INT AS place "
        f"FROM sims QUALIFY place <= {k}), "
        "asked AS (SELECT vec_id AS query_id, 'text ' || vec_id AS noisy, 'line ' || lpad((CASE WHEN vec_id >= label "
        "THEN vec_id - label ELSE vec_id END)::VARCHAR, 8, '0') AS truth FROM v)"
    )


NEGATIVES = (
    f"{_near(10)}, train AS (SELECT vec_id * 3 + k AS row_id, CASE WHEN label = 3 THEN 'unknown line' ELSE line END AS first_line, "
    f"'noisy ' || vec_id || ' ' || k AS {NOISY} FROM v, unnest([0, 1, 2]) AS u(k))"
)


def _mined(train: str = "train") -> str:
    return (
        f"firsts AS (SELECT first_line, {NOISY} AS text, row_number() OVER (PARTITION BY first_line ORDER BY row_id) AS rn "
        f"FROM {train} QUALIFY rn <= 2), "
        "negs AS (SELECT query_id, text, row_number() OVER (PARTITION BY query_id ORDER BY place, rn) AS nr "
        "FROM near JOIN firsts ON firsts.first_line = near.candidate WHERE near.cat_id <> near.query_id QUALIFY nr <= 15), "
        "lists AS (SELECT v.line AS first_line, list(text ORDER BY nr) AS hn FROM negs JOIN v ON v.vec_id = negs.query_id GROUP BY 1), "
        f"mined AS (SELECT t.row_id, t.first_line, t.{NOISY}, coalesce(hn, []) AS hn FROM {train} t LEFT JOIN lists USING (first_line))"
    )


def _split(frm: str) -> str:
    return (
        f"(SELECT *, CASE WHEN row_number() OVER (ORDER BY {base('row_id')}, row_id) <= ceil(0.1 * (SELECT count(*) FROM {frm})) "
        f"THEN 'test' ELSE 'train' END AS split FROM {frm})"
    )


PROMPT = (
    f"'match product:' || chr(10) || 'input: ' || {NOISY} || chr(10) || 'candidate: ' || c"
)
PAIRS = (
    f"prs AS (SELECT row_id, (i - 1)::INT AS pos, {PROMPT} AS prompt, CASE WHEN i = 1 THEN 'yes' ELSE 'no' END AS target FROM "
    "(SELECT *, cs[i] AS c FROM (SELECT *, list_prepend(first_line, hn) AS cs FROM mined), unnest(range(1, len(cs) + 1)) AS u(i)))"
)

SQL |= {
    "cosine_pairs": (
        "WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings), "
        "m AS (SELECT label, i, avg(x) AS m FROM x GROUP BY ALL) SELECT vec_id, "
        "round(sum(x * m) / sqrt(sum(x * x)) / sqrt(sum(m * m)), 6) AS cosine FROM x JOIN m USING (label, i) GROUP BY 1"
    ),
    "nearest_lines": (
        f"WITH {_near(10)} SELECT query_id AS cat_id, cat_id AS near_id, cosine, place FROM near"
    ),
    "shortlist": (
        f"WITH {_near(64)} SELECT query_id, cat_id, candidate, cosine, place FROM near"
    ),
    "mine_hard_negatives": (
        f"WITH {NEGATIVES}, {_mined()} SELECT row_id, first_line, {NOISY}, array_to_string(hn, '|') AS hard_negatives FROM mined"
    ),
    "merge_negatives": (
        f"WITH {NEGATIVES}, {_mined()} SELECT first_line, count(*) AS n_rows, sum(len(hn))::BIGINT AS n_negatives FROM mined GROUP BY 1"
    ),
    "exact_split": on_noisy(f"SELECT row_id, split FROM {_split('noisy')}"),
    "make_pairs": f"WITH {NEGATIVES}, {_mined()}, {PAIRS} SELECT row_id, pos, prompt, target FROM prs",
    "pair_volume": (
        f"WITH {NEGATIVES}, {_mined()} SELECT split, count(*) AS n_rows, sum(len(hn) + 1)::BIGINT AS n_pairs FROM {_split('mined')} GROUP BY 1"
    ),
    "write_and_read_pairs": (
        f"WITH {NEGATIVES}, {_mined()}, {PAIRS} SELECT pos, count(*) AS n_pairs, "
        "sum(least(octet_length(encode(prompt)) + 1, 128))::BIGINT AS n_tokens, (count(*) * 128)::BIGINT AS n_ids FROM prs GROUP BY 1"
    ),
    "write_catalog": on_noisy(
        f"SELECT row_number() OVER (ORDER BY first_line) - 1 AS cat_id, first_line AS canonical, {r.DIMS} AS dims "
        "FROM (SELECT DISTINCT first_line FROM noisy)"
    ),
    "write_negatives": (
        f"WITH {NEGATIVES}, parts AS {_split('train')}, tr AS (SELECT * FROM parts WHERE split = 'train'), {_mined('tr')} "
        "SELECT 'train' AS split, count(*) AS n_rows, sum(len(hn))::BIGINT AS n_negatives FROM mined UNION ALL "
        "SELECT 'test', count(*), 0 FROM parts WHERE split = 'test'"
    ),
}
SQL["nearest_lines_by_pivots"] = SQL["nearest_lines"]


GRAMS = (
    "p AS (SELECT first_line, ' ' || upper(first_line) || ' ' AS t FROM (SELECT DISTINCT first_line FROM lines)), "
    "g AS (SELECT first_line, ((unicode(substr(t, i::INT, 1))::BIGINT * 961 + unicode(substr(t, i::INT + 1, 1)) * 31 + unicode(substr(t, i::INT + 2, 1))) "
    f"* 48271 % 2147483647) % {r.DIMS} AS slot FROM p, unnest(range(1, length(t) - 1)) AS u(i)), "
    "n AS (SELECT first_line, slot, count(*) AS n FROM g GROUP BY ALL), "
    "w AS (SELECT first_line, slot, (n / sqrt(sum(n * n) OVER (PARTITION BY first_line)))::FLOAT::DOUBLE AS w FROM n), "
    "len_ AS (SELECT first_line, sqrt(sum(w * w)) AS l FROM w GROUP BY 1), "
    "dots AS (SELECT a.first_line AS line, b.first_line AS near, sum(a.w * b.w) AS d FROM w a JOIN w b USING (slot) GROUP BY ALL), "
    "near AS (SELECT line, near, row_number() OVER (PARTITION BY line ORDER BY round(d / x.l / y.l, 9) DESC, near) AS place "
    "FROM dots JOIN len_ x ON x.first_line = line JOIN len_ y ON y.first_line = near QUALIFY place <= 10)"
)

SQL["mine_hard_negatives_of_lines"] = (
    f"WITH {NOISY_CTE}, {GRAMS}, firsts AS (SELECT first_line, {NOISY} AS text, "
    "row_number() OVER (PARTITION BY first_line ORDER BY row_id) AS rn FROM noisy QUALIFY rn <= 5), "
    "negs AS (SELECT line, text, row_number() OVER (PARTITION BY line ORDER BY place, rn) AS nr "
    "FROM near JOIN firsts ON firsts.first_line = near.near WHERE near.near <> line QUALIFY nr <= 15), "
    "lists AS (SELECT line AS first_line, string_agg(text, '|' ORDER BY nr) AS hn FROM negs GROUP BY 1) "
    "SELECT row_id, coalesce(hn, '') AS hard_negatives FROM noisy LEFT JOIN lists USING (first_line)"
)


# --- ranking -----------------------------------------------------------------


def _ranked(k: int, pool: int, inject: bool = True, policy: str = "encoder_margin_blend") -> str:
    """``cands``, ``pool`` and ``best`` as the ranking operators make them."""
    at = base("query_id", "cat_id")
    injected = (
        "missed AS (SELECT asked.* FROM asked WHERE NOT EXISTS (SELECT 1 FROM near WHERE near.query_id = asked.query_id "
        "AND near.candidate = asked.truth)), "
        "both_ AS (SELECT near.*, noisy, truth, false AS was_injected FROM near JOIN asked USING (query_id) UNION ALL BY NAME "
        "SELECT query_id, noisy, truth, s.cat_id, s.candidate, s.cosine, 0 AS place, true AS was_injected FROM missed "
        "JOIN sims s USING (query_id) WHERE s.candidate = truth), "
        "cands AS (SELECT * FROM (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS place) FROM both_) "
        f"WHERE place <= {k})"
        if inject
        else "cands AS (SELECT near.*, noisy, truth, false AS was_injected FROM near JOIN asked USING (query_id))"
    )
    score = {
        "min_nll_yes": "-nll_yes",
        "max_yes_no_margin": "nll_no - nll_yes",
        "encoder_margin_blend": "nll_no - nll_yes + 2 * norm",
    }[policy]
    return (
        f"{_near(k)}, {injected}, pool AS (SELECT *, {score} AS pick_score, CASE WHEN nll_yes < nll_no THEN 'yes' ELSE 'no' END AS label "
        f"FROM (SELECT *, (cosine - min(cosine) OVER q) / greatest(max(cosine) OVER q - min(cosine) OVER q, 1e-8) AS norm, "
        f"{draw(at, 1)} / {PRIME}.0::DOUBLE * 5 AS nll_yes, {draw(at, 2)} / {PRIME}.0::DOUBLE * 5 AS nll_no "
        f"FROM cands WHERE place <= {pool} WINDOW q AS (PARTITION BY query_id))), "
        "best AS (SELECT *, candidate AS predicted, nll_yes < nll_no AS predicted_prefers_yes, candidate = truth AS is_correct "
        "FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pick_score DESC, place) = 1)"
    )


RANKED = _ranked(16, 8)
LISTS = (
    "shorts AS (SELECT query_id, list(candidate ORDER BY place) AS short, count(*)::INT AS n_cosines FROM cands GROUP BY 1), "
    "pools AS (SELECT query_id, list(candidate ORDER BY place) AS pl, list(label ORDER BY place) AS ls, count(*)::INT AS n_scores FROM pool GROUP BY 1)"
)
_JSON_LIST = "'[\"' || array_to_string({x}, '\",\"') || '\"]'"
SCORES_JSON = (
    "'{' || array_to_string(list_transform(range(1, len(pl) + 1), lambda i: '\"' || pl[i] || '\":\"' || ls[i] || '\"'), ',') || '}'"
)


def _hit_share(ordered: str, k: int) -> str:
    return (
        f"WITH {RANKED}, o AS (SELECT c.query_id, c.candidate = c.truth AS hit, row_number() OVER (PARTITION BY c.query_id ORDER BY {ordered}, c.place) AS rn "
        "FROM cands c LEFT JOIN pool p USING (query_id, cat_id)), "
        f"h AS (SELECT query_id, bool_or(hit AND rn <= {k}) AS hit FROM o GROUP BY 1) "
        "SELECT round(avg(coalesce(hit, false)::INT), 6) AS accuracy FROM asked LEFT JOIN h USING (query_id)"
    )


SQL |= {
    "inject_truth": (
        f"WITH {RANKED} SELECT query_id, cat_id, candidate, cosine, place, was_injected FROM cands"
    ),
    "ranker_pool": f"WITH {_near(64)} SELECT query_id, candidate, place FROM near WHERE place <= 24",
    "minmax_norm": (
        f"WITH {_near(24)} SELECT query_id, cat_id, round((cosine - min(cosine) OVER q) / greatest(max(cosine) OVER q - min(cosine) OVER q, 1e-8), 5) AS cosine_norm "
        "FROM near WINDOW q AS (PARTITION BY query_id)"
    ),
    "yes_no_label": (
        f"WITH {_near(5)} SELECT query_id, cat_id, CASE WHEN place = 4 THEN '' WHEN place < 4 AND y < n THEN 'yes' ELSE 'no' END AS label FROM "
        f"(SELECT *, {draw(base('query_id', 'cat_id'), 1)} AS y, {draw(base('query_id', 'cat_id'), 2)} AS n FROM near)"
    ),
    "score_pairs": on_noisy(
        "SELECT row_id, round(-ln(p), 6) AS nll_yes, round(-ln(1 - p), 6) AS nll_no, CASE WHEN -ln(p) < -ln(1 - p) THEN 'yes' ELSE 'no' END AS label FROM "
        f"(SELECT row_id, greatest(least(1.0::DOUBLE - levenshtein(upper({NOISY}), upper(first_line)) / greatest(length({NOISY}), length(first_line), 1)::DOUBLE, 0.999999::DOUBLE), 0.000001::DOUBLE) AS p FROM noisy)"
    ),
    "pick_best": f"WITH {RANKED} SELECT query_id, predicted, predicted_prefers_yes, is_correct FROM best",
    "score_legacy": (
        f"WITH {RANKED}, f AS (SELECT query_id, arg_min(candidate, cat_id) AS predicted FROM pool WHERE label = 'yes' GROUP BY 1) "
        "SELECT query_id, predicted, coalesce(predicted = truth, false) AS is_correct FROM asked LEFT JOIN f USING (query_id)"
    ),
    "evaluate_ranking": (
        f"WITH {RANKED}, {LISTS} SELECT query_id, noisy, truth AS true, predicted, predicted_prefers_yes, is_correct, n_scores, n_cosines, "
        "array_to_string(pl, '|') AS ranker_pool, array_to_string(short, '|') AS shortlist FROM best JOIN shorts USING (query_id) JOIN pools USING (query_id)"
    ),
    "top1_accuracy": f"WITH {RANKED} SELECT round(avg(is_correct::INT), 6) AS accuracy FROM best",
    "top1_without_injection": (
        f"WITH {_ranked(16, 8, inject=False)} SELECT round(avg(is_correct::INT), 6) AS accuracy FROM best"
    ),
    "topk_accuracy": _hit_share("coalesce(p.pick_score, -1e30) DESC", 3),
    "top10_accuracy": _hit_share("coalesce(p.pick_score, -1e30) DESC", 10),
    "topk_accuracy_by_nll": _hit_share("coalesce(p.nll_yes, 'inf'::DOUBLE)", 3),
    "topk_accuracy_legacy": (
        f"WITH {RANKED}, y AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rn FROM pool WHERE label = 'yes'), "
        "h AS (SELECT DISTINCT query_id FROM y WHERE rn <= 3 AND candidate = truth) "
        "SELECT round(count(h.query_id) / count(*)::DOUBLE, 6) AS accuracy FROM asked LEFT JOIN h USING (query_id)"
    ),
    "limit_eval": on_noisy(f"SELECT row_id, {NOISY} FROM noisy ORDER BY row_id LIMIT 100"),
    "to_flat_records": (
        f"WITH {RANKED}, {LISTS} SELECT noisy, truth AS true, predicted, predicted_prefers_yes, is_correct, 'encoder_margin_blend' AS eval_pick_policy, "
        f"8 AS eval_ranker_max_encoder_rank, {_JSON_LIST.format(x='pl')} AS ranker_pool_json, {SCORES_JSON} AS scores_json, {_JSON_LIST.format(x='short')} AS shortlist_json "
        "FROM best JOIN shorts USING (query_id) JOIN pools USING (query_id)"
    ),
    "write_predictions": (
        f"WITH {RANKED}, {LISTS} SELECT noisy, truth AS true_canonical, predicted, is_correct, predicted_prefers_yes, {SCORES_JSON} AS scores_json, "
        "round(jaro_winkler_similarity(truth, predicted), 6) AS jw_score FROM best JOIN pools USING (query_id)"
    ),
}
for _policy in ("min_nll_yes", "max_yes_no_margin", "encoder_margin_blend"):
    SQL[f"pick_score_{_policy}"] = (
        f"WITH {_ranked(16, 8, policy=_policy)} SELECT query_id, cat_id, round(nll_no - nll_yes, 6) AS margin, round(pick_score, 5) AS pick_score FROM pool"
    )


# --- report tables -----------------------------------------------------------

REPORT = (
    f"{NOISY_CTE}, guess AS (SELECT *, CASE WHEN row_id % 7 = 0 THEN NULL WHEN row_id % 5 = 0 THEN {NOISY} ELSE first_line END AS predicted FROM noisy), "
    "report AS (SELECT *, first_line AS reference, coalesce(jaro_winkler_similarity(first_line, coalesce(predicted, '')), 0) AS jw_score FROM guess)"
)

SQL |= {
    "jw_by_steps": (
        f"WITH {REPORT} SELECT {STEPS}, round(avg(jw_score), 6) AS avg_jw, count(*) AS record_count FROM report "
        f"WHERE jw_score <= 1 AND {NOISY} <> first_line GROUP BY 1"
    ),
    "hardest_steps": (
        f"WITH {REPORT} SELECT *, round(correct / total_count::DOUBLE, 2) AS perc_correct FROM (SELECT {STEPS}, "
        "sum(CASE WHEN jw_score = 1 THEN 1 ELSE 0 END)::BIGINT AS correct, count(*) AS total_count FROM report WHERE predicted IS NOT NULL GROUP BY 1)"
    ),
    "worst_examples": (
        f"WITH {REPORT} SELECT first_line, {NOISY}, {STEPS}, predicted, reference, round(jw_score, 6) AS jw_score FROM report "
        f"WHERE {STEPS} = ', randomly_replace_spaces'"
    ),
    "join_predictions": on_noisy(
        f", p AS (SELECT {NOISY}, min(first_line) AS predicted FROM noisy GROUP BY 1) SELECT row_id, {NOISY}, predicted FROM noisy LEFT JOIN p USING ({NOISY})"
    ).replace(") , p AS", "), p AS"),
    "write_report_table": (
        f"WITH {REPORT} SELECT {STEPS}, count(*) AS n_rows, round(sum(jw_score), 4) AS sum_jw FROM report GROUP BY 1"
    ),
}
