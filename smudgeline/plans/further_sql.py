"""Check SQL of the queries in :mod:`further`."""

from __future__ import annotations

from ..functions.draws import PRIME
from ..functions.lexicons import lookalikes
from ..functions.noise import GRID_STEPS
from ..functions.tokens import EOS, OFFSET, PAD
from ..operators.augment import NOISY, STEPS
from .check_sql import (
    NEGATIVES,
    PAIRS,
    RANKED,
    SQL,
    _byte_ids,
    _mined,
    _near,
    _spaced,
    _split,
    base,
    draw,
    lines_cte,
    mixed_directions,
    on_noisy,
    quoted,
    source_cte,
    sql_list,
)
from .further import SQL_FORMS
from .registered import DIMS

_STEP = (
    f"s AS (SELECT unnest(range(0, {len(GRID_STEPS)})) AS i, unnest({sql_list(GRID_STEPS)}) AS step)"
)


def _plans(most: int, ordered: bool = False) -> str:
    """``p(plan_no, plan, n_steps, last_step)`` by joining the steps with themselves."""
    parts = []
    for n in range(1, most + 1):
        tables = [f"s s{k}" for k in range(n)]
        if ordered:
            tests = [f"s{a}.i <> s{b}.i" for a in range(n) for b in range(a)]
        else:
            tests = [f"s{a}.i < s{a + 1}.i" for a in range(n - 1)]
        plan = " || ',' || ".join(f"s{k}.step" for k in range(n))
        keys = ", ".join(f"s{k}.i" for k in range(n))
        where = f" WHERE {' AND '.join(tests)}" if tests else ""
        parts.append(
            f"SELECT {n} AS n_steps, {plan} AS plan, s{n - 1}.step AS last_step, [{keys}] AS ks FROM {', '.join(tables)}{where}"
        )
    return (
        f"WITH {_STEP}, p AS (SELECT *, row_number() OVER (ORDER BY n_steps, ks) - 1 AS plan_no FROM "
        f"({' UNION ALL '.join(parts)}))"
    )


_NAMED = f"n AS (SELECT p_partkey AS row_id, upper(p_name) AS {NOISY}, p_type FROM part)"


def _pooled(padded: bool) -> str:
    width = "max(n) OVER (PARTITION BY line_id // 64)" if padded else "n"
    # the end token closes a line; lines over forty tokens are cut
    return (
        f"WITH {lines_cte()}, ids AS (SELECT line_id, list_append(list_transform(range(1, length(first_line) + 1), "
        f"lambda i: ascii(substr(first_line, i::INT, 1)) + {OFFSET}), {EOS})[1:40] AS ids FROM lines), "
        f"sized AS (SELECT *, {width} AS width FROM (SELECT *, len(ids) AS n FROM ids)), "
        f"toks AS (SELECT line_id, width, unnest(list_concat(ids, list_transform(range(n, width), lambda i: {PAD}))) AS token_id FROM sized), "
        "vecs AS (SELECT vec_id AS token_id, unnest(range(0, len(embedding))) AS slot, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id < 259), "
        "sums AS (SELECT line_id, slot, sum(x) / any_value(width) AS m FROM toks JOIN vecs USING (token_id) GROUP BY ALL) "
        "SELECT line_id, slot, round(m / sqrt(sum(m * m) OVER (PARTITION BY line_id)), 6) AS w FROM sums"
    )


def _vectors(name: str, source: str) -> str:
    """``name(t, e)``: unit vectors of hashed character n-grams of distinct upper-cased texts."""
    return (
        f"{name}_p AS (SELECT DISTINCT t, ' ' || t || ' ' AS s FROM {source}), "
        f"{name}_g AS (SELECT t, ((unicode(substr(s, i::INT, 1))::BIGINT * 961 + unicode(substr(s, i::INT + 1, 1)) * 31 + unicode(substr(s, i::INT + 2, 1))) "
        f"* 48271 % 2147483647) % {DIMS} AS slot FROM {name}_p, unnest(range(1, length(s) - 1)) AS u(i)), "
        f"{name}_n AS (SELECT t, slot, count(*) AS n FROM {name}_g GROUP BY ALL), "
        f"{name}_w AS (SELECT t, map_from_entries(list((slot, (n / l)::FLOAT::DOUBLE))) AS m FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY t)) AS l FROM {name}_n) GROUP BY 1), "
        f"{name} AS (SELECT t, list_transform(range(0, {DIMS}), lambda k: coalesce(m[k], 0.0::DOUBLE))::DOUBLE[{DIMS}] AS e FROM {name}_w)"
    )


def _flagship() -> str:
    """Every step on every line, shortlist of 24, edit scores blended with cosines, accuracy per step."""
    forms = {step: SQL[f"noise_{name}"] for name, step in SQL_FORMS.items()}
    forms["convert_cardinal_directions"] = mixed_directions(source_cte())
    texts = " UNION ALL ".join(f"SELECT * FROM ({forms[s]})" for s in GRID_STEPS)
    # capitals of look-alikes as Unicode has them in full, where one may become two
    special = {a: a.upper() for alts in lookalikes().values() for a in alts if len(a) == 1 and a.upper() != a}
    capitals = f"MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in sorted(special.items()))}}}"
    # edits are counted in bytes here; lines are ASCII, so any other character may be one byte that none has
    near = "1.0::DOUBLE - levenshtein(regexp_replace(q.t, '[^\\x00-\\x7F]', chr(127), 'g'), c.t) / greatest(length(q.t), length(c.t), 1)::DOUBLE"
    return (
        f"WITH {lines_cte()}, asked AS (SELECT line_id, step, array_to_string(list_transform(string_split(text, ''), lambda c: coalesce({capitals}[c], upper(c))), '') AS t FROM ({texts})), "
        f"cat AS (SELECT first_line, upper(first_line) AS t, row_number() OVER (ORDER BY first_line) AS cat_id FROM (SELECT DISTINCT first_line FROM lines)), "
        f"{_vectors('qv', 'asked')}, {_vectors('cv', 'cat')}, "
        "sims AS (SELECT q.t AS qt, cat.cat_id, round(array_cosine_similarity(q.e, cv.e), 9) AS cosine FROM qv q, cv JOIN cat USING (t)), "
        "near AS (SELECT *, row_number() OVER (PARTITION BY qt ORDER BY cosine DESC, cat_id) AS place FROM sims QUALIFY place <= 24), "
        f"scored AS (SELECT q.line_id, q.step, near.place, c.first_line AS candidate, cosine, greatest(least({near}, 0.999999::DOUBLE), 0.000001::DOUBLE) AS p "
        "FROM asked q JOIN near ON near.qt = q.t JOIN cat c USING (cat_id)), "
        "blended AS (SELECT *, -ln(1.0::DOUBLE - p) + ln(p) + 2 * (cosine - min(cosine) OVER w) / greatest(max(cosine) OVER w - min(cosine) OVER w, 1e-8) AS pick "
        "FROM scored WINDOW w AS (PARTITION BY line_id, step)), "
        "best AS (SELECT * FROM blended QUALIFY row_number() OVER (PARTITION BY line_id, step ORDER BY pick DESC, place) = 1) "
        "SELECT ', ' || step AS steps, count(*) AS n_rows, round(avg((candidate = first_line)::INT), 6) AS accuracy "
        "FROM best JOIN lines USING (line_id) GROUP BY 1"
    )


def _failing() -> str:
    """``pool`` of four candidates whose scores fail in every way, and all ``cands``."""
    kind = "(query_id + cat_id) % 7"
    at = base("query_id", "cat_id")
    return (
        f"{_near(16)}, cands AS (SELECT near.*, noisy, truth FROM near JOIN asked USING (query_id)), "
        f"raw AS (SELECT *, CASE WHEN {kind} IN (0, 1) THEN 'inf'::DOUBLE WHEN {kind} = 2 THEN NULL ELSE {draw(at, 1)} / {PRIME}.0::DOUBLE * 5 END AS y, "
        f"CASE WHEN {kind} = 0 THEN 'inf'::DOUBLE WHEN {kind} = 3 THEN NULL ELSE {draw(at, 2)} / {PRIME}.0::DOUBLE * 5 END AS n, "
        f"{kind} IN (0, 2, 3) AS lost FROM cands WHERE place <= 4), "
        "pool AS (SELECT *, CASE WHEN lost OR y = 'inf'::DOUBLE THEN '-inf'::DOUBLE ELSE n - y END AS pick FROM raw)"
    )


def _counted() -> str:
    """Costs of both labels by back-off over the last four characters; the end of a label is '~'."""
    step = (
        "SELECT {cols}, nth, c, right(ctx, c::INT) AS ctx, nx FROM (SELECT {cols}, nth, right(prompt || substr(label, 1, nth::INT - 1), 4) AS ctx, "
        "coalesce(nullif(substr(label, nth::INT, 1), ''), '~') AS nx FROM {frm}, unnest(range(1, length(label) + 2)) AS u(nth)), unnest(range(0, length(ctx) + 1)) AS w(c)"
    )
    return (
        f"seen AS ({step.format(cols='one', frm='(SELECT 1 AS one, prompt, target AS label FROM prs WHERE row_id % 2 = 0)')}), "
        "counts AS (SELECT c, ctx, nx, count(*) AS n FROM seen GROUP BY ALL), "
        "model AS (SELECT *, sum(n) OVER (PARTITION BY c, ctx) AS total FROM counts), "
        "ends AS (SELECT DISTINCT right(prompt, 4) AS prompt FROM prs), both_ AS (SELECT prompt, label FROM ends, (VALUES ('yes'), ('no')) AS l(label)), "
        f"asked_ AS ({step.format(cols='prompt, label', frm='both_')}), "
        "tokens AS (SELECT a.prompt, a.label, a.nth, arg_max(-ln(n / total::DOUBLE) - (4 - a.c) * ln(0.4::DOUBLE), CASE WHEN n IS NOT NULL THEN a.c END) AS cost "
        "FROM asked_ a LEFT JOIN model m ON a.c = m.c AND a.ctx = m.ctx AND a.nx = m.nx GROUP BY ALL), "
        "costs AS (SELECT prompt, label, sum(coalesce(cost, -5 * ln(0.4::DOUBLE) + ln(259.0::DOUBLE))) AS nll FROM tokens GROUP BY ALL)"
    )


_IDS = _byte_ids("prompt", 128)

SQL |= {f"sql_noise_{name}": SQL[f"noise_{name}"] for name in SQL_FORMS}
SQL |= {
    "sql_helpers": on_noisy(
        f"SELECT row_id, n_steps, {_spaced(NOISY)} AS spaced, "
        f"round(1.0::DOUBLE - levenshtein({NOISY}, first_line) / greatest(length({NOISY}), length(first_line), 1)::DOUBLE, 6) AS similar, "
        f"round(jaro_winkler_similarity(first_line, {NOISY}), 6) AS jw FROM noisy"
    ),
    "step_plans_by_number": (
        f"{_plans(4)} SELECT plan_no, plan, n_steps, (SELECT max(n) FROM (SELECT count(*) AS n FROM part GROUP BY p_type)) AS n_rows FROM p"
    ),
    "ordered_plans_by_number": (
        f"{_plans(3, True)} SELECT last_step, n_steps, count(*) AS n_plans, min(plan_no) AS first_plan, max(plan_no) AS last_plan, "
        "(SELECT count(*) FROM part) AS n_lines FROM p GROUP BY last_step, n_steps"
    ),
    "accuracy_by_steps": _flagship(),
    "label_failed_scores": (
        f"WITH {_failing()} SELECT query_id, cat_id, CASE WHEN lost THEN '' WHEN y < n THEN 'yes' ELSE 'no' END AS label, "
        "CASE WHEN lost THEN 'none' WHEN y = 'inf'::DOUBLE THEN '-Infinity' ELSE round(n - y, 6)::VARCHAR END AS margin, pick = '-inf'::DOUBLE AS is_last FROM pool"
    ),
    "pick_best_of_failed": (
        f"WITH {_failing()} SELECT query_id, candidate AS predicted, coalesce(NOT lost AND y < n, false) AS predicted_prefers_yes, candidate = truth AS is_correct "
        "FROM pool QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lost, pick DESC, place) = 1"
    ),
    "topk_accuracy_of_failed": (
        f"WITH {_failing()}, o AS (SELECT c.query_id, c.candidate = c.truth AS hit, row_number() OVER (PARTITION BY c.query_id "
        "ORDER BY coalesce(p.pick, -1e30) DESC, c.place) AS rn FROM cands c LEFT JOIN pool p USING (query_id, cat_id)), "
        "h AS (SELECT query_id, bool_or(hit AND rn <= 3) AS hit FROM o GROUP BY 1) "
        "SELECT round(avg(coalesce(hit, false)::INT), 6) AS accuracy FROM asked LEFT JOIN h USING (query_id)"
    ),
    "score_by_counts": (
        f"WITH {NEGATIVES}, {_mined()}, {PAIRS}, {_counted()} SELECT row_id, pos, round(y.nll, 6) AS nll_yes, round(n.nll, 6) AS nll_no, "
        "CASE WHEN y.nll < n.nll THEN 'yes' ELSE 'no' END AS label FROM prs JOIN costs y ON y.prompt = right(prs.prompt, 4) AND y.label = 'yes' "
        "JOIN costs n ON n.prompt = right(prs.prompt, 4) AND n.label = 'no'"
    ),
    "evaluation_maps": (
        f"WITH {RANKED} SELECT c.query_id, c.candidate, round(c.cosine, 6) AS cosine, p.label, round(p.nll_yes, 5) AS nll_yes, "
        "round(p.nll_no, 5) AS nll_no, round(p.nll_no - p.nll_yes, 5) AS margins, round(p.pick_score, 5) AS pick_scores "
        "FROM cands c LEFT JOIN pool p USING (query_id, cat_id)"
    ),
    "flat_record_maps": (
        f"WITH {RANKED} SELECT c.noisy, c.candidate, round(c.cosine, 6) AS cosine, round(p.nll_yes, 5) AS nll_yes, "
        "round(p.nll_no, 5) AS nll_no, round(p.nll_no - p.nll_yes, 5) AS margins, round(p.pick_score, 5) AS pick_scores "
        "FROM cands c LEFT JOIN pool p USING (query_id, cat_id)"
    ),
    "catalog_contents": on_noisy(
        f", cat AS (SELECT row_number() OVER (ORDER BY first_line) - 1 AS cat_id, first_line AS canonical, upper(first_line) AS t FROM (SELECT DISTINCT first_line FROM noisy)), "
        f"{_vectors('cv', 'cat')} SELECT cat_id, canonical, i - 1 AS slot, round(e[i], 5) AS w FROM cat JOIN cv USING (t), unnest(range(1, {DIMS} + 1)) AS u(i) WHERE e[i] <> 0"
    ).replace(") , cat AS", "), cat AS"),
    "negatives_contents": (
        f"WITH {NEGATIVES}, parts AS {_split('train')}, tr AS (SELECT * FROM parts WHERE split = 'train'), {_mined('tr')} "
        f"SELECT row_id, first_line, {NOISY}, 'train' AS split, array_to_string(hn, '|') AS hard_negatives FROM mined UNION ALL "
        f"SELECT row_id, first_line, {NOISY}, split, '' FROM parts WHERE split = 'test'"
    ),
    "merged_rows": (
        f"WITH {NEGATIVES}, {_mined()} SELECT row_id, first_line, {NOISY}, len(hn)::INT AS n_negatives, array_to_string(hn, '|') AS hard_negatives FROM mined"
    ),
    "pairs_contents": (
        f"WITH {NEGATIVES}, {_mined()}, {PAIRS} SELECT row_id, pos, md5(array_to_string({_IDS}, ' ')) AS ids, least(octet_length(encode(prompt)) + 1, 128)::INT AS n_tokens, "
        "CASE target WHEN 'yes' THEN '124 104 118 1 0 0 0 0' ELSE '113 114 1 0 0 0 0 0' END AS labels FROM prs"
    ),
    "noisy_grid_by_number": SQL["augment_grid"],
    "shortlist_by_cells": SQL["shortlist"],
    "score_legacy_whole": (
        f"WITH {_near(1)}, said AS (SELECT q.query_id, c.vec_id AS cat_id, c.line FROM asked q, v c WHERE "
        f"{draw(base('q.query_id', 'c.vec_id'), 1)} / {PRIME}.0::DOUBLE * 5 < {draw(base('q.query_id', 'c.vec_id'), 2)} / {PRIME}.0::DOUBLE * 0.1), "
        "f AS (SELECT query_id, arg_min(line, cat_id) AS predicted FROM said GROUP BY 1) "
        "SELECT query_id, predicted, coalesce(predicted = truth, false) AS is_correct FROM asked LEFT JOIN f USING (query_id)"
    ),
    "append_noisy_batches": on_noisy(
        f"SELECT st, {STEPS}, count(*) AS n_rows, sum(row_id)::BIGINT AS sum_ids FROM noisy GROUP BY ALL"
    ),
    "trie_nodes": (
        "WITH n AS (SELECT DISTINCT p_name FROM part), f AS (SELECT DISTINCT i::INT AS length, substr(p_name, 1, i::INT) AS h, "
        "substr(p_name, i::INT + 1, 1) AS nx FROM n, unnest(range(0, length(p_name) + 1)) AS u(i)) "
        "SELECT length, count(DISTINCT h) AS n_nodes, count(*) AS n_edges FROM f GROUP BY 1"
    ),
    "allowed_next_from_trie": SQL["allowed_next"],
    "mean_over_tokens": _pooled(False),
    "mean_over_padded_tokens": _pooled(True),
    "join_repeated_predictions": (
        f"WITH {_NAMED} SELECT a.row_id, a.{NOISY}, b.row_id AS prediction_id, b.p_type AS predicted FROM n a "
        f"LEFT JOIN n b ON a.{NOISY} = b.{NOISY} AND b.row_id % 5 < 2"
    ),
    "join_predictions_by_row": (
        f"WITH {_NAMED} SELECT row_id, {NOISY}, CASE WHEN row_id % 5 < 2 THEN p_type END AS predicted FROM n"
    ),
}
