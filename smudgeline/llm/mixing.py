"""Mixing sources to target weights as a min-cost flow over patterns of membership.

A document may belong to several sources. Documents with the same set of sources form a pattern;
a pattern can give its words once at no cost, and every further time at a higher price (repetition
costs are convex). Capacity flows from patterns to the quotas of their sources; what each pattern
gives fixes how many of its words are taken once, twice and so on. Whole documents are then chosen
in a seeded order that every rerun repeats.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import count_words

WEIGHTS = (3, 1, 2)
#: rows alike in key, sources and size that are dealt out together
EQUAL_ROWS = 10_000


def water_fill(sizes: list[int], weights: list[int], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size.

    What stops at its limit gives the excess to the others by weight, until none is above.
    """
    out = [0.0] * len(sizes)
    free = set(range(len(sizes)))
    left = total
    while free:
        unit = left / sum(weights[k] for k in free)
        full = {k for k in free if unit * weights[k] > most * sizes[k]}
        if not full:
            for k in free:
                out[k] = unit * weights[k]
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        free -= full
    return out


@dataclass
class Flow:
    """Words of each pattern routed to each source, and words it gives in each repetition."""

    routed: dict[tuple[int, int], int]
    given: list[list[int]]


def route(
    sizes: list[int], members: list[list[int]], quotas: list[int], cost: Callable[[int], int], most: int
) -> Flow:
    """Cheapest largest flow from patterns through sources to quotas, by cheapest paths.

    ``cost(r)`` is the price of a word taken for the (r+1)-th time and must not fall with r. Works
    on the table of patterns, whose size depends on the number of sources, not of documents.
    """
    n, m = len(sizes), len(quotas)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to: list[int] = []
    room: list[int] = []
    price: list[int] = []

    def arc(a: int, b: int, most_: int, c: int) -> int:
        for x, y, r, p in ((a, b, most_, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(p)
        return len(to) - 2

    repeats = [[arc(source, p, sizes[p], cost(r)) for r in range(most)] for p in range(n)]
    links = {(p, s): arc(p, n + s, most * sizes[p], 0) for p in range(n) for s in members[p]}
    for s in range(m):
        arc(n + s, sink, quotas[s], 0)
    while True:
        best: list[float] = [float("inf")] * len(graph)
        came = [-1] * len(graph)
        best[source] = 0
        queue, waiting = [source], {source}
        while queue:
            x = queue.pop(0)
            waiting.discard(x)
            for e in graph[x]:
                if room[e] and best[x] + price[e] < best[to[e]]:
                    best[to[e]] = best[x] + price[e]
                    came[to[e]] = e
                    if to[e] not in waiting:
                        waiting.add(to[e])
                        queue.append(to[e])
        if came[sink] < 0:
            break
        path, x = [], sink
        while x != source:
            path.append(came[x])
            x = to[came[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    return Flow(
        {k: room[e ^ 1] for k, e in links.items() if room[e ^ 1]}, [[room[e ^ 1] for e in r] for r in repeats]
    )


def choose(units: DataFrame, quotas: DataFrame, rows_per_cell: int, seed: int) -> DataFrame:
    """``units`` with ``full``: how many rows of each unit are chosen once more.

    ``units`` is ``(pattern, key, size, n)``, n equal rows; ``quotas`` is ``(pattern, words)``. Rows come in
    the order of a seeded hash. A pattern is cut into cells of about ``rows_per_cell`` units by
    that hash; cells before the one where the quota ends are taken whole, and in that cell, the
    only one that is walked through, units that still fit are taken one by one.
    """
    cells = units.groupBy("pattern").agg(F.count("*").alias("units"))
    cells = cells.select(
        "pattern", F.ceil(F.col("units") / rows_per_cell).cast("long").alias("cells")
    )
    hashed = (
        units.join(F.broadcast(cells), "pattern")
        .withColumn("draw", F.xxhash64(F.lit(seed), "key", "size", "pattern"))
        .withColumn("cell", F.pmod(F.col("draw"), F.col("cells")))
        .drop("cells")
    )
    before = Window.partitionBy("pattern").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    totals = hashed.groupBy("pattern", "cell").agg(F.sum(F.col("size") * F.col("n")).alias("words_in"))
    left = (
        totals.withColumn("before", F.coalesce(F.sum("words_in").over(before), F.lit(0)))
        .join(F.broadcast(quotas), "pattern")
        .select("pattern", "cell", (F.col("words") - F.col("before")).alias("left"), "words_in")
    )
    placed = hashed.join(left, ["pattern", "cell"])
    whole = placed.filter("left >= words_in").withColumn("full", F.col("n"))
    none = placed.filter("left <= 0 and left < words_in").withColumn("full", F.lit(0).cast("long"))

    def walk(cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["draw", "key", "size"])
        room = int(cell["left"].iloc[0])
        full = []
        for size, n in zip(cell["size"], cell["n"], strict=True):
            k = int(n) if not size else min(int(n), room // int(size))
            full.append(k)
            room -= k * int(size)
        return cell.assign(full=full)

    columns = ["pattern", "key", "size", "n", "draw", "cell", "left", "words_in", "full"]
    partly = placed.filter("left > 0 and left < words_in")
    walked = partly.groupBy("pattern", "cell").applyInPandas(
        walk,
        "pattern int, key string, size long, n long, draw long, cell long, left long, words_in long, "
        "full long",
    )
    out = whole.select(columns).unionByName(none.select(columns)).unionByName(walked.select(columns))
    return out.select("pattern", "key", "size", "n", "full")


@dataclass
class Mixed:
    """``documents``: (key, sources, size, n, taken) with n equal rows; ``sources``: per source."""

    documents: DataFrame
    sources: list[tuple[str | None, int, float]]
    flow: Flow


def mix(
    documents: DataFrame,
    sources: Column,
    key: Column,
    size: Column,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = 1.5,
    most: int = 2,
    seed: int = 7,
    rows_per_cell: int = 1000,
) -> Mixed:
    """Take words of documents so that each source comes near its share.

    ``sources`` is an array of names; a document of several counts towards any of them. Names go
    by code point, null last, and weigh ``weights`` in turn. They share ``share`` times all words;
    no target exceeds ``most`` times its source's words and no document is taken more than ``most``
    times. Equal rows (key, sources and size) are one unit with a count, dealt out row by row, so
    ties and repeated rows are settled. Empty documents and empty tables take nothing. Only
    sizes move: texts are neither shuffled nor kept.
    """
    spark = documents.sparkSession
    units = stored(
        documents.select(
            key.cast("string").alias("key"), F.array_sort(F.array_distinct(sources)).alias("sources"), size.alias("size")
        )
        .groupBy("key", "sources", "size")
        .agg(F.count("*").alias("n")),
        "mix-units",
    )
    # one row per set of sources: what the driver works on
    table = units.groupBy("sources").agg(F.sum(F.col("size") * F.col("n")).alias("words")).collect()
    table = sorted(table, key=lambda r: [(s is None, s or "") for s in r["sources"]])
    names = sorted({s for r in table for s in r["sources"]}, key=lambda s: (s is None, s or ""))
    at = {s: k for k, s in enumerate(names)}
    members = [[at[s] for s in r["sources"]] for r in table]
    sizes = [int(r["words"]) for r in table]
    of_source = [sum(w for w, m in zip(sizes, members, strict=True) if k in m) for k in range(len(names))]
    targets = water_fill(
        of_source, [weights[k % len(weights)] for k in range(len(names))], share * sum(sizes), most
    )
    flow = route(sizes, members, [round(t) for t in targets], lambda r: r * r, most)
    wholly = [sum(g == w for g in given) if w else 0 for given, w in zip(flow.given, sizes, strict=True)]
    partly = [
        next((g for g in given if g < w), 0) if w else 0
        for given, w in zip(flow.given, sizes, strict=True)
    ]
    patterns = spark.createDataFrame(
        [(k, list(r["sources"]), w, p) for k, (r, w, p) in enumerate(zip(table, wholly, partly, strict=True))],
        "pattern int, sources array<string>, wholly long, words long",
    )
    # arrays with nulls do not compare in joins as wanted, so they are joined as text
    name = F.to_json(F.struct("sources"))
    known = units.withColumn("_name", name).join(
        F.broadcast(patterns.select("pattern", "wholly", name.alias("_name"))), "_name"
    )
    chosen = choose(
        known.select("pattern", "key", "size", "n"), patterns.select("pattern", "words"), rows_per_cell, seed
    )
    kind = documents.select(key.alias("key")).schema["key"].dataType
    out = (
        chosen.join(F.broadcast(patterns.select("pattern", "sources", "wholly")), "pattern")
        # equal rows are dealt out in lots, so no list grows with them
        .withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / EQUAL_ROWS).cast("long") - 1)))
        .withColumn(
            "copies",
            F.transform(
                F.sequence(F.col("_lot") * EQUAL_ROWS + 1, F.least(F.col("n"), (F.col("_lot") + 1) * EQUAL_ROWS)),
                lambda i: F.col("wholly") + F.when(i <= F.col("full"), 1).otherwise(0),
            ),
        )
        .select(F.col("key").cast(kind), "sources", "size", F.explode("copies").alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
    return Mixed(out, [(s, of_source[k], targets[k]) for k, s in enumerate(names)], flow)


def mix_documents(documents: DataFrame, **options) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``: one row per row of ``documents``.

    Null texts have size 0, null sources are a source of their own.
    """
    mixed = mix(
        documents, F.array(F.col("source").cast("string")), F.col("doc_id").cast("long"),
        count_words(F.col("text").cast("string")), **options,
    )
    sources = documents.sparkSession.createDataFrame(
        [(s, size, float(t)) for s, size, t in mixed.sources], "source string, source_size long, target double"
    )
    rows = mixed.documents.withColumn("_source", F.get("sources", F.lit(0)))
    return rows.join(F.broadcast(sources), F.col("_source").eqNullSafe(F.col("source"))).select(
        F.col("key").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def mixed_rows(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as it is taken, with its own columns; untaken rows go.

    Rows alike in doc_id, text and source are taken together. Rows without words are not taken.
    """
    key = F.xxhash64(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)),
        *(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("text", "source")),
    )
    units = (
        documents.select(
            key.alias("key"), F.array(F.col("source").cast("string")).alias("sources"),
            count_words(F.col("text").cast("string")).alias("size"),
        )
        .groupBy("key", "sources")
        .agg(F.sum("size").alias("size"))
    )
    mixed = mix(units, F.col("sources"), F.col("key"), F.col("size"), **options)
    copies = mixed.documents.filter("taken > 0").select(F.col("key").alias("_mix_key"), "copies")
    return (
        documents.withColumn("_mix_key", key)
        .join(copies, "_mix_key")
        .withColumn("_mix_copy", F.explode(F.expr("sequence(1L, copies)")))
        .select(*documents.columns)
    )
