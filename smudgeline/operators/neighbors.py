"""Exact nearest catalog lines by cosine.

Every query meets the catalog in blocks: the two sides are brought together by an equi-join
on (cell, catalog chunk, query chunk), one matrix product per pair of chunks, and only the
best k of each pair leave the task. A catalog larger than one cell is cut around pivots; a
query then visits only cells that can still hold one of its k nearest (triangle inequality
and the plane between two pivots), nearest first and in rounds, which keeps the answer exact.
Where the cells left for the last round hold much of all pairs, the pivots rule out too little: the queries
then meet the whole catalog in large blocks, with the k-th best so far as the least a line must reach.

Both sides of a grid of blocks are copied, so their number is bounded however many rows there are: chunks
grow with the input until they are full, and what is moved grows as the input does until then. Where
full chunks of queries would have a whole catalog copied more often, neither side is copied any more: rows are
packed, a task holds some blocks of queries and reads the blocks of the catalog one after the other, and each
query leaves with its best k of all of them. The first rounds by cells would copy as much there, so a few queries
tell before how much pivots can rule out; where that is too little, there are no rounds.

Within a block most pairs are ruled out before their cosine is worked out exactly: a product of
short coordinates (the leading principal directions and, as one more, the length of what is left of
each vector) is never less than the cosine, and only pairs where it reaches the k-th best so far are
scored. The k-th best is known from the pairs that look best, and rises from tile to tile and round to
round.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import draws
from ..session import stored

#: bytes of vectors one chunk of a block may hold
CHUNK_BYTES = 32 << 20
#: most pivots, and so the most vectors the driver ever holds
MAX_PIVOTS = 256
#: digits of a cosine that count; closer ones are ties, settled by id
DIGITS = 9
#: what rounding may add to a distance
SLACK = 1e-6

#: rows the principal directions are taken from, and the share of their squares these hold
SAMPLE, HELD = 4096, 0.95
#: vectors of up to so many components are short coordinates themselves
SHORT = 256
#: what single precision may take off a cosine
COARSE = 1e-5
#: cells a query visits in each round after its own, before all that are left
ROUNDS = (8,)
#: chunks a side has at most before they are full: over a whole catalog, and in each of many cells
COPIES, CELL_COPIES = 32, 4
#: rows a block may answer with, for its queries together
ANSWERS = 1 << 20
#: bytes of vectors in a packed block of lines, rows of one at most, and rows of a block of queries
PACKED_BYTES, PACKED_ROWS, PACKED_QUERIES = 16 << 20, 1 << 16, 1 << 14
#: lines one task keeps ids and carried columns of, until those that are among no query's best are dropped
PART_LINES = 1 << 21
#: queries of which it is found out what pivots rule out, where a search by cells would copy much
PROBES = 1024
#: share of all pairs left to the last round from which the whole catalog is met instead
WHOLE = 0.25
#: rows of queries by cells made at a time
_VISITS = 1 << 16

#: pairs found since the best were sorted last are sorted in when they are more than this part of them
MERGED = 8
_TILE, _LINES = 512, 1024
_PAIRS = 1 << 15

log = logging.getLogger(__name__)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(vectors: np.ndarray, is_query: bool, order: np.ndarray | None = None) -> np.ndarray:
    """Unit rows, in ``order`` if given. Zero rows get a direction of their own, at a right angle to all others."""
    n, dims = vectors.shape
    out = np.zeros((n, dims + 2))
    # tile by tile: nothing but the result is as large as the chunk in double precision
    for at in range(0, n, _TILE):
        part = slice(at, at + _TILE)
        rows = (vectors[part] if order is None else vectors[order[part]]).astype(float)
        lengths = np.linalg.norm(rows, axis=1, keepdims=True)
        out[part, :dims] = rows / np.where(lengths == 0, 1, lengths)
        out[part, dims + (0 if is_query else 1)] = lengths[:, 0] == 0
    return out


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _short(vectors: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    """Coordinates whose products are, but for rounding, at least the cosines of unit vectors."""
    if axes is None:
        return vectors.astype(np.float32)
    along = vectors @ axes
    left = np.sqrt(np.maximum(np.sum(vectors * vectors, axis=1) - np.sum(along * along, axis=1), 0))
    return np.column_stack([along, left]).astype(np.float32)


def _cosines(queries: np.ndarray, lines: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Exact cosines of pairs of unit vectors, to nine digits."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), _PAIRS):
        part = slice(at, at + _PAIRS)
        out[part] = np.einsum("ij,ij->i", queries[rows[part]], lines[cols[part]])
    return np.round(out, DIGITS)


def _first(rows: np.ndarray, cols: np.ndarray, sims: np.ndarray, k: int):
    """The k best pairs of each row, ties to the lower column."""
    # cosines have nine digits, so row and cosine make one whole number
    order = np.lexsort((cols, (rows << 32) + np.rint((1 - sims) * 10.0**DIGITS).astype(np.int64)))
    rows, cols, sims = rows[order], cols[order], sims[order]
    starts = np.searchsorted(rows, np.arange(int(rows.max()) + 1 if len(rows) else 0))
    keep = np.arange(len(rows)) - starts[rows] < k
    return rows[keep], cols[keep], sims[keep]


def _places(flags: np.ndarray) -> np.ndarray:
    """Where flags are set, most of them not being so: looked through eight at a time."""
    whole = len(flags) // 8 * 8
    eights = np.flatnonzero(flags[:whole].view(np.uint64))
    places = (eights[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([places[flags[places]], whole + np.flatnonzero(flags[whole:])])


def _raise(kth: np.ndarray, held: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> None:
    """Take the k-th best held of each row for what its lines must reach."""
    counts = np.bincount(held[0], minlength=len(kth))
    full = np.flatnonzero(counts >= k)
    kth[full] = np.maximum(kth[full], held[2][np.cumsum(counts)[full] - 1])


def top_pairs(
    queries: np.ndarray,
    lines: np.ndarray,
    k: int,
    axes: np.ndarray | None,
    floor: np.ndarray,
    known: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    start: int = 0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, columns and cosines of the k best lines of each query at ``floor`` or above, and pairs scored.

    ``known`` are the best of other lines, as they were returned for those; columns count from ``start``.
    """
    # short vectors are taken as they are, tile by tile; of others the coordinates are kept
    kept = None if axes is None else _short(lines, axes)
    found, scored = [], 0
    # one product after the other in the same memory
    room = np.empty(_TILE * _LINES, np.float32), np.empty(_TILE * _LINES, bool)
    for q in range(0, len(queries), _TILE):
        tile, kth = queries[q : q + _TILE], floor[q : q + _TILE].copy()
        short = _short(tile, axes)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if known is not None:
            own = slice(*np.searchsorted(known[0], (q, q + len(tile))))
            held = known[0][own] - q, known[1][own], known[2][own]
            _raise(kth, held, k)
        fresh, waiting = [], 0
        for c in range(0, len(lines), _LINES):
            part = slice(c, c + _LINES)
            right = (_short(lines[part], None) if kept is None else kept[part]).T
            shape = len(tile), right.shape[1]
            near, is_near = (r[: shape[0] * shape[1]].reshape(shape) for r in room)
            np.matmul(short, right, out=near)
            if c == 0 and near.shape[1] > k and np.isneginf(kth).any():
                # the pairs that look best tell how good the k-th is at least, where nothing does yet
                likely = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
                sims = _cosines(tile, lines, np.repeat(np.arange(len(tile)), k), likely.ravel())
                kth = np.maximum(kth, sims.reshape(-1, k).min(axis=1))
            np.greater_equal(near, (kth - COARSE).astype(np.float32)[:, None], out=is_near)
            rows, cols = np.divmod(_places(is_near.ravel()), shape[1])
            scored += len(rows)
            sims = _cosines(tile, lines[c : c + _LINES], rows, cols)
            good = sims >= kth[rows]
            fresh.append((rows[good], cols[good] + (start + c), sims[good]))
            waiting += len(fresh[-1][0])
            # sorted in once they are many, as all that is held is sorted again
            if fresh and (waiting * MERGED > len(held[0]) or c + _LINES >= len(lines)):
                held = _first(*(np.concatenate(x) for x in zip(held, *fresh, strict=True)), k)
                fresh, waiting = [], 0
                _raise(kth, held, k)
        found.append((held[0] + q, held[1], held[2]))
    return (*(np.concatenate(x) for x in zip(*found, strict=True)), scored)


def _block_top_k(k: int, carry: tuple[str, ...], axes: np.ndarray | None):
    """Best k of one catalog chunk for each query of one query chunk."""

    def top(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return result(left, right, np.array([], int), np.array([], int), np.array([]))
        # by id, so ties go to the lower one; the vectors are not copied for it
        order = pc.sort_indices(right["near_id"]).to_numpy()
        queries, lines = _unit(_matrix(left["vec"]), True), _unit(_matrix(right["vec"]), False, order)
        floor = left["floor"].to_numpy().astype(float)
        rows, cols, sims, _ = top_pairs(queries, lines, k, axes, floor)
        return result(left, right, rows, order[cols], sims)

    def result(left, right, rows, cols, sims) -> pa.Table:
        columns = {"query_id": left.column("query_id").take(pa.array(rows, pa.int64()))}
        at = pa.array(cols.astype(np.int64))
        for name in ("near_id", *carry):
            columns[name] = right.column(name).take(at)
        # adding zero turns a negative zero into a plain one
        columns["cosine"] = pa.array(sims + 0.0, pa.float64())
        return pa.table(columns)

    return top


def _meet(
    queries: DataFrame,
    catalog: DataFrame,
    k: int,
    chunks: list[int],
    query_chunks: list[int],
    carry: tuple[str, ...],
    axes: np.ndarray | None = None,
) -> DataFrame:
    """Bring queries and catalog together per cell and keep the best k of each meeting.

    Both sides carry ``cell``, queries also ``floor``, the cosine a line must reach; ``chunks[cell]`` catalog chunks and ``query_chunks[cell]``
    query chunks bound what one task holds, however full a cell is. A cell no query visits
    has no query chunks, and its lines go nowhere.
    """
    n, m = (F.get(F.lit(sizes), F.col("cell")) for sizes in (chunks, query_chunks))
    keys = ["cell", "chunk", "query_chunk"]
    left = queries.select(
        "query_id",
        "vec",
        "floor",
        "cell",
        F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk"),
        F.pmod(F.xxhash64("query_id"), m).cast("int").alias("query_chunk"),
    )
    right = catalog.filter(m > 0).select(
        "near_id",
        *carry,
        "vec",
        "cell",
        F.pmod(F.xxhash64("near_id"), n).cast("int").alias("chunk"),
        F.explode(F.sequence(F.lit(0), m - 1)).alias("query_chunk"),
    )
    types = {f.name: f.dataType.simpleString() for f in [*left.schema, *right.schema]}
    return (
        left.groupBy(keys)
        .cogroup(right.groupBy(keys))
        .applyInArrow(
            _block_top_k(k, carry, axes),
            ", ".join(f"{n} {types[n]}" for n in ("query_id", "near_id", *carry))
            + ", cosine double",
        )
    )


def _packed(df: DataFrame, vec: str, number: str, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` rows that lie together: ``vec`` as bytes, other columns as arrays, ``number`` rising."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"`{n}` binary" if n == vec else f"`{n}` array<{t}>" for n, t in kinds.items())

    def block(some: pa.Table) -> pa.RecordBatch:
        columns = []
        for name in kinds:
            values = some.column(name)
            if name == vec:
                columns.append(pa.array([_matrix(values).astype(np.float32).tobytes()], pa.binary()))
            else:
                ends = pa.array([0, some.num_rows], pa.int32())
                columns.append(pa.ListArray.from_arrays(ends, pa.concat_arrays(values.chunks)))
        return pa.RecordBatch.from_arrays(columns, list(kinds))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, n = [], 0
        for batch in batches:
            waiting.append(batch)
            n += batch.num_rows
            while n >= rows:
                whole = pa.Table.from_batches(waiting)
                yield block(whole.slice(0, rows))
                n -= rows
                waiting = whole.slice(rows).to_batches()
        if n:
            yield block(pa.Table.from_batches(waiting))

    return df.mapInArrow(pack, schema).withColumn(number, F.monotonically_increasing_id())


class _Asked:
    """Queries of a packed block, those of one vector as one, and the best lines of each so far."""

    def __init__(self, ids: pa.Array, vectors: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.k = ids, k
        as_bytes = np.dtype((np.void, vectors.dtype.itemsize * max(vectors.shape[1], 1)))
        same = vectors.view(as_bytes).ravel() if vectors.shape[1] else np.zeros(len(ids))
        _, first, self.which = np.unique(same, return_index=True, return_inverse=True)
        self.unit = _unit(vectors[first], True)
        self.floor = np.full(len(first), np.inf)
        np.minimum.at(self.floor, self.which, floor)
        # rows, places in the catalog and cosines
        self.best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, lines: np.ndarray, start: int, axes: np.ndarray | None) -> None:
        """Take in a block of lines, which stand one after the other from ``start`` on."""
        *self.best, _ = top_pairs(self.unit, lines, self.k, axes, self.floor, self.best, start)

    def answers(self, known: np.ndarray, lines: pa.Table) -> Iterator[pa.RecordBatch]:
        """Best lines of each query, first ones first; ``lines`` are those of the places ``known``."""
        rows, places, sims = self.best
        counts = np.bincount(rows, minlength=len(self.unit))
        begins = np.cumsum(counts) - counts
        some = max(1, _PAIRS // self.k)
        for begin in range(0, len(self.ids), some):
            which = self.which[begin : begin + some]
            n = counts[which]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(begins[which], n) + nth
            line = pa.array(np.searchsorted(known, places[at]))
            columns = {"query_id": self.ids.take(pa.array(np.repeat(np.arange(begin, begin + len(which)), n)))}
            columns |= {name: lines.column(name).take(line) for name in lines.column_names}
            # adding zero turns a negative zero into a plain one
            columns["cosine"] = pa.array(sims[at] + 0.0)
            columns["place"] = pa.array((nth + 1).astype(np.int32))
            yield from pa.table(columns).combine_chunks().to_batches()


class _Lines:
    """Ids and carried columns of the lines read so far that are among a query's best, by their places."""

    def __init__(self, names: tuple[str, ...]):
        self.names, self.whole = names, {}
        self.places, self.few = np.zeros(0, np.int64), None

    def take_in(self, number: int, values: list[pa.Array], asked: dict[int, _Asked]) -> None:
        """Keep all of a block; the blocks before it are gone through once they are many."""
        if sum(len(v[0]) for v in self.whole.values()) + len(values[0]) > max(PART_LINES, len(self.places)):
            self.drop(asked)
        self.whole[number] = values

    def drop(self, asked: dict[int, _Asked]) -> None:
        """Keep only lines that are among the best of a query."""
        places = [self.places, *(n * PACKED_ROWS + np.arange(len(v[0])) for n, v in self.whole.items())]
        tables = [] if self.few is None else [self.few]
        tables += [pa.table(v, names=list(self.names)) for v in self.whole.values()]
        known, first = np.unique(np.concatenate(places), return_index=True)
        self.places = np.unique(np.concatenate([q.best[1] for q in asked.values()]))
        at = first[np.searchsorted(known, self.places)]
        self.few = pa.concat_tables(tables).take(pa.array(at)).combine_chunks()
        self.whole = {}


def _search_blocks(k: int, names: tuple[str, ...], axes: np.ndarray | None):
    """Best k lines for each query of some packed blocks, over all packed lines that come with them."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, kept, last, lines = {}, _Lines(names), None, None
        for batch in batches:
            vectors = {name: batch.column(name) for name in ("query_vec", "line_vec")}
            numbers = [batch.column(name).to_pylist() for name in ("query_block", "line_block")]

            def values(name: str, row: int) -> pa.Array:
                # copied, or the whole batch would stay in memory
                some = batch.column(name).slice(row, 1).flatten()
                return some.take(pa.array(np.arange(len(some))))

            def matrix(name: str, row: int, n: int) -> np.ndarray:
                return np.frombuffer(vectors[name][row].as_buffer(), np.float32).reshape(n, -1)

            for row, (query_block, line_block) in enumerate(zip(*numbers, strict=True)):
                if query_block not in asked:
                    ids, floor = values("query_id", row), values("floor", row).to_numpy()
                    asked[query_block] = _Asked(ids, matrix("query_vec", row, len(ids)), floor, k)
                if line_block not in kept.whole:
                    kept.take_in(line_block, [values(name, row) for name in names], asked)
                if line_block != last:
                    last, lines = line_block, _unit(matrix("line_vec", row, len(kept.whole[line_block][0])), False)
                asked[query_block].meet(lines, line_block * PACKED_ROWS, axes)
        if not asked:
            return
        kept.drop(asked)
        for queries in asked.values():
            yield from queries.answers(kept.places, kept.few)

    return search


def _line_blocks(catalog: DataFrame, n: int, dims: int) -> DataFrame:
    """The catalog in packed blocks, stored."""
    rows = max(1, min(PACKED_ROWS, PACKED_BYTES // (4 * dims)))
    # in order of ids, so that ties are settled by where lines stand
    ordered = catalog.withColumnRenamed("vec", "line_vec").repartitionByRange(
        math.ceil(n / max(rows, CHUNK_BYTES // (4 * dims))), "near_id"
    )
    return stored(_packed(ordered.sortWithinPartitions("near_id"), "line_vec", "line_block", rows), "line_blocks")


def _stream(
    queries: DataFrame,
    lines: DataFrame,
    k: int,
    n_queries: int,
    dims: int,
    types: dict[str, str],
    axes: np.ndarray | None,
    parts: int = 1,
) -> DataFrame:
    """The best k of the whole catalog, where neither side is copied; ``lines`` come from :func:`_line_blocks`.

    Both sides are packed. Each task reads some blocks of queries and all blocks of the catalog, where they lie. A
    catalog is cut into ``parts`` only for queries too few to fill tasks, and their answers are merged. Queries are
    read twice, to deal their blocks out evenly. ``types`` has the ids and what lines carry, in the order of the result.
    """
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # what a task holds: vectors and answers of its queries
    fits = max(1, min(CHUNK_BYTES // (4 * dims), 4 * ANSWERS // k))
    rows = max(1, min(PACKED_ROWS, PACKED_BYTES // (4 * dims), fits, PACKED_QUERIES))
    blocks, some = math.ceil(n_queries / rows), fits // rows
    asked = _packed(
        queries.select("query_id", F.col("vec").alias("query_vec"), "floor"), "query_vec", "query_block", rows
    )
    dealt = asked.repartitionByRange(max(math.ceil(blocks / some), min(blocks, tasks)), "query_block")
    schema = ", ".join(f"`{name}` {kind}" for name, kind in types.items()) + ", cosine double, place int"
    met = lines.coalesce(parts).crossJoin(dealt.hint("shuffle_replicate_nl"))
    found = met.mapInArrow(_search_blocks(k, tuple(types)[1:], axes), schema)
    return found if parts == 1 else _merge(found.drop("place"), k)


def _types(queries: DataFrame, catalog: DataFrame, carry: tuple[str, ...]) -> dict[str, str]:
    types = {f.name: f.dataType.simpleString() for f in [*queries.schema, *catalog.schema]}
    return {name: types[name] for name in ("query_id", "near_id", *carry)}


def _merge(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "near_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _assign(df: DataFrame, pivots: np.ndarray, is_query: bool) -> DataFrame:
    """Add the nearest pivot's ``cell`` and the distance to it."""
    fields = [(f.name, f.dataType.simpleString()) for f in df.schema]
    schema = ", ".join(f"{n} {t}" for n, t in fields) + ", cell int, away double"

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            far = _distances(_unit(_matrix(batch.column("vec")), is_query), pivots)
            cell = far.argmin(axis=1)
            columns = [batch.column(n) for n, _ in fields]
            columns += [
                pa.array(cell.astype(np.int32)),
                pa.array(far[np.arange(len(far)), cell]),
            ]
            yield pa.RecordBatch.from_arrays(columns, [n for n, _ in fields] + ["cell", "away"])

    return df.mapInArrow(assign, schema)


def _open_cells(
    queries: DataFrame,
    pivots: np.ndarray,
    inner: np.ndarray,
    outer: np.ndarray,
    seen: int,
    step: int | None,
    counted: bool = False,
) -> DataFrame:
    """One row per query and cell of its next ``step`` nearest that may hold a line above ``floor``.

    A query's cells come in order of the least distance a line of theirs can have; ``seen`` of them
    have been visited, its own not counted. With ``counted`` the result is ``(cell, n)``, rows to be added up.
    """
    between = _distances(pivots, pivots)
    kind = queries.schema["query_id"].dataType.simpleString()

    # as many queries at a time as may open all cells
    some = max(1, _VISITS // len(pivots))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, some):
                batch = whole.slice(at, some)
                far = _distances(_unit(_matrix(batch.column("vec")), True), pivots)
                home = batch.column("cell").to_numpy(zero_copy_only=False)
                floor = batch.column("floor").to_numpy(zero_copy_only=False)
                bound = np.sqrt(np.maximum(2 - 2 * floor, 0))
                ring = np.maximum(far - outer[None, :], inner[None, :] - far)
                own = far[np.arange(len(far)), home]
                apart = np.maximum(between[home], 1e-12)
                plane = (far**2 - own[:, None] ** 2) / (2 * apart)
                least = np.maximum(np.maximum(ring, plane), 0)
                least[:, ~np.isfinite(outer)] = np.inf
                least[np.arange(len(far)), home] = -1  # visited first, with or without lines
                order = np.argsort(least, axis=1, kind="stable")[:, 1 + seen :][:, :step]
                rows = np.repeat(np.arange(len(far)), order.shape[1])
                cells = order.ravel()
                is_open = (least[rows, cells] <= bound[rows] + SLACK) & np.isfinite(outer)[cells]
                rows, cells = rows[is_open], cells[is_open].astype(np.int32)
                if counted:
                    held, n = np.unique(cells, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(n.astype(np.int64))], ["cell", "n"])
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("query_id").take(pa.array(rows)),
                        batch.column("vec").take(pa.array(rows)),
                        pa.array(floor[rows]),
                        pa.array(cells),
                    ],
                    ["query_id", "vec", "floor", "cell"],
                )

    if counted:
        return queries.mapInArrow(visit, "cell int, n long")
    return queries.mapInArrow(visit, f"query_id {kind}, vec array<float>, floor double, cell int")


def _axes(lines: DataFrame, dims: int) -> np.ndarray | None:
    """Leading principal directions of a bounded sample; None where vectors are short enough."""
    if dims <= SHORT:
        return None
    drawn = lines.orderBy(draws.base(7, F.col("near_id")), "near_id").limit(SAMPLE).select("vec").collect()
    sample = _unit(np.array([r["vec"] for r in drawn], dtype=float).reshape(len(drawn), -1), False)
    held, axes = np.linalg.eigh(sample.T @ sample)
    share = np.cumsum(held[::-1]) / max(held.sum(), 1e-12)
    return axes[:, ::-1][:, : int(np.searchsorted(share, HELD)) + 1].copy()


def nearest(
    queries: DataFrame,
    catalog: DataFrame,
    k: int,
    query_id: str = "query_id",
    near_id: str = "cat_id",
    vec: str = "vec",
    chunk_rows: int | None = None,
    cell_rows: int | None = None,
    max_pivots: int = MAX_PIVOTS,
    carry: tuple[str, ...] = (),
    visits: list[dict] | None = None,
) -> DataFrame:
    """``(query_id, near_id, cosine, place)``: the k catalog vectors nearest to each query.

    Catalog columns named in ``carry`` come along, which saves joining them back.

    ``k`` is held between 1 and the size of the catalog. Cosines are rounded to nine digits;
    ties go to the lower id. Zero vectors have cosine 0 with everything. ``visits`` takes a row for each
    round of a search by cells: cells and pairs visited, and how many there are. ``chunk_rows`` is what a chunk
    aims at: more where there would be more than ``COPIES`` chunks of a side, never more than ``CHUNK_BYTES``.
    """
    left = queries.select(
        F.col(query_id).alias("query_id"),
        F.col(vec).cast("array<float>").alias("vec"),
        F.lit(float("-inf")).alias("floor"),
    )
    right = catalog.select(
        F.col(near_id).alias("near_id"), *carry, F.col(vec).cast("array<float>").alias("vec")
    )
    n, n_queries = right.count(), left.count()
    one = right.select(F.size("vec").alias("d")).first()
    dims = max(int(one["d"]), 1) if one else 1
    k = max(1, min(k, n))
    fits = max(1024, CHUNK_BYTES // (4 * dims))
    chunk_rows = chunk_rows or fits
    cell_rows = cell_rows or 4 * fits
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # enough query chunks to use the cluster; each one has the catalog copied for it
    query_rows = max(1024, math.ceil(n_queries / tasks))
    query_fits = max(1024, min(fits, ANSWERS // k))
    n_pivots = min(max_pivots, n // cell_rows)
    axes = _axes(right, dims)
    # full chunks of queries have the catalog copied more often than copies are allowed
    is_full = math.ceil(n_queries / query_fits) > COPIES
    # of so few cells a query may visit all before it is known what they rule out
    if is_full and n_pivots <= 1 + sum(ROUNDS):
        out = _stream(left, _line_blocks(right, n, dims), k, n_queries, dims, _types(left, right, carry), axes)
    elif n_pivots < 2:
        found = _meet(
            left.withColumn("cell", F.lit(0)),
            right.withColumn("cell", F.lit(0)),
            k,
            [max(1, _chunks(n, chunk_rows, fits, COPIES))],
            [max(1, _chunks(n_queries, min(chunk_rows, query_rows), query_fits, COPIES))],
            carry,
            axes,
        )
        out = _merge(found, k)
    else:
        out = _by_pivots(left, right, k, n_pivots, chunk_rows, query_rows, carry, axes, visits, fits, query_fits, n_queries if is_full else 0)
    return out.select(
        F.col("query_id").alias(query_id),
        F.col("near_id").alias(near_id),
        *carry,
        "cosine",
        "place",
    )


def _chunks(n: int, rows: int, fits: int, copies: int) -> int:
    """Chunks of about ``rows`` for n rows: no more than ``copies``, unless that many would hold over ``fits`` each."""
    return max(min(math.ceil(n / rows), copies), math.ceil(n / fits))


def _rows_per_cell(df: DataFrame, cells: int, count: Column | None = None) -> list[int]:
    """At most MAX_PIVOTS counts."""
    counts = [0] * cells
    for row in df.groupBy("cell").agg((F.count("*") if count is None else count).alias("n")).collect():
        counts[row["cell"]] = row["n"]
    return counts


def _by_pivots(
    left: DataFrame,
    right: DataFrame,
    k: int,
    n_pivots: int,
    chunk_rows: int,
    query_rows: int,
    carry: tuple[str, ...],
    axes: np.ndarray | None,
    visits: list[dict] | None,
    fits: int,
    query_fits: int,
    n_full: int = 0,
) -> DataFrame:
    """Search by cells. ``n_full`` queries fill so many chunks that the first rounds are dear: probed before."""
    drawn = right.orderBy(draws.base(7, F.col("near_id")), "near_id").limit(n_pivots)
    vectors = np.array([r["vec"] for r in drawn.select("vec").collect()], dtype=float)
    pivots = np.unique(_unit(vectors, False), axis=0)
    cells = len(pivots)
    # both sides are read several times from here on
    lines = stored(_assign(right, pivots, False), "lines")
    sizes = _rows_per_cell(lines, cells)
    inner, outer = np.zeros(cells), np.full(cells, np.inf)
    rings = lines.groupBy("cell").agg(F.min("away").alias("inner"), F.max("away").alias("outer"))
    for row in rings.collect():
        inner[row["cell"]], outer[row["cell"]] = row["inner"], row["outer"]
    dims, types = vectors.shape[1], _types(left, right, carry)
    if n_full:
        blocks = _line_blocks(lines.drop("away", "cell"), sum(sizes), dims)
        probes = stored(_assign(left.orderBy(draws.base(7, F.col("query_id")), "query_id").limit(PROBES), pivots, True), "probes")
        n_probes, parts = min(PROBES, n_full), blocks.rdd.getNumPartitions()
        best = _stream(probes, blocks, k, n_probes, dims, types, axes, parts)
        # what is left even if the k-th best were known from the start
        known = probes.drop("floor").join(best.groupBy("query_id").agg(F.min("cosine").alias("floor")), "query_id")
        left_over = _rows_per_cell(_open_cells(known, pivots, inner, outer, 0, None, counted=True), cells, F.sum("n"))
        share = sum(a * b for a, b in zip(left_over, sizes, strict=True)) / max(n_probes * sum(sizes), 1)
        if share > WHOLE:
            log.info("search by cells: the whole catalog at once, %.2f of all pairs beside own cells", share)
            if visits is not None:
                visits.append({
                    "round": 0, "cells": n_full * sum(n > 0 for n in sizes), "pairs": n_full * sum(sizes),
                    "of_cells": n_full * sum(n > 0 for n in sizes), "of_pairs": n_full * sum(sizes),
                })
            return _stream(left, blocks, k, n_full, dims, types, axes)
    at_home = stored(_assign(left, pivots, True).drop("away"), "queries")
    copies = max(CELL_COPIES, math.ceil(COPIES / cells))
    # a query at home in an empty cell has nothing to meet there
    chunks = [max(1, _chunks(n, chunk_rows, fits, copies)) for n in sizes]
    found, asked = None, at_home
    seen = 0
    for turn, step in enumerate((0, *ROUNDS, None)):
        if turn:
            kth = (
                found.groupBy("query_id")
                .agg(F.min("cosine").alias("_least"), F.count("*").alias("_n"))
                .filter(F.col("_n") >= k)
                .select("query_id", F.col("_least").alias("floor"))
            )
            bounded = at_home.drop("floor").join(kth, "query_id", "left").fillna(float("-inf"), ["floor"])
            if step is None:
                left_over = _open_cells(bounded, pivots, inner, outer, seen, step, counted=True)
                visited = _rows_per_cell(left_over, cells, F.sum("n"))
                pairs = sum(a * b for a, b in zip(visited, sizes, strict=True))
                if pairs > WHOLE * n_queries * sum(sizes):
                    report = {
                        "round": turn, "cells": sum(visited), "pairs": n_queries * sum(sizes),
                        "of_cells": n_queries * sum(n > 0 for n in sizes), "of_pairs": n_queries * sum(sizes),
                    }
                    log.info("search by cells: the whole catalog, %s", report)
                    if visits is not None:
                        visits.append(report)
                    # every line that reaches a query's floor is found again, so this is all of the answer
                    if n_full:
                        asked = stored(bounded.select("query_id", "vec", "floor"), "bounded")
                        return _stream(asked, blocks, k, n_queries, dims, types, axes)
                    met = _meet(
                        bounded.select("query_id", "vec", "floor", F.lit(0).alias("cell")),
                        lines.drop("away").withColumn("cell", F.lit(0)),
                        k,
                        [_chunks(sum(sizes), fits, fits, COPIES)],
                        [_chunks(n_queries, query_rows, query_fits, COPIES)],
                        carry,
                        axes,
                    )
                    return _merge(met, k)
            # read twice: to count its rows and to meet
            asked = stored(_open_cells(bounded, pivots, inner, outer, seen, step), "further")
            seen += step or cells
        visited = _rows_per_cell(asked, cells)
        report = {
            "round": turn, "cells": sum(visited),
            "pairs": sum(a * b for a, b in zip(visited, sizes, strict=True)),
        }
        if not turn:
            n_queries = report["cells"]
        report |= {"of_cells": n_queries * sum(n > 0 for n in sizes), "of_pairs": n_queries * sum(sizes)}
        log.info("search by cells: %s", report)
        if visits is not None:
            visits.append(report)
        if turn and not sum(visited):
            break
        asked_chunks = [_chunks(n, min(chunk_rows, query_rows), query_fits, copies) for n in visited]
        met = _meet(asked, lines, k, chunks, asked_chunks, carry, axes)
        both = met if found is None else found.unionByName(met)
        found = stored(_merge(both, k).drop("place"), "nearest")
    return _merge(found, k)


def nearest_lines(catalog: DataFrame, k: int = 10, **options) -> DataFrame:
    """``(cat_id, near_id, near, cosine, place)``: each line against the whole catalog.

    The line itself is normally among the k.
    """
    found = nearest(
        catalog.select(F.col("cat_id").alias("query_id"), "vec"),
        catalog.select(F.col("cat_id").alias("near_id"), F.col("canonical").alias("near"), "vec"),
        k,
        near_id="near_id",
        carry=("near",),
        **options,
    )
    return found.withColumnRenamed("query_id", "cat_id")


def shortlist(queries: DataFrame, catalog: DataFrame, k: int = 64, **options) -> DataFrame:
    """``(query_id, cat_id, candidate, cosine, place)``: the k lines nearest to each query."""
    lines = catalog.select("cat_id", F.col("canonical").alias("candidate"), "vec")
    return nearest(queries, lines, k, carry=("candidate",), **options)
