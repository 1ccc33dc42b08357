"""Hard negatives by angles: windows of scores first, integer scores only for rows that can fall in one.

Each row stores its angles to reference directions: the angle to the first, then that of what is left to
the second, and so on. For two rows the angles to all directions but the rest leave the cosine between
``c - r`` and ``c + r``: ``c`` from the law of cosines along the directions, ``r`` the product of the sines
of what no direction explains. That is the angular triangle inequality, applied where the rows are still
free. Times both norms and widened by all rounding it bounds the integer score; only rows whose bounds
overlap a window an anchor still asks for are scored.

Rows lie in blocks of like direction with a mean direction of their own; the angles of a block's rows to it
bound the cosine of a whole block. Blocks meet chunks of anchors in two rounds: the most promising block
of each anchor first, whose scores narrow the windows, then every block that still overlaps one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .topk import product, whole_numbers

#: rows of a block, anchors of a chunk, block summaries compared at once, copies of them
BLOCK, CHUNK, SUMMARIES, SALTS = 1024, 256, 256, 8
#: rows that the reference directions are taken from, and the share of their squares these hold
SAMPLE, SHARE = 4096, 0.8
#: a stored angle is off by at most this (32-bit floats up to pi)
ANGLE_STEP = 2.5e-7


def reference_directions(rows: DataFrame, sample: int = SAMPLE, share: float = SHARE) -> dict[int, np.ndarray]:
    """By number of components: orthogonal directions that hold ``share`` of the squares of a sample.

    They come from the ``sample`` rows with the smallest hashes of vec_id; they change which rows are
    scored, never a result.
    """
    taken = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("data").collect()
    out = {}
    for dims in {len(r["data"]) for r in taken} - {0}:
        data = np.array([r["data"] for r in taken if len(r["data"]) == dims])
        units = data / np.maximum(np.linalg.norm(data, axis=1, keepdims=True), 1e-9)
        weights, directions = np.linalg.eigh(units.T @ units)
        held = np.cumsum(weights[::-1]) / max(weights.sum(), 1e-9)
        out[dims] = directions.T[::-1][: int(np.searchsorted(held, share)) + 1].copy()
    return out


def angles_to(data: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Angles of each row: to the first direction, then of what is left of it to the next, and so on."""
    along = data @ directions.T
    squares = np.sum(data * data, axis=1)
    left = np.sqrt(np.maximum(squares[:, None] - np.cumsum(along * along, axis=1), 0))
    return np.arctan2(left, along).astype(np.float32)


def along_of(angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cosines to the directions, and the sine of what is left, of unit rows with these angles."""
    angles = angles.astype(np.float64)
    sines = np.cumprod(np.sin(angles), axis=1)
    before = np.concatenate([np.ones((len(angles), 1)), sines[:, :-1]], axis=1) if angles.shape[1] else sines
    left = sines[:, -1] if angles.shape[1] else np.ones(len(angles))
    return before * np.cos(angles), left


def score_bounds(
    angles: np.ndarray, norms: np.ndarray, other_angles: np.ndarray, other_norms: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Least and most integer score of each row with each other row; safe against all rounding."""
    (c, left), (d, other_left) = along_of(angles), along_of(other_angles)
    cosine = c @ d.T
    free = np.outer(left, other_left) + 2 * ANGLE_STEP * (angles.shape[1] + 2)
    scale = np.outer(norms, other_norms)
    return (cosine - free) * scale - 1, (cosine + free) * scale + 1


def block_bounds(units: np.ndarray, norms: np.ndarray, s: dict) -> tuple[np.ndarray, np.ndarray]:
    """Least and most integer score of each unit row with any row of each block."""
    angle = np.arccos(np.clip(units @ s["center"].T, -1, 1))
    slack = 1e-6
    nearest = np.maximum(np.maximum(s["near"] - angle, angle - s["far"]) - slack, 0)
    farthest = np.minimum(np.minimum(angle + s["far"], 2 * np.pi - angle - s["near"]) + slack, np.pi)
    low, high = np.cos(farthest), np.cos(nearest)
    least, most = s["least"] * norms[:, None], s["most"] * norms[:, None]
    return np.minimum(low * least, low * most) - 1, np.maximum(high * least, high * most) + 1


def vectors_of(lists: pa.Array, dims: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), dims)


def in_order(rows: DataFrame, directions: dict[int, np.ndarray]) -> DataFrame:
    """Rows with their angles, dealt and sorted by size, label and likeness; hot labels lie over many tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            angles, like = [b""] * len(lengths), np.ones(len(lengths), np.int32)
            for dims in np.unique(lengths).tolist():
                if dims in directions:
                    at = np.flatnonzero(lengths == dims)
                    got = angles_to(vectors_of(lists.take(pa.array(at)), dims), directions[dims])
                    for k, row in zip(at.tolist(), got, strict=True):
                        angles[k] = row.tobytes()
                    # the halves of the first angles name a cell of like rows
                    halves = got[:, :12] > np.pi / 2
                    like[at] = halves @ (1 << np.arange(halves.shape[1])) + (1 << halves.shape[1])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(angles, pa.binary()), pa.array(like, pa.int32())],
                names=["vec_id", "label", "data", "angles", "like"],
            )

    return rows.select("vec_id", "label", "data").mapInArrow(
        run, "vec_id long, label long, data array<double>, angles binary, like int"
    ).withColumn("dims", F.size("data"))


def matrix(lists: list[bytes], kind, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(lists), kind).reshape(len(lists), -1) if lists else np.zeros((0, dims), kind)


def blocks_of(placed: DataFrame, block: int) -> DataFrame:
    """One row per block: its rows as bytes, its labels, its direction and angles to it; stored."""
    names = ["block", "dims", "ids", "labels", "data", "angles", "norms", "center", "near", "far", "least", "most", "few"]
    kinds = [pa.string(), pa.int32(), *[pa.binary()] * 6, *[pa.float64()] * 4, pa.list_(pa.int64())]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = (batch.column(k).to_numpy() for k in (0, 1))
            dims = batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for left, right in zip(edges, edges[1:], strict=False):
                for first in range(left, right, block):
                    end, n = min(right, first + block), int(dims[left])
                    part = batch.slice(first, end - first)
                    data = vectors_of(part.column(2), n)
                    norms = np.sqrt(np.sum(data * data, axis=1))
                    units = data / np.maximum(norms, 1e-300)[:, None]
                    center = units.sum(axis=0)
                    size = np.linalg.norm(center)
                    center = center / size if size > 1e-9 else np.eye(1, n)[0]
                    away = np.arccos(np.clip(units @ center, -1, 1))
                    few = np.unique(labels[first:end])
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([v], t)
                            for v, t in zip(
                                (
                                    f"{n}-{ids[first]}", n, ids[first:end].tobytes(),
                                    labels[first:end].tobytes(), data.tobytes(),
                                    b"".join(part.column(3).to_pylist()), norms.tobytes(), center.tobytes(),
                                    away.min(), away.max(), norms.min(), norms.max(),
                                    few.tolist() if len(few) <= 16 else None,
                                ),
                                kinds, strict=True,
                            )
                        ],
                        schema=schema,
                    )

    # ids end the order, so rows that are all alike are dealt out too
    dealt = placed.repartitionByRange("dims", "label", "like", "vec_id").sortWithinPartitions(
        "dims", "label", "like", "vec_id"
    )
    return stored(
        dealt.select("vec_id", "label", "data", "angles", "dims").mapInArrow(
            run,
            "block string, dims int, ids binary, labels binary, data binary, angles binary, norms binary, "
            "center binary, near double, far double, least double, most double, few array<long>",
        ),
        "blocks",
    )


ASKING = "dims int, part int, ids binary, labels binary, data binary, angles binary, lows binary, highs binary"


def chunks_of(anchors: DataFrame, windows: int, chunk: int) -> DataFrame:
    """``ASKING`` rows of about ``chunk`` anchors each from rows with ``lows`` and ``highs`` of their windows."""
    schema = pa.schema(
        [("dims", pa.int32()), ("part", pa.int32()), *((n, pa.binary()) for n in ("ids", "labels", "data", "angles", "lows", "highs"))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(dims)) + 1).tolist(), len(dims)]
            for left, right in zip(edges, edges[1:], strict=False):
                for first in range(left, right, chunk):
                    part = batch.slice(first, min(right, first + chunk) - first)
                    ids = part.column(0).to_numpy()
                    values = [
                        int(dims[left]), int(ids[0] % (1 << 20)), ids.tobytes(), part.column(1).to_numpy().tobytes(),
                        vectors_of(part.column(2), int(dims[left])).tobytes(), b"".join(part.column(3).to_pylist()),
                        *(np.array(part.column(k).to_pylist(), np.float64).reshape(-1, windows).tobytes() for k in (5, 6)),
                    ]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], t) for v, t in zip(values, schema.types, strict=True)], schema=schema
                    )

    dealt = anchors.repartitionByRange("dims", "label", "like", "vec_id").sortWithinPartitions(
        "dims", "label", "like", "vec_id"
    )
    return dealt.select("vec_id", "label", "data", "angles", "dims", "lows", "highs").mapInArrow(run, ASKING)


def unpack(r: dict, windows: int) -> dict[str, np.ndarray]:
    """The anchors of an ``ASKING`` row as arrays, with their norms."""
    ids = np.frombuffer(r["ids"], np.int64)
    data = np.frombuffer(r["data"], np.float64).reshape(len(ids), r["dims"])
    return {
        "ids": ids, "labels": np.frombuffer(r["labels"], np.int64), "data": data,
        "angles": np.frombuffer(r["angles"], np.float32).reshape(len(ids), -1),
        "lows": np.frombuffer(r["lows"], np.float64).reshape(-1, windows),
        "highs": np.frombuffer(r["highs"], np.float64).reshape(-1, windows),
        "norms": np.sqrt(np.sum(data * data, axis=1)),
    }


def asked_blocks(chunks: DataFrame, summaries: DataFrame, groups: int, windows: int, same: bool, first: bool) -> DataFrame:
    """``block`` and the anchors that ask for it: the most promising one, or all whose bounds overlap a window."""
    names = ["block", *(f.split()[0] for f in ASKING.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a, s = unpack(r, windows), r["summaries"]
                packed = {k: np.array([x[k] for x in s]) for k in ("near", "far", "least", "most")}
                packed["center"] = matrix([x["center"] for x in s], np.float64, r["dims"])
                units = a["data"] / np.maximum(a["norms"], 1e-300)[:, None]
                least, most = block_bounds(units, a["norms"], packed)
                overlap = np.zeros(most.shape, bool)
                for w in range(windows):
                    overlap |= (most >= a["lows"][:, w, None]) & (least <= a["highs"][:, w, None])
                for b, x in enumerate(s):
                    if x["few"] is not None:
                        known = np.isin(a["labels"], x["few"])
                        overlap[:, b] &= known if same else ~known | (len(x["few"]) > 1)
                if first:
                    best = np.argmax(np.where(overlap, most, -np.inf), axis=1)
                    chosen = np.zeros_like(overlap)
                    chosen[np.arange(len(best)), best] = True
                    overlap &= chosen
                columns: list[list] = [[] for _ in names]
                for b in np.flatnonzero(overlap.any(axis=0)).tolist():
                    at = np.flatnonzero(overlap[:, b])
                    row = (s[b]["block"], r["dims"], r["part"], *(
                        a[k][at].tobytes() for k in ("ids", "labels", "data", "angles", "lows", "highs")
                    ))
                    for c, v in zip(columns, row, strict=True):
                        c.append(v)
                if columns[0]:
                    kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.binary()] * 6]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
                    )

    meeting = chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn(
        "salt", F.col("part") % SALTS
    )
    return meeting.join(summaries, ["dims", "group", "salt"]).drop("group", "salt").mapInArrow(run, f"block string, {ASKING}")


def best_in_block(a: dict, b: dict, k: int, same: bool) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(anchor, window, rows, scores)``: the first ``k`` rows of a block in each window of each anchor."""
    low, high = score_bounds(a["angles"], a["norms"], b["angles"], b["norms"])
    alike = a["labels"][:, None] == b["labels"][None, :]
    wanted = alike & (a["ids"][:, None] != b["ids"][None, :]) if same else ~alike
    overlap = np.zeros(wanted.shape, bool)
    for w in range(a["lows"].shape[1]):
        overlap |= (high >= a["lows"][:, w, None]) & (low <= a["highs"][:, w, None])
    wanted &= overlap
    out = []
    for at in range(len(wanted)):
        rows = np.flatnonzero(wanted[at])
        if not len(rows):
            continue
        scores = product(a["data"][at : at + 1], b["data"][rows])[0]
        order = np.lexsort((b["ids"][rows], -scores))
        rows, scores = rows[order], scores[order]
        for w in range(a["lows"].shape[1]):
            inside = np.flatnonzero((scores >= a["lows"][at, w]) & (scores <= a["highs"][at, w]))[:k]
            if len(inside):
                out.append((at, w, b["ids"][rows[inside]], scores[inside].astype(np.int64)))
    return out


FOUND = "anchor_id long, place int, vec_id long, score long"


def score_blocks(pairs: DataFrame, blocks: DataFrame, windows: int, k: int, same: bool) -> DataFrame:
    """``FOUND``: the first ``k`` rows in each window, block by block."""
    names = [f.split()[0] for f in FOUND.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = unpack(r, windows)
                ids = np.frombuffer(r["b_ids"], np.int64)
                b = {
                    "ids": ids, "labels": np.frombuffer(r["b_labels"], np.int64),
                    "data": np.frombuffer(r["b_data"], np.float64).reshape(len(ids), -1),
                    "angles": np.frombuffer(r["b_angles"], np.float32).reshape(len(ids), -1),
                    "norms": np.frombuffer(r["b_norms"], np.float64),
                }
                found = best_in_block(a, b, k, same)
                if found:
                    counts = [len(f[2]) for f in found]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.repeat(a["ids"][[f[0] for f in found]], counts)),
                            pa.array(np.repeat(np.array([f[1] for f in found], np.int32), counts)),
                            pa.array(np.concatenate([f[2] for f in found])),
                            pa.array(np.concatenate([f[3] for f in found])),
                        ],
                        names=names,
                    )

    rows = blocks.select("block", *(F.col(n).alias(f"b_{n}") for n in ("ids", "labels", "data", "angles", "norms")))
    return pairs.join(rows, "block").mapInArrow(run, FOUND)


def first_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(anchors: DataFrame, blocks: DataFrame, windows: int, k: int, same: bool, chunk: int) -> DataFrame:
    """``(anchor_id, place, rank, vec_id, score)``: the first ``k`` rows in each window of each anchor.

    ``same`` asks for other rows of the anchor's label, else for rows of other labels. The rows of
    each anchor's most promising blocks raise the lower ends of its windows before the others are asked.
    """
    groups = max(1, -(-blocks.count() // SUMMARIES))
    summaries = (
        blocks.select(
            "dims", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"),
            F.struct("block", "center", "near", "far", "least", "most", "few").alias("s"),
        )
        .groupBy("dims", "group").agg(F.collect_list("s").alias("summaries"))  # about SUMMARIES to a group
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )

    def ask(asking: DataFrame, first: bool) -> DataFrame:
        pairs = asked_blocks(chunks_of(asking, windows, chunk), summaries, groups, windows, same, first)
        return first_of(score_blocks(pairs, blocks, windows, k, same), k).drop("rank")

    opening = stored(ask(anchors, True), "opening")
    floors = (
        opening.groupBy("anchor_id", "place").agg(F.min("score").alias("floor"), F.count("*").alias("n"))
        .filter(F.col("n") >= k)
        .groupBy(F.col("anchor_id").alias("vec_id"))
        .agg(F.map_from_entries(F.collect_list(F.struct("place", F.col("floor").cast("double")))).alias("floors"))
    )
    raised = F.transform("lows", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("floors", w), x)))
    narrowed = anchors.join(floors, "vec_id", "left").withColumn("lows", raised).drop("floors")
    # the rest meets the opening's rows again where bounds still allow them
    rest = ask(narrowed, False)
    return first_of(opening.unionByName(rest).distinct(), k)


def usable(vectors: DataFrame, vector: Column, label: Column, scale: int = 256) -> DataFrame:
    """``(vec_id, label, data)`` of rows with an id, a label and a usable vector; one row per id.

    An id that repeats counts once, with its smallest label and vector.
    """
    return (
        vectors.select(
            F.col("vec_id").cast("long"), label.cast("long").alias("label"), whole_numbers(vector, scale).alias("data")
        )
        .dropna()
        .groupBy("vec_id")
        .agg(F.min(F.struct("label", "data")).alias("row"))
        .select("vec_id", "row.label", "row.data")
    )


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100,
    block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``rows`` is ``(vec_id, label, data)``, ids unique, data whole numbers as doubles; see :func:`usable`.
    An anchor's positives are the first rows of its label by score, then vec_id; the negatives of
    a positive the first rows of other labels that score ``least`` to ``most`` percent of it. Only rows
    of one number of components are compared. Anchors without a positive, and positives without a negative,
    give no rows, as does an empty table. Scores must stay below 2^53.
    """
    rows = stored(rows, "rows")
    placed = stored(in_order(rows, reference_directions(rows)), "angles")
    blocks = blocks_of(placed, block)
    anchors = placed.filter(is_anchor)
    everything = F.array(F.lit(float("-inf"))), F.array(F.lit(float("inf")))
    found = stored(
        search(
            anchors.withColumn("lows", everything[0]).withColumn("highs", everything[1]), blocks, 1, positives, True, chunk
        ).select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"),
                 F.col("score").alias("positive_score")),
        "positives",
    )
    # whole scores: at least 80 per cent is at least its ceiling; a negative score has no window
    low = F.ceil(F.col("positive_score") * least / F.lit(100)).cast("double")
    high = F.floor(F.col("positive_score") * most / F.lit(100)).cast("double")
    windows = (
        found.filter(low <= high).groupBy(F.col("anchor_id").alias("vec_id"))
        .agg(F.map_from_entries(F.collect_list(F.struct("place", F.struct(low.alias("low"), high.alias("high"))))).alias("w"))
        .withColumn("places", F.sequence(F.lit(0), F.lit(positives - 1)))
    )
    # a place without a positive, or with a negative score, gets a window that holds nothing
    lows = F.transform("places", lambda p: F.coalesce(F.try_element_at("w", p)["low"], F.lit(float("inf"))))
    highs = F.transform("places", lambda p: F.coalesce(F.try_element_at("w", p)["high"], F.lit(float("-inf"))))
    asking = anchors.join(
        windows.select("vec_id", lows.alias("lows"), highs.alias("highs")), "vec_id"
    )
    hard = search(asking, blocks, positives, negatives, False, chunk)
    return hard.join(found, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int"), F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
