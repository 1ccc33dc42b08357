"""Exact top-k inner products by blocks: bounds first, scores only where a bound calls for them.

Vectors are integers. Blocks are ranges of about a thousand vectors with, for each component, the
largest and smallest value in it; the sum over a query's components of what these allow is the
most any vector of the block can score. Each query first scores the blocks with its highest
bounds, which sets its k-th score; the others are scored only while their bound reaches it.
Within a block all its queries meet all its rows in one product of matrices.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: vectors of a block, queries of a chunk, block summaries that a task compares at once
BLOCK, CHUNK, SUMMARIES = 1024, 512, 256
PIVOTS = 64
#: copies of the summaries that chunks of queries are dealt over
SALTS = 8


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of each component as a double; null where the vector takes no part."""
    usable = F.coalesce(
        F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False)
    )
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact scores: in floats where every sum is below 2^53, else in 64-bit integers."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)))
    if float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2.0**53:
        return a @ b.T
    return a.astype(np.int64) @ b.astype(np.int64).T


def rows_of(column, dims: int) -> np.ndarray:
    return np.frombuffer(column, np.float64).reshape(-1, dims) if dims else np.zeros((1, 0))


def blocks_of(vectors: DataFrame, block: int) -> DataFrame:
    """``(block, dims, ids, data, hi, lo)``: one row per block with its rows as bytes.

    Vectors of like direction share blocks, so bounds are tight: each goes with the nearest of a
    few pivots (the vectors with the smallest id hashes); a pivot with many vectors has as many blocks
    as it needs, filled by a hash of the id.
    """
    pivots = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("data").collect()
    by_dims: dict[int, np.ndarray] = {}
    for n in {len(r["data"]) for r in pivots}:
        rows = np.array([r["data"] for r in pivots if len(r["data"]) == n]).reshape(-1, n)
        norms = np.linalg.norm(rows, axis=1, keepdims=True) if n else np.ones((len(rows), 1))
        by_dims[n] = rows / np.maximum(norms, 1e-9)

    @F.pandas_udf("int")
    def nearest(column: pd.Series) -> pd.Series:
        out = np.zeros(len(column), np.int32)
        lengths = np.array([len(v) for v in column])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            if n in by_dims and n:
                rows = np.stack([column.iloc[k] for k in at])
                out[at] = np.argmax(rows @ by_dims[n].T, axis=1)
        return pd.Series(out)

    placed = stored(
        vectors.select("vec_id", "data", F.size("data").alias("dims"), nearest("data").alias("pivot")),
        "vectors",
    )
    sizes = placed.groupBy("dims", "pivot").agg(F.ceil(F.count("*") / block).cast("long").alias("cells"))
    dealt = placed.join(F.broadcast(sizes), ["dims", "pivot"]).withColumn(
        "cell", F.pmod(F.xxhash64("vec_id"), F.col("cells"))
    )  # one row per pivot and number of dimensions

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id")
        dims = int(group["dims"].iloc[0])
        data = np.stack(group["data"].tolist()).reshape(len(group), dims)
        return pd.DataFrame(
            {
                "dims": [dims], "pivot": [int(group["pivot"].iloc[0])], "cell": [int(group["cell"].iloc[0])],
                "ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "data": [data.tobytes()],
                "hi": [data.max(axis=0).tobytes()], "lo": [data.min(axis=0).tobytes()],
            }
        )

    packed = dealt.select("vec_id", "data", "dims", "pivot", "cell").groupBy("dims", "pivot", "cell").applyInPandas(
        gather, "dims int, pivot int, cell long, ids binary, data binary, hi binary, lo binary"
    )
    return stored(
        packed.withColumn("block", F.concat_ws("-", "dims", "pivot", "cell")).drop("pivot", "cell"), "blocks"
    )


def bounds(queries: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """The most that any row of each block can score with each query."""
    return np.maximum(queries, 0) @ hi.T + np.minimum(queries, 0) @ lo.T


def score_pairs(pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """The best k rows of a block for each query that asks it: ``(query_id, vec_id, score)``."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                asking = np.frombuffer(r["query_ids"], np.int64)
                dims = r["dims"]
                data = np.frombuffer(r["data"], np.float64).reshape(len(ids), dims)
                asked = np.frombuffer(r["query_data"], np.float64).reshape(len(asking), dims)
                scores = product(asked, data)
                out_q, out_v, out_s = [], [], []
                for at, query in enumerate(asking):
                    own = scores[at]
                    others = ids != query
                    candidates = np.flatnonzero(others)
                    if len(candidates) > k:
                        kth = np.partition(own[candidates], len(candidates) - k)[len(candidates) - k]
                        candidates = candidates[own[candidates] >= kth]
                    # ties at the k-th score go to the smaller id: rows are in order of id
                    best = candidates[np.argsort(-own[candidates], kind="stable")[:k]]
                    out_q += [int(query)] * len(best)
                    out_v.append(ids[best])
                    out_s.append(own[best].astype(np.int64))
                if out_q:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(out_q, pa.int64()), pa.array(np.concatenate(out_v)), pa.array(np.concatenate(out_s))],
                        schema=schema,
                    )

    return pairs.join(blocks.select("block", "ids", "data"), "block").mapInArrow(
        run, "query_id long, vec_id long, score long"
    )


def best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: each query's k best rows other than its own.

    Both tables are ``(vec_id, data)`` with whole numbers as doubles; see :func:`whole_numbers`.
    Rows with a null are left out. An id that repeats counts once, with its smallest vector. Only
    vectors of the query's number of components are compared. Ties go to the smaller id.
    Scores must fit a long.
    """
    plain = vectors.select(F.col("vec_id").cast("long"), "data").dropna().groupBy("vec_id").agg(F.min("data").alias("data"))
    blocks = blocks_of(plain, block)
    asked = queries.select(F.col("vec_id").cast("long"), "data").dropna().groupBy("vec_id").agg(F.min("data").alias("data"))
    n_queries = max(1, asked.count())
    chunks = -(-n_queries // chunk)

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        data = np.stack(group["data"].tolist()).reshape(len(group), -1)
        return pd.DataFrame(
            {
                "dims": [data.shape[1] if data.size else 0], "chunk": [int(group["chunk"].iloc[0])],
                "query_ids": [group["vec_id"].to_numpy(np.int64).tobytes()], "query_data": [data.tobytes()],
            }
        )

    query_chunks = stored(
        asked.select("vec_id", "data", F.size("data").alias("dims"), F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).alias("chunk"))
        .groupBy("dims", "chunk")
        .applyInPandas(gather, "dims int, chunk long, query_ids binary, query_data binary"),
        "queries",
    )
    # summaries of many blocks in one row, for one comparison of matrices
    groups = max(1, -(-blocks.count() // SUMMARIES))
    summaries = (
        blocks.select("dims", F.struct("block", "hi", "lo").alias("s"), F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int").alias("group"))
        .groupBy("dims", "group")
        .agg(F.collect_list("s").alias("summaries"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    # every chunk meets every group, each at a place of its own
    meeting = (
        query_chunks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        .withColumn("salt", (F.col("chunk") % SALTS).cast("int"))
        .join(summaries, ["dims", "group", "salt"])
        .drop("group", "salt")
    )

    pair_schema = "block string, dims int, query_ids binary, query_data binary"

    def ask(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names = ["block", "dims", "query_ids", "query_data"]
            for batch in batches:
                for r in batch.to_pylist():
                    dims = r["dims"]
                    ids = np.frombuffer(r["query_ids"], np.int64)
                    data = np.frombuffer(r["query_data"], np.float64).reshape(len(ids), dims)
                    hi = np.stack([np.frombuffer(s["hi"], np.float64) for s in r["summaries"]])
                    lo = np.stack([np.frombuffer(s["lo"], np.float64) for s in r["summaries"]])
                    most = bounds(data, hi, lo)
                    best = np.argmax(most, axis=1)
                    wanted = np.zeros(most.shape, bool)
                    wanted[np.arange(len(ids)), best] = True
                    if not first:
                        known = dict(r["kth"] or ())
                        kth = np.array([known.get(int(q), -np.inf) for q in ids])
                        # a bound is of whole numbers; one is added for the rounding of large sums
                        wanted = ~wanted & (most + 1e-9 * np.abs(most) + 1 > kth[:, None])
                    columns: list[list] = [[], [], [], []]
                    for b in np.flatnonzero(wanted.any(axis=0)):
                        at = np.flatnonzero(wanted[:, b])
                        row = (r["summaries"][b]["block"], dims, ids[at].tobytes(), data[at].tobytes())
                        for c, v in zip(columns, row, strict=True):
                            c.append(v)
                    if columns[0]:
                        kinds = [pa.string(), pa.int32(), pa.binary(), pa.binary()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names
                        )

        return run

    opening = stored(best_of(score_pairs(meeting.mapInArrow(ask(True), pair_schema), blocks, k), k).drop("rank"), "opening")
    kth = (
        opening.groupBy("query_id")
        .agg(F.min("score").alias("score"), F.count("*").alias("n"))
        .filter(F.col("n") >= k)
        .select(F.pmod(F.xxhash64("query_id"), F.lit(chunks)).alias("chunk"), "query_id", "score")
        .groupBy("chunk")
        .agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("kth"))
    )
    rest = score_pairs(meeting.join(kth, "chunk", "left").mapInArrow(ask(False), pair_schema), blocks, k)
    return best_of(opening.unionByName(rest), k).select(
        "query_id", F.col("rank").cast("int"), "vec_id", "score"
    )
