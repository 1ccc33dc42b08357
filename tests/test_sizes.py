"""Findings on size: joins that must not trust a guess, blocks that stay bounded, work that is done once."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smudgeline.operators import neighbors, pooling, ranking, skew
from smudgeline.plans import further, registered


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sides_of_unknown_size_are_merged(spark):
    # by Spark's guess, which leaves out the exploding, both sides are small enough to be broadcast
    facts = spark.range(50).select("id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("at")).select(
        (F.col("id") * 4 + F.col("at")).alias("row_id"), F.concat(F.lit("k"), "id").alias("key")
    )
    dim = facts.groupBy("key").agg(F.min("row_id").alias("first"))
    one = skew.skew_join(facts, dim, "key", rows_per_split=2)
    many = skew.skew_join_many(
        facts, facts.withColumnRenamed("row_id", "other_id"), "key", right_row="other_id", rows_per_split=2
    )
    for joined in (one, many):
        merged = [x for x in plan(joined).splitlines() if "SortMergeJoin [key" in x]
        assert any("_split" in x or "_part" in x for x in merged)
    assert one.count() == 200 and one.filter("first = row_id div 4 * 4").count() == 200
    assert many.count() == 50 * 16


def test_texts_are_not_broadcast_to_token_vectors(spark, monkeypatch):
    texts = spark.range(60).select("id", F.expr("transform(sequence(0, id % 7), x -> cast(x * 3 % 5 as int))").alias("ids"))
    vectors = spark.range(5).select(F.col("id").cast("int").alias("token_id"), F.expr("transform(sequence(1, 8), x -> cast(x * id as float))").alias("vec"))
    batch = F.col("id") % 4
    made = []
    for room in (pooling.VOCABULARY_BYTES, 0):
        monkeypatch.setattr(pooling, "VOCABULARY_BYTES", room)
        for padded in (None, batch):
            out = pooling.mean_over_tokens(texts, vectors, "id", batch=padded)
            # vectors may be broadcast, to the right of the texts; without room everything is merged
            assert "BuildLeft" not in plan(out) and ("BroadcastHashJoin" in plan(out)) == bool(room)
            made.append(sorted((r["id"], tuple(r["vec"])) for r in out.collect()))
    assert made[0] == made[2] and made[1] == made[3] and len(made[0]) == 60
    # each text is summed once, not once for each component of its vector
    assert plan(pooling.mean_over_tokens(texts, vectors, "id")).count("zip_with") <= 2


def test_copies_of_rows_are_bounded(spark, monkeypatch):
    met = []
    whole = neighbors._meet

    def noted(queries, catalog, k, chunks, query_chunks, *rest):
        met.append((max(chunks), max(query_chunks)))
        return whole(queries, catalog, k, chunks, query_chunks, *rest)

    monkeypatch.setattr(neighbors, "_meet", noted)
    rng = np.random.default_rng(5)
    rows = [(i, f"line {i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(900, 6)))]
    catalog = spark.createDataFrame(rows, "cat_id long, canonical string, vec array<float>").repartition(3)
    plain = {(r["cat_id"], r["place"]): r["near_id"] for r in neighbors.nearest_lines(catalog, 4).collect()}
    for options in ({"chunk_rows": 5}, {"chunk_rows": 5, "cell_rows": 30}):
        got = neighbors.nearest_lines(catalog, 4, **options).collect()
        assert {(r["cat_id"], r["place"]): r["near_id"] for r in got} == plain
    # one block; 900 lines in chunks of five would be copied 180 times; cells are more than one, and have few chunks each
    assert met[0] == (1, 1) and met[1] == (neighbors.COPIES, neighbors.COPIES)
    assert len(met) > 3 and all(max(m) <= 4 for m in met[2:])
    # chunks that are full are not made fuller
    assert neighbors._chunks(900, 5, 20, 32) == 45


def test_pivots_that_rule_nothing_out(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, f"line {i}", [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(1200, 40)))]
    catalog = spark.createDataFrame(rows, "cat_id long, canonical string, vec array<float>").repartition(3)
    cells = []
    monkeypatch.setattr(neighbors, "_rows_per_cell", lambda df, n, *a, f=neighbors._rows_per_cell: cells.append(f(df, n, *a)) or cells[-1])
    got = neighbors.nearest_lines(catalog, 5, chunk_rows=50, cell_rows=25).collect()
    plain = neighbors.nearest_lines(catalog, 5).collect()
    assert {(r["cat_id"], r["place"], r["near_id"], r["cosine"]) for r in got} == {
        (r["cat_id"], r["place"], r["near_id"], r["cosine"]) for r in plain
    }
    # lines, queries, own cell, eight cells, a count of the rest: the rest is not written out by query and cell
    stored = [sum(c) for c in cells]
    assert stored[-1] > 8 * 1200 and len(stored) == 4


def test_open_cells_come_in_bounded_batches(monkeypatch):
    class Queries:
        """Hands back the function that Spark would run over batches."""

        schema = T.StructType([T.StructField("query_id", T.LongType())])
        mapInArrow = staticmethod(lambda made, schema: made)

    monkeypatch.setattr(neighbors, "_VISITS", 640, raising=False)
    rng = np.random.default_rng(7)
    pivots = neighbors._unit(rng.normal(size=(64, 8)), False)
    batch = pa.table({
        "query_id": pa.array(range(300)), "vec": pa.array(rng.normal(size=(300, 8)).tolist(), pa.list_(pa.float32())),
        "floor": pa.array([float("-inf")] * 300), "cell": pa.array([0] * 300, pa.int32()),
    }).to_batches()[0]
    for counted in (False, True):
        visit = neighbors._open_cells(Queries, pivots, np.zeros(64), np.full(64, 2.0), 0, None, counted)
        made = list(visit(iter([batch])))
        assert max(b.num_rows for b in made) <= 640
        assert sum(sum(b["n"].to_pylist()) if counted else b.num_rows for b in made) == 300 * 63


def test_a_shortlist_is_found_once(spark, small):
    # read twice by the injection: from its folder, not by meeting the catalog again
    assert "CoGroup" not in plan(registered.inject_truth(spark, small))


def test_blocks_of_the_whole_catalog_are_spread(spark):
    queries = spark.range(600).selectExpr("id AS query_id", "concat('t', id) AS noisy", "concat('l', id) AS truth")
    catalog = spark.range(90).selectExpr("id AS cat_id", "concat('l', id) AS canonical")
    tasks = []

    def scorer(df):
        tasks.append(df.rdd.getNumPartitions())
        return df.withColumns({"nll_yes": F.when(F.col("cat_id") == 50, 0.0).otherwise(2.0), "nll_no": F.lit(1.0)})

    got = ranking.score_legacy_whole(queries, catalog, scorer, block_lines=20, block_queries=50)
    assert got.filter("predicted = 'l50'").count() == 600
    assert set(tasks) == {int(spark.conf.get("spark.sql.shuffle.partitions"))}


def test_prefixes_are_made_in_many_tasks(spark, small, monkeypatch):
    asked = []
    monkeypatch.setattr(registered.pairs, "allowed_next", lambda wanted, *a, f=registered.pairs.allowed_next: asked.append(wanted) or f(wanted, *a))
    monkeypatch.setattr(further.trie, "allowed_next", lambda wanted, *a, f=further.trie.allowed_next: asked.append(wanted) or f(wanted, *a))
    made = [registered.allowed_next(spark, small), further.allowed_next_from_trie(spark, small)]
    rows = [sorted(map(tuple, df.collect())) for df in made]
    assert rows[0] == rows[1] and rows[0]
    # the file is one task's, its prefixes are not
    assert all(w.groupBy(F.spark_partition_id()).count().count() > 4 for w in asked)


def test_scores_of_a_pair_are_worked_out_once(spark, monkeypatch):
    queries = spark.range(40).selectExpr("id AS query_id", "concat('t', id) AS noisy", "concat('l', id) AS truth")
    catalog = spark.range(30).selectExpr("id AS cat_id", "concat('l', id) AS canonical")
    joins = []

    def noted(df, name, f=ranking.stored):
        joins.extend(x for x in plan(df).splitlines() if name == "legacy_answers" and "SortMergeJoin" in x)
        return f(df, name)

    monkeypatch.setattr(ranking, "stored", noted)
    got = ranking.score_legacy_whole(queries, catalog, further.rare_scorer, block_lines=30, block_queries=20)
    assert got.count() == 40
    # the join pairs blocks; a filter pushed into it would draw a pair's scores once for each place they are named in
    assert joins and not any("md5" in x for x in joins)


def test_copies_of_repeated_rows_are_bounded(spark, monkeypatch):
    grids = []

    def noted(df, name, f=skew.stored):
        out = f(df, name)
        grids.append(out.agg(F.max("_l_splits"), F.max("_r_splits")).first()) if name == "hot_grid" else None
        return out

    monkeypatch.setattr(skew, "stored", noted)
    left = spark.range(400).selectExpr("id AS row_id", "concat('k', id % 2) AS key")
    right = left.selectExpr("row_id AS other_id", "key").filter("other_id < 202")
    for full, parts in ((1000, (32, 32)), (4, (50, 32))):
        monkeypatch.setattr(skew, "ROWS_PER_SPLIT", full)
        out = skew.skew_join_many(left, right, "key", right_row="other_id", rows_per_split=2)
        # 200 rows and 101 in parts of two would be copied 51 and 100 times; full parts are not made fuller
        assert out.distinct().count() == 2 * 200 * 101 and tuple(grids.pop()) == parts


def test_best_lines_are_sorted_when_many_are_new(monkeypatch):
    rng = np.random.default_rng(8)
    queries, lines = neighbors._unit(rng.normal(size=(300, 12)), True), neighbors._unit(rng.normal(size=(40 * 1024 + 5, 12)), False)
    calls = []
    monkeypatch.setattr(neighbors, "_first", lambda *a, f=neighbors._first: calls.append(len(a[0])) or f(*a))
    rows, cols, sims, _ = neighbors.top_pairs(queries, lines, 6, None, np.full(300, -np.inf))
    every = np.round(np.einsum("id,jd->ij", queries, lines), neighbors.DIGITS)
    best = np.lexsort((np.broadcast_to(np.arange(every.shape[1]), every.shape), -every))[:, :6]
    assert (cols.reshape(300, 6) == best).all() and (sims.reshape(300, 6) == np.take_along_axis(every, best, 1)).all()
    # not once for each of the 41 tiles of lines
    assert len(calls) < 20


def test_places_of_flags():
    rng = np.random.default_rng(9)
    for n in (0, 5, 8, 1003):
        for share in (0, 0.01, 1):
            flags = rng.random(n) < share
            assert (neighbors._places(flags) == np.flatnonzero(flags)).all()


def test_full_chunks_are_not_copied(spark, monkeypatch):
    rng = np.random.default_rng(8)
    # few values: many ties, zero vectors, and queries of one vector
    rows = [(i, f"line {i}", [float(x) for x in v]) for i, v in enumerate(rng.integers(0, 3, size=(1100, 5)))]
    catalog = spark.createDataFrame(rows, "cat_id long, canonical string, vec array<float>").repartition(3)
    queries = catalog.withColumnRenamed("cat_id", "query_id").select("query_id", "vec")
    both = queries.unionByName(queries.withColumn("query_id", F.col("query_id") + 5000))
    plain = sorted(tuple(r) for r in neighbors.shortlist(both, catalog, 9).collect())
    made = []
    monkeypatch.setattr(neighbors, "_meet", lambda *a, f=neighbors._meet: made.append(max(a[4])) or f(*a))
    # a chunk of queries is full at 1,024 of 2,200 rows, and the catalog may be copied once
    monkeypatch.setattr(neighbors, "ANSWERS", 1 << 12)
    monkeypatch.setattr(neighbors, "COPIES", 1)
    for sizes in ({}, {"PACKED_ROWS": 64, "PACKED_QUERIES": 100}, {"PACKED_ROWS": 100, "PART_LINES": 400}):
        with monkeypatch.context() as m:
            for name, size in sizes.items():
                m.setattr(neighbors, name, size)
            found = neighbors.shortlist(both, catalog, 9)
            assert sorted(tuple(r) for r in found.collect()) == plain
            assert "CartesianProduct" in plan(found)
    assert not made
    # ids need not be numbers, and cells that rule nothing out end in the same search
    named = catalog.withColumn("cat_id", F.format_string("c%05d", "cat_id"))
    got = neighbors.shortlist(both, named, 9).collect()
    assert sorted((r["query_id"], int(r["cat_id"][1:]), *r[2:]) for r in got) == plain
    monkeypatch.setattr(neighbors, "WHOLE", 0)
    found = neighbors.shortlist(both, catalog, 9, chunk_rows=50, cell_rows=25)
    assert sorted(tuple(r) for r in found.collect()) == plain and "CartesianProduct" in plan(found)


def test_many_repeated_keys_share_the_copies(spark, monkeypatch):
    grids = []

    def noted(df, name, f=skew.stored):
        out = f(df, name)
        grids.append(out.agg(F.max("_l_splits"), F.max("_r_splits")).first()) if name == "hot_grid" else None
        return out

    monkeypatch.setattr(skew, "stored", noted)
    left = spark.range(6400).selectExpr("id AS row_id", "concat('k', id % 32) AS key")
    right = left.selectExpr("row_id AS other_id", "key").filter("other_id < 3200")
    out = skew.skew_join_many(left, right, "key", right_row="other_id", rows_per_split=2)
    assert out.distinct().count() == 32 * 200 * 100
    # each of 32 keys has its part of the 2 * 32 * 32 blocks two keys would have; before, 32 copies of each row
    assert tuple(grids[0]) == (8, 8)


def test_repeated_rows_come_in_short_lists(spark, monkeypatch):
    monkeypatch.setattr(skew, "GRID_COPIES", 1)
    left = spark.range(300).selectExpr("id AS row_id", "'k' AS key")
    right = spark.range(3000).selectExpr("id AS other_id", "'k' AS key", "nullif(id, 7) AS value")
    rows = skew.skew_join_many(left, right, "key", "left", right_row="other_id", rows_per_split=7).collect()
    assert len({(r["row_id"], r["other_id"]) for r in rows}) == len(rows) == 300 * 3000
    assert rows[0].__fields__ == ["key", "row_id", "other_id", "value"]
    assert all(r["value"] == (None if r["other_id"] == 7 else r["other_id"]) for r in rows)
    # written in this order, a column of so few values is short; before, all 3,000 came again for each row
    assert len({r["other_id"] for r in rows[:3000]}) < 3 * skew.LIST_ROWS


def test_pivots_are_probed_before_much_is_copied(spark, monkeypatch):
    made = []
    monkeypatch.setattr(neighbors, "_meet", lambda *a, f=neighbors._meet: made.append(a) or f(*a))
    rng = np.random.default_rng(11)
    centers = np.repeat(rng.normal(size=(16, 40)), 75, axis=0)
    for vecs, is_clustered in ((rng.normal(size=(1200, 40)), False), (centers + rng.normal(size=(1200, 40)) * 0.02, True)):
        rows = [(i, f"line {i}", [float(x) for x in v]) for i, v in enumerate(vecs)]
        catalog = spark.createDataFrame(rows, "cat_id long, canonical string, vec array<float>").repartition(3)
        plain = sorted(tuple(r) for r in neighbors.nearest_lines(catalog, 5).collect())
        with monkeypatch.context() as m:
            # a chunk of queries is full at 1,024 of 1,200, and the catalog may be copied once
            m.setattr(neighbors, "COPIES", 1)
            m.setattr(neighbors, "ANSWERS", 1 << 12)
            m.setattr(neighbors, "PROBES", 100, raising=False)
            made.clear()
            visits: list = []
            found = neighbors.nearest_lines(catalog, 5, chunk_rows=50, cell_rows=25, visits=visits)
            assert sorted(tuple(r) for r in found.collect()) == plain
            # by cells only where these rule something out
            assert bool(made) == is_clustered and ("CartesianProduct" in plan(found)) != is_clustered
            assert visits and visits[0]["of_pairs"] == 1200 * 1200
            assert (sum(v["pairs"] for v in visits) < visits[0]["of_pairs"]) == is_clustered


def test_lines_that_are_no_ones_best_are_dropped(monkeypatch):
    monkeypatch.setattr(neighbors, "PACKED_ROWS", 50)
    monkeypatch.setattr(neighbors, "PART_LINES", 120)
    rng = np.random.default_rng(12)
    lines, queries = (rng.normal(size=(n, 6)).astype(np.float32) for n in (2000, 30))
    pairs = [(q, b) for b in rng.permutation(40) for q in (0, 1)]
    batch = pa.table({
        "query_id": pa.array([list(range(q * 15, q * 15 + 15)) for q, _ in pairs]),
        "query_vec": pa.array([queries[q * 15 : q * 15 + 15].tobytes() for q, _ in pairs], pa.binary()),
        "floor": pa.array([[float("-inf")] * 15] * len(pairs)), "query_block": pa.array([q for q, _ in pairs]),
        "near_id": pa.array([list(range(b * 50, b * 50 + 50)) for _, b in pairs]),
        "line_vec": pa.array([lines[b * 50 : b * 50 + 50].tobytes() for _, b in pairs], pa.binary()),
        "line_block": pa.array([int(b) for _, b in pairs]),
    }).combine_chunks().to_batches()
    kept = []

    def noted(self, *a, f=neighbors._Lines.take_in):
        f(self, *a)
        kept.append(len(self.places) + sum(len(v[0]) for v in self.whole.values()))

    monkeypatch.setattr(neighbors._Lines, "take_in", noted)
    every = neighbors._unit(queries, True) @ neighbors._unit(lines, False).T
    want = {(q, int(n), at + 1) for q in range(30) for at, n in enumerate(np.argsort(-every[q])[:4])}
    # blocks of lines come in any order, and once more for other queries
    for order in (batch, [pa.Table.from_batches(batch).take(np.argsort([q for q, _ in pairs], kind="stable")).combine_chunks().to_batches()[0]]):
        kept.clear()
        out = pa.Table.from_batches(neighbors._search_blocks(4, ("near_id",), None)(iter(order))).to_pylist()
        assert {(r["query_id"], r["near_id"], r["place"]) for r in out} == want and len(out) == 120
        assert max(kept) <= 120 + 120
