"""Hard negatives, byte-level BPE and part codes: brute force, round trips, odd rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from smudgeline.llm import byte_bpe, negatives, part_codes, queries

VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_of(spark, rows):
    """Rows with columns whose names clash with those the operators make."""
    df = spark.createDataFrame(rows, VECTORS)
    for name in ("data", "angles", "like", "dims", "block", "place", "score", "codes", "error", "_label", "row", "n"):
        df = df.withColumn(name, F.lit("x"))
    return df


NAN, INF = float("nan"), float("inf")

# 11 ------------------------------------------------------------------------------------------


def brute_negatives(rows, step, k=5):
    """By definition: all pairs of usable rows of one length; rows are (id, vector, label)."""
    out = []
    for a_id, a, a_label in rows:
        if a_id % step:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(a, v, strict=True)), i, label) for i, v, label in rows if i != a_id and len(v) == len(a)
        )
        for p, p_id, _ in [s for s in scored if s[2] == a_label][:k]:
            inside = [(i, -n) for n, i, label in scored if label != a_label and 80 * -p <= 100 * -n <= 100 * -p]
            out += [(a_id, p_id, rank + 1, i, -p, n) for rank, (i, n) in enumerate(inside[:k])]
    return sorted(out)


@pytest.mark.parametrize(("block", "chunk"), [(16, 4), (1024, 256)])
def test_negatives_against_brute_force(spark, block, chunk):
    rng = np.random.default_rng(5)
    data = np.round(rng.normal(size=(400, 6)) * 3 + 2) / 4
    data[50:90] = data[50]  # ties
    data[200] = 0
    rows = [(k, [float(x) for x in v], int(k % 3)) for k, v in enumerate(data)]
    rows += [(1000 + k, [float(k), 2.0], k % 2) for k in range(9)]  # another length
    usable = [(i, [int(np.floor(256 * x)) for x in v], label) for i, v, label in rows]
    rows += [(2000, None, 1), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (2020, [NAN] * 6, 1), (2030, [INF] * 6, 1),
             (2040, [1.0] * 6, None), (None, [1.0] * 6, 1), rows[3], rows[3], (2050, [], 1)]
    usable.append((2050, [], 1))
    df = vectors_of(spark, rows)
    got = negatives.mine(
        negatives.usable(df, F.col("embedding"), F.col("label")), F.col("vec_id") % 10 == 0, block=block, chunk=chunk
    )
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute_negatives(usable, 10)


def test_negatives_of_empty_and_single_rows(spark):
    for rows in ([], [(0, [1.0, 2.0], 1)], [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1)], [(0, [-1.0], 1), (1, [1.0], 1), (2, [1.0], 2)]):
        df = vectors_of(spark, rows)
        got = negatives.mine(negatives.usable(df, F.col("embedding"), F.col("label")), F.col("vec_id") % 10 == 0)
        assert got.count() == 0


def test_score_bounds_hold_and_exclude():
    rng = np.random.default_rng(1)
    # most of the length lies along few directions, as in learned embeddings
    data = np.floor(256 * rng.normal(size=(300, 32)) * 0.8 ** np.arange(32))
    data[:20] = data[20:40]
    data[40] = 0
    scores, norms = data @ data.T, np.linalg.norm(data, axis=1)
    for taken in (0, 1, 8, 20, 32):
        directions = np.linalg.svd(data, full_matrices=False)[2][:taken]
        angles = negatives.angles_to(data, directions) if taken else np.zeros((300, 0), np.float32)
        low, high = negatives.score_bounds(angles, norms, angles, norms)
        assert (low <= scores).all() and (scores <= high).all()
        fifth = np.sort(scores, axis=1)[:, -6]
        if taken >= 8:
            assert (high >= fifth[:, None]).mean() < 0.4
    units = data / np.maximum(norms, 1e-300)[:, None]
    part = data[50:80]
    center = units[50:80].sum(axis=0)
    center /= np.linalg.norm(center)
    away = np.arccos(np.clip(units[50:80] @ center, -1, 1))
    summary = {"center": center[None, :], "near": np.array([away.min()]), "far": np.array([away.max()]),
               "least": np.array([norms[50:80].min()]), "most": np.array([norms[50:80].max()])}
    least, most = negatives.block_bounds(units, norms, summary)
    assert (least[:, 0] <= (data @ part.T).min(axis=1)).all() and (most[:, 0] >= (data @ part.T).max(axis=1)).all()


# 12 ------------------------------------------------------------------------------------------


def reference_encoding():
    import public_tokenizers
    import tiktoken

    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    """Characters of all lengths in UTF-8, kinds new to Unicode, runs, blanks and the spelling of a special token."""
    rng = random.Random(4)
    kinds = [
        lambda: chr(rng.randrange(32, 127)), lambda: rng.choice("aeiou   \n\t'"), lambda: chr(rng.randrange(0x80, 0x800)),
        lambda: chr(rng.randrange(0x800, 0xD800)), lambda: chr(rng.randrange(0x10000, 0x34000)),
    ]
    drawn = ["".join(rng.choice(kinds)() for _ in range(rng.randrange(60))) for _ in range(1500)]
    fixed = ["a࢏b 1\U00011de03", "Ᲊᲊ Ɤ", "<|endoftext|> it's", " " * 300 + "x", "a" * 5000, "\x1c \x85  z", "ẞ🏳️‍🌈é"]
    return [*drawn, *fixed, *drawn[:50]]


def test_bpe_against_tiktoken(spark, small):
    given = odd_texts() + [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string").repartition(3)
    encoded = byte_bpe.encode_documents(docs, offsets=True)
    decoded = {r["doc_id"]: r for r in byte_bpe.decode_documents(encoded).collect()}
    arrays = {r["doc_id"]: r for r in byte_bpe.unpacked(byte_bpe.unpacked(byte_bpe.unpacked(encoded, "ids"), "starts"), "ends").collect()}
    encoding = reference_encoding()
    whole = byte_bpe.libraries(byte_bpe.read_ranks(byte_bpe.public_vocabulary()), byte_bpe.public_pattern())[0]
    for k, text in enumerate(given):
        assert arrays[k]["ids"] == encoding.encode_ordinary(text)
        assert bytes(decoded[k]["data"]) == text.encode()
        want = whole.encode(text, add_special_tokens=False).offsets
        assert list(zip(arrays[k]["starts"], arrays[k]["ends"], strict=True)) == [tuple(o) for o in want]
    # each character appears with the token that ends it
    said = {}
    for r in byte_bpe.token_texts(encoded).orderBy("doc_id", "place").collect():
        said.setdefault(r["doc_id"], []).append(r["text"])
    assert all("".join(said.get(k, [])) == text for k, text in enumerate(given))
    assert any("" in s for s in said.values())


def test_bpe_of_many_tasks_in_one_worker(spark, monkeypatch):
    class Documents:
        """Hands back the function that Spark would run over batches."""

        select = lambda self, *columns: self
        mapInArrow = staticmethod(lambda made, schema: made)

    built = []
    for name in ("Encoder", "Decoder"):
        kind = getattr(byte_bpe, name)
        monkeypatch.setattr(byte_bpe, name, lambda *a, kind=kind, name=name: built.append(name) or kind(*a))
    monkeypatch.setattr(byte_bpe, "KEPT", 50)
    # what the tasks make is the worker's, not this process's
    monkeypatch.setenv("TOKENIZERS_PARALLELISM", "false")
    monkeypatch.setattr(byte_bpe, "LOT", 1000)
    run, given, encoding = byte_bpe.encode_documents(Documents(), decoded=True), odd_texts(), reference_encoding()
    for at in range(0, 400, 100):
        texts = given[at : at + 100]
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
        made = pa.Table.from_batches(list(run(iter([batch]))))
        assert [np.frombuffer(b, "<u4").tolist() for b in made["ids"].to_pylist()] == [encoding.encode_ordinary(t) for t in texts]
        assert made["data"].to_pylist() == [t.encode() for t in texts]
    # a model for each task would stay behind in the worker's memory in part
    assert sorted(built) == ["Decoder", "Encoder"]


def test_bpe_of_broken_ids(spark):
    ids = [np.array(v, "<u4").tobytes() for v in ([172], [50256], [10**6], [])]
    rows = [*enumerate(ids), (9, None), (None, ids[0])]
    df = spark.createDataFrame(rows, "doc_id long, ids binary")
    got = {r["doc_id"]: r["data"] for r in byte_bpe.decode_documents(df).collect()}
    token = {v: k for k, v in byte_bpe.read_ranks(byte_bpe.public_vocabulary()).items()}[172]
    assert bytes(got[0]) == token and got[1] is None and got[2] is None and bytes(got[3]) == b"" and got[9] is None
    pieces = byte_bpe.token_texts(df.filter("doc_id = 0")).collect()
    assert [r["text"] for r in pieces] == [token.decode("utf-8", "replace")]


def test_bpe_odd_rows(spark, small, tmp_path):
    long_run = "x" * 1_000_000
    rows = [(1, ""), (2, None), (None, "some text"), (3, "word " * 200_000), (4, "same"), (4, "same"), (None, None), (5, long_run)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("ids", "data", "starts", "n_tokens"):
        df = df.withColumn(name, F.lit("x"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_byte_bpe(spark, str(tmp_path)).collect()
    encoding = reference_encoding()
    want = []
    for doc, text in rows:
        ids = encoding.encode_ordinary(text or "")
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert byte_bpe.decode_documents(byte_bpe.encode_documents(df.limit(0))).count() == 0


# 13 ------------------------------------------------------------------------------------------


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    """By definition, in whole numbers; rows are (id, vector, label) in order of id."""
    whole = [[int(np.floor(scale * x)) for x in v] for _, v, _ in rows]
    width = len(whole[0]) // parts
    books, codes, errors = [], [""] * len(whole), [0] * len(whole)
    for p in range(parts):
        mine = [w[p * width : (p + 1) * width] for w in whole]
        book = [list(m) for m in mine[:entries]]

        def nearest(m, book=book):
            return min((sum((x - y) ** 2 for x, y in zip(m, b, strict=True)), k) for k, b in enumerate(book))

        for _ in range(rounds):
            groups = {}
            for m in mine:
                groups.setdefault(nearest(m)[1], []).append(m)
            for k, members in groups.items():
                book[k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
        for k, m in enumerate(mine):
            distance, entry = nearest(m)
            codes[k] += f"{entry:02x}"
            errors[k] += distance
        books += book
    totals = {}
    for (_, _, label), e in zip(rows, errors, strict=True):
        totals[label] = totals.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b).encode()).hexdigest()
    return [(r[0], c, e, totals[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True)]


def coded_rows(df, **options):
    coded, books = part_codes.compress(df, **options)
    digest = part_codes.books_digest(books)
    return sorted(
        (r["vec_id"], r["code"], r["error"], r["label_error"], digest)
        for r in coded.withColumn("code", part_codes.hex_code(F.col("codes"))).collect()
    ), coded, books


def test_codes_against_brute_force(spark):
    rng = np.random.default_rng(8)
    data = np.round(rng.normal(size=(300, 8)), 2).astype(np.float32)
    data[100:180] = data[100]
    rows = [(k, [float(x) for x in v], [None, 1, 2][k % 3]) for k, v in enumerate(data)]
    bad = [(900, None, 1), (901, [NAN] * 8, 1), (902, [INF] * 8, 1), (903, [None] * 8, 1)]
    df = vectors_of(spark, [*rows, *bad]).repartition(5)
    got, coded, books = coded_rows(df, entries=20)
    assert got == brute_codes(rows, entries=20)
    # decoded vectors are as far from the given ones as the error says
    whole = {k: np.floor(1024 * v.astype(float)).astype(int) for k, v in enumerate(data)}
    errors = {r["vec_id"]: r["error"] for r in coded.collect()}
    for r in part_codes.decode(coded, books).collect():
        assert ((np.array(r["data"]) - whole[r["vec_id"]]) ** 2).sum() == errors[r["vec_id"]]


def test_codes_of_odd_rows(spark):
    assert coded_rows(vectors_of(spark, []))[0] == []
    assert coded_rows(vectors_of(spark, [(1, None, 1)]))[0] == []
    same = (7, [0.5, -0.25, 1.0, 0.0], None)
    got = coded_rows(vectors_of(spark, [same, same, same]))[0]
    assert [g[:4] for g in got] == [(7, "00000000", 0, 0)] * 3  # equal entries: the lower index
    # short vectors are filled with zeros, a null id comes last and is coded
    rows = [(1, [1.0], 1), (2, [1.0, 0.0, 0.0, 0.0], 1), (3, [], 2)]
    got = coded_rows(vectors_of(spark, rows))[0]
    assert [g[1] for g in got] == ["00000000", "00000000", "02000000"]
    coded = part_codes.compress(vectors_of(spark, [(None, [2.0] * 4, 1), (5, [1.0] * 4, 1)]))[0]
    assert {(r["vec_id"], bytes(r["codes"])) for r in coded.collect()} == {(5, bytes(4)), (None, bytes([1] * 4))}
    with pytest.raises(ValueError, match="after scaling"):
        part_codes.compress(vectors_of(spark, [(1, [1e9] * 4, 1)]))


def test_trie_walk_against_all_distances():
    rng = np.random.default_rng(3)
    for n, width, k, spread in ((0, 3, 4, 5), (1, 0, 1, 1), (3000, 4, 17, 3), (6000, 3, 256, 2), (3000, 16, 256, 700), (4000, 5, 7, 10**6)):
        rows = rng.integers(-spread, spread, (n, width))
        rows = rows[part_codes.lexicographic(rows)]
        book = rng.integers(-spread, spread, (k, width))
        entry, distance = part_codes.walk(rows, book)
        if n:
            all_of = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
            assert (entry == all_of.argmin(axis=1)).all() and (distance == all_of.min(axis=1)).all()
