"""Documents whose sets of word n-grams are alike (Jaccard), by PartEnum signatures.

Sets of a band of sizes are compared in one instance of a partition of the n-gram domain; sets
just above a band also enter it, so any two that can link meet in the band of the smaller. Two
linked sets of x and y n-grams differ in at most (x + y)(1 - t)/(1 + t) of them, and each
difference spoils one partition. A set fills more partitions than can be spoilt, so at least one
filled partition is the same in both; its number and content are a signature. Of a set's signatures
it is enough to give out, in one order for all sets, one more than can be spoilt: subsets of the
partitions are enumerated only as far as two linked sets must share one.

Signatures of many documents come last in that order (found on a bounded sample; the order changes
cost, never results). Documents sharing a signature are tested against one leader each, exactly;
links merge them. What then still lies in different components is tested pair by pair, in
blocks, behind a bound from parities of hashed n-grams that never exceeds the true distance.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import in_batches, mix64, powers, texts

#: links need share(intersection, union) >= NUMERATOR / DENOMINATOR
NUMERATOR, DENOMINATOR = 75, 100
WORDS = 5
SAMPLE = 8192
HOT = 8
HOT_KEPT = 65_536
CHUNK = 256
#: sets a task remembers having signed
SEEN = 1_000_000


#: bytes hashed at a time; longer texts are cut at blanks
SLICE = 1 << 16
BLANK = re.compile(rb"[\x20\x09-\x0D]")
IN_WORD = np.array([not BLANK.match(bytes([c])) for c in range(256)])
#: a number for each byte, the same for both cases of A-Z
VALUES = mix64(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(1 << 32))


def word_codes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 text, in order; the case of A-Z does not matter.

    A word is a sum of its bytes' numbers times powers of an odd number, mixed with its length.
    """
    out = [np.zeros(0, np.uint64)]
    at = 0
    while at < len(data):
        cut = BLANK.search(data, at + SLICE)
        end = cut.start() if cut else len(data)
        codes = np.frombuffer(data, np.uint8, end - at, at)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = IN_WORD[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = powers(len(codes))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(codes) + 1, np.uint64)
            np.cumsum(VALUES[codes] * up, out=sums[1:])
            out.append(mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        at = end
    return np.concatenate(out)


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams of a text; of the whole text if it is shorter."""
    words = word_codes(text.encode("utf-8", "surrogatepass"))
    if not len(words):
        return words
    width = min(n, len(words))
    factors = mix64(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        code = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            code += words[k : len(words) - width + 1 + k] * factors[k]
    code = np.sort(mix64(code))
    return code[np.concatenate([[True], code[1:] != code[:-1]])]


def set_key(grams: np.ndarray) -> int:
    """A hash of a whole set, as a signed long."""
    with np.errstate(over="ignore"):
        total = mix64(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + np.uint64(len(grams))
    return int(mix64(np.array([total], np.uint64))[0].astype(np.int64))


def sketch(grams: np.ndarray) -> bytes:
    """Parities of hashed n-grams: four or more bits for each n-gram, in a power of two of bits.

    Each n-gram two sets differ in flips one bit, so the bits two sketches differ in are at most the
    n-grams the sets differ in. Adding halves of a longer sketch together keeps that true.
    """
    bits = max(64, 1 << (4 * len(grams) - 1).bit_length())
    flips = np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def folded(row: bytes, size: int) -> np.ndarray:
    """A sketch cut down to ``size`` bytes, as 64-bit words."""
    return np.bitwise_xor.reduce(np.frombuffer(row, np.uint64).reshape(-1, size // 8), axis=0)


def alike(x, y, apart):
    """Whether sets of x and y that differ in ``apart`` n-grams link; exact in whole numbers."""
    # intersection = (x + y - apart) / 2, union = (x + y + apart) / 2
    return DENOMINATOR * (x + y - apart) >= NUMERATOR * (x + y + apart)


def most_apart(x: int, y: int) -> int:
    return (x + y) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)


def partitions(low: int) -> int:
    """Parts of the domain in the band from ``low``, a power of two: enough that a set always fills
    more of them than can be spoilt, few enough that larger sets share parts."""
    if low >= 64:
        return 4 * low
    return {1: 1 << 16, 4: 256, 16: 128}[low]


def bands(size: int) -> list[tuple[int, int]]:
    """``(low, most differences)`` of the bands a set of this size enters; bands reach from low to 4 low."""
    low = 1
    while low * 4 <= size:
        low *= 4
    largest = size * DENOMINATOR // NUMERATOR
    out = [(low, most_apart(size, largest))]
    if low > 1 and -(-size * NUMERATOR // DENOMINATOR) < low:
        out.append((low // 4, most_apart(size, low - 1)))
    return out


def signatures(grams: np.ndarray, hot: np.ndarray | None) -> np.ndarray:
    """Signatures of a set; all of them if ``hot`` is None, else as many as linked sets must share."""
    out = []
    for low, apart in bands(len(grams)):
        bits = partitions(low).bit_length() - 1
        with np.errstate(over="ignore"):
            # the leading bits of a scattered n-gram name its part, so sorting brings parts together
            scattered = np.sort(mix64(grams + np.uint64(low * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
            part = scattered >> np.uint64(64 - bits)
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            content = np.add.reduceat(mix64(scattered), first)
            tokens = mix64(content + part[first] * np.uint64(0xD6E8FEB86659FD93) + np.uint64(low))
        # 63 bits; the leading one puts common signatures last
        tokens >>= np.uint64(1)
        if hot is not None and len(tokens) > apart + 1:
            if len(hot):
                common = hot[np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)] == tokens
                tokens |= common.astype(np.uint64) << np.uint64(63)
            tokens = np.partition(tokens, apart)[: apart + 1] & np.uint64((1 << 63) - 1)
        out.append(tokens)
    return np.concatenate(out)


def as_documents(documents: DataFrame) -> DataFrame:
    return documents.select(
        F.col("doc_id").cast("long"), F.col("text").cast("string")
    ).withColumn("text_key", F.xxhash64("text"))


def gram_sets(documents: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_shingles, key, sketch)``, key and sketch null without words."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_shingles", pa.int64()), ("key", pa.int64()),
         ("sketch", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(batch: pa.RecordBatch) -> dict:
            sizes, keys, rows = [], [], []
            for text in texts(batch.column(1)):
                grams = shingles(text)
                sizes.append(len(grams))
                keys.append(set_key(grams) if len(grams) else None)
                rows.append(sketch(grams) if len(grams) else None)
            return {"doc_id": batch.column(0), "text_key": batch.column(2), "n_shingles": sizes, "key": keys, "sketch": rows}

        yield from in_batches(work, schema)(batches)

    return documents.mapInArrow(run, "doc_id long, text_key long, n_shingles long, key long, sketch binary")


def signed(documents: DataFrame, hot: np.ndarray | None) -> DataFrame:
    """``(key, signature)`` of every document, one row per signature.

    With ``hot`` a task signs each set once, so a group of copies sends a few rows of each signature.
    """
    schema = pa.schema([("key", pa.int64()), ("signatures", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()

        def work(batch: pa.RecordBatch) -> dict | None:
            keys, found = [], []
            if len(seen) > SEEN:
                seen.clear()
            for text in texts(batch.column(1)):
                grams = shingles(text)
                key = set_key(grams) if len(grams) else None
                if key is None or (hot is not None and key in seen):
                    continue
                seen.add(key)
                keys.append(key)
                found.append(signatures(grams, hot).astype(np.int64))
            if not keys:
                return None
            flat = pa.array(np.concatenate(found))
            starts = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            return {"key": keys, "signatures": pa.ListArray.from_arrays(pa.array(starts), flat)}

        yield from in_batches(work, schema)(batches)

    return documents.mapInArrow(run, "key long, signatures array<long>").select(
        "key", F.explode("signatures").alias("signature")
    )


def frequent_signatures(documents: DataFrame, rows: int) -> np.ndarray:
    """Signatures found ``HOT`` times or more in about ``SAMPLE`` documents, at most ``HOT_KEPT``."""
    every = max(1, rows // SAMPLE)
    sample = documents.filter(F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(every)) == 0)
    counted = signed(sample, None).groupBy("signature").count().filter(F.col("count") >= HOT)
    kept = counted.orderBy(F.desc("count"), "signature").limit(HOT_KEPT).collect()
    return np.sort(np.array([r["signature"] for r in kept], np.int64).view(np.uint64))


def closer(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that sizes and sketches do not rule out."""
    known = pairs
    for side in ("a", "b"):
        own = classes.select(
            F.col("key").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")
        )
        known = known.join(own, side)
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    known = known.filter(DENOMINATOR * small >= NUMERATOR * large)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batch: pa.RecordBatch) -> dict:
        c = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        x, y = c["n_a"].to_numpy(), c["n_b"].to_numpy()
        apart = np.zeros(len(x), np.int64)
        for at, (p, q) in enumerate(zip(c["sketch_a"].to_pylist(), c["sketch_b"].to_pylist(), strict=True)):
            size = min(len(p), len(q))
            apart[at] = np.bitwise_count(folded(p, size) ^ folded(q, size)).sum()
        keep = alike(x, y, apart)
        return {n: pa.array(c[n].to_numpy()[keep]) for n in ("a", "b")}

    return known.mapInArrow(in_batches(run, schema), "a long, b long")


def linked(pairs: DataFrame, class_texts: DataFrame) -> DataFrame:
    """The pairs that link, by their whole sets."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def grams_of(key: int, text: str) -> np.ndarray:
            if key not in held:
                if len(held) >= 64:
                    held.clear()
                held[key] = shingles(text)
            return held[key]

        def work(batch: pa.RecordBatch) -> dict:
            out: list[list[int]] = [[], []]
            for a, b, p, q in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                left, right = grams_of(a, p), shingles(q)
                both = len(np.intersect1d(left, right, assume_unique=True))
                if DENOMINATOR * both >= NUMERATOR * (len(left) + len(right) - both):
                    out[0].append(a)
                    out[1].append(b)
            return {"a": out[0], "b": out[1]}

        yield from in_batches(work, schema)(batches)

    sides = [class_texts.select(F.col("key").alias(s), F.col("text").alias(f"text_{s}")) for s in ("a", "b")]
    return (
        pairs.join(sides[1], "b").join(sides[0], "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")
    )


def components(edges: DataFrame) -> DataFrame:
    """``(key, root)`` of every key on an edge, the root being the smallest key reachable.

    Alternates two steps until nothing changes: every key hands its larger neighbours, then its
    smaller ones, to the smallest it knows. Rounds grow with the logarithm of the longest path.
    """
    now = stored(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(),
        "edges",
    )
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(smallest, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(smallest.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = stored(small, "edges")
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("u").alias("key"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("key"), F.col("v").alias("root")).distinct()
    )


def with_roots(groups: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of signatures whose documents lie in several components, with their root."""
    known = groups.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    spread = known.groupBy("signature").agg(
        F.min("root").alias("_low"), F.max("root").alias("_high"), F.count("*").alias("members")
    )
    # two documents have been tested against each other already
    open_ = spread.filter("_low < _high and members > 2").select("signature", "members")
    return known.join(open_, "signature")


def star_pairs(groups: DataFrame, turn: int) -> DataFrame:
    """Pairs of each signature's leader of that turn with members of other components.

    The document that shares the most signatures leads first: of copies with different edits that
    is the one nearest to all, so that one turn links them. Further turns take the next ones.
    """
    order = Window.partitionBy("signature").orderBy(F.desc("shared"), "key")
    leader = (
        groups.withColumn("_at", F.row_number().over(order))
        .filter(F.col("_at") == turn + 1)
        .select("signature", F.struct("key", "root").alias("lead"))
    )
    return (
        groups.join(leader, "signature")
        .filter("lead.key != key and lead.root != root")
        .select(F.col("lead.key").alias("a"), F.col("key").alias("b"))
        .distinct()
    )


def without_repeats(groups: DataFrame) -> DataFrame:
    """``groups`` with one signature for each list of members, and ``shared`` per document.

    Signatures that the same documents share lead to the same pairs. ``shared`` is the number of
    signatures a document had in common with others before.
    """
    lists = groups.groupBy("signature").agg(
        F.count("*").alias("members"), F.bit_xor(F.xxhash64("key")).alias("one"),
        F.sum(F.shiftright(F.xxhash64(F.lit(1), "key"), 24)).alias("other"),
    )
    kept = lists.groupBy("members", "one", "other").agg(F.min("signature").alias("signature"))
    shared = groups.groupBy("key").agg(F.count("*").alias("shared"))
    return groups.join(kept.select("signature"), "signature").join(shared, "key")


def block_pairs(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """All pairs of a signature's members in different components that sketches do not rule out.

    Members are cut into chunks of about ``CHUNK``; each two chunks meet in one place, where only
    pairs that may link are given out.
    """
    chunks = F.ceil(F.col("members") / CHUNK).cast("int")
    rows = (
        groups.join(classes, "key")
        .withColumn("chunk", F.pmod(F.xxhash64("key"), chunks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(
            "signature", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"),
            "key", "root", "n_shingles", "sketch", "chunk",
        )
    )

    def meet(batch: pd.DataFrame) -> pd.DataFrame:
        given = [batch[c].to_numpy() for c in ("signature", "lo", "hi")]
        order = np.lexsort(given[::-1])
        at_new = np.zeros(len(order), bool)
        at_new[0] = True
        for c in given:
            at_new[1:] |= c[order][1:] != c[order][:-1]
        first = np.flatnonzero(at_new)
        sizes, roots, keys, chunk, sketches = (
            batch[c].to_numpy()[order] for c in ("n_shingles", "root", "key", "chunk", "sketch")
        )
        across = (given[1] != given[2])[order]
        spread = np.minimum.reduceat(roots, first) != np.maximum.reduceat(roots, first)
        out: set[tuple[int, int]] = set()
        for start, end in zip(first[spread], np.append(first[1:], len(order))[spread], strict=True):
            size = min(map(len, sketches[start:end]))
            table = np.stack([folded(s, size) for s in sketches[start:end]])
            for at in range(start, end - 1):
                rest = slice(at + 1, end)
                may = roots[rest] != roots[at]
                if across[start]:
                    may &= chunk[rest] != chunk[at]
                may = np.flatnonzero(may)
                if not len(may):
                    continue
                apart = np.bitwise_count(table[may + at + 1 - start] ^ table[at - start]).sum(axis=1, dtype=np.int64)
                for k in may[alike(sizes[rest][may], sizes[at], apart)] + at + 1:
                    out.add((int(min(keys[at], keys[k])), int(max(keys[at], keys[k]))))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    # what a bucket holds follows from the rows as they are after members meet in chunks
    total = max(1, int(groups.agg(F.sum(chunks)).first()[0] or 0) // 5000)
    return (
        rows.withColumn("bucket", F.pmod(F.xxhash64("signature", "lo", "hi"), F.lit(total)))
        .groupBy("bucket")
        .applyInPandas(meet, "a long, b long")
        .distinct()
    )


def similar_documents(documents: DataFrame) -> DataFrame:
    """``(doc_id, text_key, n_shingles, component_id)``: one row per row of ``documents``.

    Sets are of distinct lower-cased word 5-grams (a shorter text is one n-gram); two link when
    their intersection is at least 75 hundredths of their union. ``component_id`` is the smallest
    doc_id reachable by links. Copies have one set and are one class; rows without words link with
    nothing and are their own component, whatever they repeat. Rows with a null id take part and
    have the component of what they link with. Columns other than doc_id and text are not read.
    N-grams are compared by 64-bit hashes.
    """
    given = as_documents(documents)
    sets = stored(gram_sets(given), "gram-sets")
    rows = sets.count()
    hot = frequent_signatures(given, rows)
    within = Window.partitionBy("signature")
    groups = stored(
        signed(given, hot)
        .withColumn("_low", F.min("key").over(within))
        .withColumn("_high", F.max("key").over(within))
        .filter("_low < _high")
        .select("signature", "key")
        .distinct(),
        "signatures",
    )
    groups = stored(without_repeats(groups), "groups")
    asked = groups.select("key").distinct()
    classes = stored(
        sets.filter("key is not null").join(asked, "key", "left_semi").groupBy("key").agg(
            F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"),
            F.min(F.struct(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text_key")).alias("rep"),
        ),
        "classes",
    )
    slim = classes.select("key", "n_shingles", "sketch")
    class_texts: list[DataFrame] = []

    def tested(pairs: DataFrame) -> DataFrame:
        likely = stored(closer(pairs, slim), "pairs")
        if not class_texts:
            # whatever is tested later has been near enough for the same signatures
            wanted = classes.select("key", "rep.doc_id", "rep.text_key")
            by_id = given.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))).join(wanted, ["doc_id", "text_key"])
            class_texts.append(stored(by_id.dropDuplicates(["doc_id", "text_key"]).select("key", "text"), "texts"))
        return stored(linked(likely, class_texts[0]), "links")

    first = groups.withColumn("root", F.col("key"))
    edges = [tested(star_pairs(first, 0))]
    roots = components(edges[0])
    for turn in range(1, 3):
        left = stored(with_roots(groups, roots), "open")
        if left.isEmpty():
            break
        pairs = star_pairs(left, turn) if turn == 1 else block_pairs(left, slim)
        edges.append(tested(pairs))
        roots = components(reduce(DataFrame.unionByName, edges))
    placed = sets.join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    placed = stored(placed.select("doc_id", "text_key", "n_shingles", "root"), "placed")
    smallest = placed.filter("root is not null").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    worded = placed.filter("root is not null").join(smallest, "root")
    return worded.select("doc_id", "text_key", "n_shingles", "component_id").unionByName(
        placed.filter("root is null").select("doc_id", "text_key", "n_shingles", F.col("doc_id").alias("component_id"))
    )


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of each component's smallest doc_id, one of them if they repeat, columns as they are.

    Rows without words stay, as does a component that has no id at all.
    """
    found = similar_documents(documents)
    gone = found.filter(
        F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))
        | (F.col("doc_id").isNull() & F.col("component_id").isNotNull())
    ).select(F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_key")).distinct()
    marked = documents.withColumn("_text_key", F.xxhash64(F.col("text").cast("string")))
    left = marked.join(
        gone,
        F.coalesce(marked["doc_id"].cast("long"), F.lit(-1)).eqNullSafe(F.coalesce(gone["_gone_id"], F.lit(-1)))
        & (marked["_text_key"] == gone["_gone_key"]),
        "left_anti",
    )
    keys = [F.col("doc_id").alias("_twice_id"), F.col("text_key").alias("_twice_key")]
    twice = stored(found.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n"), "repeated")
    if twice.isEmpty():
        return left.select(*documents.columns)
    same = left["doc_id"].cast("long").eqNullSafe(twice["_twice_id"]) & left["_text_key"].eqNullSafe(twice["_twice_key"])
    # only rows that repeat are moved to be told apart
    once = left.join(twice, same, "left_anti")
    repeated = left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "_text_key"])
    return once.unionByName(repeated).select(*documents.columns)
