"""The registered queries of this package, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, mixing, negatives, ngram_join, packing, part_codes, pseudonyms, quality, secrets, spans, topk, toxicity,
    url_lists,
)
from .common import table

#: the key the registered query and the pipeline permute with
PSEUDONYM_KEY = "2b7e151628aed2a6"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and prediction per document, with the place of the sentences that offend."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(documents, labels.filter(~held_out(F.col("doc_id"))))
    return toxicity.score(documents, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, distances to the nearest language reference and the verdict per document."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    rules = quality.QualityRules()
    judged = quality.judge(documents, quality.references(documents, rules), rules)
    return judged.select("doc_id", "quality.*")


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without repeated spans of sentences."""
    return spans.remove_repeats(table(spark, sf_dir, "documents"))


def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of each document."""
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op5_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with personal values permuted within their format."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise_documents(documents, PSEUDONYM_KEY)


# Names of listed hosts in the pages table.
LISTED = ("spam-farm", "cheap-pills", "casino-win", "free-bets", "ads-track")
START = "2024-01-01"


def drawn(text: Column, below: int) -> Column:
    """A number below ``below`` that follows from a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % below


def captures_of(pages: DataFrame) -> DataFrame:
    """Pages with the time they were fetched, which follows from id and URL within one year."""
    day = drawn(F.concat_ws("|", "url", F.col("page_id").cast("string")), 366)
    return pages.select(
        "page_id", "url",
        F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + day * 86400).alias("fetched_at"),
    )


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the hosts of the pages table.

    Listed names are added, removed and added again; every seventh other host is added and removed
    once, on days that follow from its name.
    """
    hosts = pages.select(url_lists.host_of(F.col("url")).alias("host")).dropna().distinct()
    named = F.lit(False)
    for name in LISTED:
        named = named | F.col("host").contains(name)
    base = F.regexp_replace("host", r"^(www|m|blog)\.", "")
    listed = hosts.filter(named | (drawn(base, 7) == 0)).select(
        base.alias("entry"), named.alias("named")
    ).distinct()
    first = drawn(F.concat("entry", F.lit("|a")), 100)
    second = first + 1 + drawn(F.concat("entry", F.lit("|b")), 100)
    third = second + 1 + drawn(F.concat("entry", F.lit("|c")), 100)

    def change(day: Column, action: str) -> Column:
        return F.struct(
            F.timestamp_seconds(F.unix_timestamp(F.lit(START).cast("timestamp")) + day * 86400).alias("at"),
            F.lit(action).alias("action"),
        )

    changes = F.array(change(first, "add"), change(second, "remove"), change(third, "add"))
    return (
        listed.withColumn("log", F.when(F.col("named"), changes).otherwise(F.slice(changes, 1, 2)))
        .select("entry", F.explode("log").alias("change"))
        .select("entry", "change.at", "change.action")
    )


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page against the entries active when it was fetched."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_lists.filter_captures(captures_of(pages), entries_of(pages))
    return found.select(
        "page_id", "host", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"), "blocked", "entry"
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of each query vector by integer inner product."""
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", topk.whole_numbers(F.col("embedding")).alias("data")
    )
    return topk.top_k(vectors, vectors.filter("vec_id % 50 = 0"), 5)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of secrets per document, as counts and digests."""
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents")))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each document under links of similar word 5-gram sets."""
    return ngram_join.similar_documents(table(spark, sf_dir, "documents")).drop("text_key")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of other labels that score a little below each positive of each anchor."""
    mislabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.usable(table(spark, sf_dir, "embeddings"), F.col("embedding"), mislabelled)
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes they decode to."""
    return byte_bpe.encode_documents(table(spark, sf_dir, "documents"), decoded=True).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op13_part_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, errors by label, and the digest of the codebooks."""
    coded, books = part_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select(
        "vec_id", part_codes.hex_code(F.col("codes")).alias("code"), "error", "label_error",
        F.lit(part_codes.books_digest(books)).alias("codebooks_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_quality_rules, op3_sentence_spans, op4_source_mix, op5_pseudonyms, op6_url_lists,
        op7_packing, op8_top_k, op9_secret_scan, op10_ngram_join, op11_hard_negatives, op12_byte_bpe, op13_part_codes,
    )
}

def codes_sql(rounds: int = 4) -> str:
    """Check SQL of the vector codes: every round is a step of its own."""
    nearest = """
  SELECT p.vec_id, p.position, p.part, arg_min(b.entry, (list_distance2(p.part, b.part), b.entry)) AS entry,
         min(list_distance2(p.part, b.part)) AS distance
  FROM parts p JOIN book{r} b USING (position) GROUP BY ALL""".replace(
        "list_distance2(p.part, b.part)",
        "list_sum(list_transform(list_zip(p.part, b.part), lambda z: (z[1] - z[2]) * (z[1] - z[2])))",
    )
    steps = "".join(
        f"""), assigned{r} AS ({nearest.format(r=r)}
), means{r} AS (
  SELECT position, entry, list(value ORDER BY place) AS part FROM (
    SELECT position, entry, place, floor(sum(part[place]) / count(*))::BIGINT AS value
    FROM assigned{r}, unnest(range(1, len(part) + 1)) AS t(place) GROUP BY ALL) GROUP BY ALL
), book{r + 1} AS (
  SELECT b.position, b.entry, coalesce(m.part, b.part) AS part
  FROM book{r} b LEFT JOIN means{r} m USING (position, entry)
"""
        for r in range(rounds)
    )
    return f"""
WITH whole AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), parts AS (
  SELECT vec_id, position, v[position * len(v) // 4 + 1 : (position + 1) * len(v) // 4] AS part
  FROM whole, unnest(range(4)) AS t(position)
), book0 AS (
  SELECT position, (row_number() OVER (PARTITION BY position ORDER BY vec_id) - 1)::INTEGER AS entry, part
  FROM parts QUALIFY entry < 256
{steps}), final AS ({nearest.format(r=rounds)}
), coded AS (
  SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY position) AS code, sum(distance)::BIGINT AS error
  FROM final GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY position, entry)) AS codebooks_sha256
  FROM book{rounds}
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN whole USING (vec_id), digest
"""


#: check SQL of the queries that SQL can express
SQL = {
    "op6_url_lists": r"""
WITH captures AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url,
           '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', ''), '') AS host,
         DATE '2024-01-01' + (('0x' || substr(md5(concat_ws('|', url, page_id)), 1, 8))::BIGINT % 366)::INTEGER AS day
  FROM pages
), bases AS (
  SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\.', '') AS entry,
         regexp_matches(host, 'spam-farm|cheap-pills|casino-win|free-bets|ads-track') AS named
  FROM captures WHERE host IS NOT NULL
), drawn AS (
  SELECT entry, named,
         (('0x' || substr(md5(entry || '|a'), 1, 8))::BIGINT % 100)::INTEGER AS d1,
         (('0x' || substr(md5(entry || '|b'), 1, 8))::BIGINT % 100)::INTEGER + 1 AS d2,
         (('0x' || substr(md5(entry || '|c'), 1, 8))::BIGINT % 100)::INTEGER + 1 AS d3
  FROM bases
  WHERE named OR ('0x' || substr(md5(entry), 1, 8))::BIGINT % 7 = 0
), runs AS (
  SELECT entry, DATE '2024-01-01' + d1 AS starts, DATE '2024-01-01' + d1 + d2 AS ends FROM drawn
  UNION ALL
  SELECT entry, DATE '2024-01-01' + d1 + d2 + d3, NULL FROM drawn WHERE named
), hits AS (
  SELECT c.page_id, max_by(r.entry, length(r.entry)) AS entry
  FROM captures c JOIN runs r
    ON (c.host = r.entry OR ends_with(c.host, '.' || r.entry))
   AND c.day >= r.starts AND (r.ends IS NULL OR c.day < r.ends)
  GROUP BY c.page_id
)
SELECT c.page_id, c.host, strftime(c.day, '%Y-%m-%d') AS fetched_on, h.entry IS NOT NULL AS blocked, h.entry
FROM captures c LEFT JOIN hits h USING (page_id)
""",
    "op8_top_k": """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM whole q JOIN whole c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, (row_number() OVER w)::INTEGER AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
""",
    "op11_hard_negatives": """
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM whole a JOIN whole r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id, positive_score,
       s.score AS negative_score
FROM positives p JOIN scored s USING (anchor_id)
WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 5
""",
    "op13_part_codes": codes_sql(),
}
