"""The registered ``opN_<name>`` queries: each derives its contract's columns from its operator's results."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from busguard.llm.common import drop_folder, scratch_path
from busguard.llm.decontaminate import find_contamination
from busguard.llm.hard_negatives import hard_negatives
from busguard.llm.html_text import extract_text
from busguard.llm.jaccard_join import similarity_components
from busguard.llm.language_id import identify, is_held_out, learn
from busguard.llm.lexical_search import ranked_search
from busguard.llm.line_dedup import dedup_lines
from busguard.llm.nearest import nearest
from busguard.llm.secret_scan import find_secrets
from busguard.llm.sentencepiece_codec import encode_decode
from busguard.llm.shards import RECORD_BYTES, shuffle_into_shards, text_bytes
from busguard.llm.substring_dedup import remove_repeats
from busguard.llm.warc import convert_arc, page_records, write_arc


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sha256(c) -> F.Column:
    return F.sha2(c, 256)


def op1_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract_text(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", sha256(F.encode("text", "UTF-8")).alias("kept_sha256"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(read(spark, sf_dir, "documents").select("doc_id", "text"))
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return out.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"),
                      count("hex").alias("n_hex"),
                      sha256(F.encode(F.array_join(F.transform(base, shown), ","), "UTF-8")).alias("base_sha256"),
                      F.array_join(F.transform("secrets", shown), ",").alias("spans"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.filter(~is_held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_contamination(read(spark, sf_dir, "documents").select("doc_id", "text"),
                             read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate(F.sequence(F.lit(0), F.size("hit_spans") - 2, F.lit(2)), F.lit(0).cast("long"),
                        lambda n, i: n + F.element_at("hit_spans", i + 2) - F.element_at("hit_spans", i + 1))
    n_hit = F.when(F.size("hit_spans") > 0, n_hit).otherwise(F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                      sha256(F.encode(F.array_join("hit_items", ","), "UTF-8")).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_decode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_tokens", sha256("ids").alias("ids_sha256"),
                      sha256(F.encode("decoded", "UTF-8")).alias("decoded_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return similarity_components(docs, k=3, similarity=Fraction(90, 100))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shuffle_into_shards(read(spark, sf_dir, "documents").select("doc_id", "text"), 40)
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", (text_bytes(F.col("text")) + RECORD_BYTES).alias("size"),
                      F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    write_arc(read(spark, sf_dir, "pages"), arc)
    convert_arc(spark, arc, warc)
    drop_folder(spark, arc)
    return page_records(spark, warc).select(
        "page_id", F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("refers_to_page").alias("refers_to"), "url", "sound")


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
                      F.floor(F.size("removed_spans") / 2).cast("long").alias("n_spans"),
                      sha256("kept").alias("kept_sha256"))


def op12_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives(vectors, F.col("vec_id") % 50 == 0)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LINE_DEDUP_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS kept FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.doc_id, line, pos, kept IS NOT NULL AND kept <> k.doc_id AS gone FROM keyed k LEFT JOIN repeated USING (key)
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id"""

DECONTAMINATE_SQL = f"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM iw WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win
), grams AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)
), hit AS (SELECT DISTINCT doc_id, n, i, item_id FROM grams JOIN win USING (n, g)
), pos AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""

WARC_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT *, strlen(body) AS n, min(page_id) OVER (PARTITION BY body) AS first FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha256(body) AS payload_digest,
  CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to,
  coalesce(nullif(regexp_replace(url, '\\s', '%20', 'g'), ''), 'urn:unknown') AS url, true AS sound
FROM d"""

RANKED_SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS w
  FROM benchmark
), c AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(w)) AS BIGINT) AS nl FROM d WHERE len(w) > 0
), t AS (
  SELECT doc_id, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) GROUP BY ALL
), asked AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS r FROM (SELECT item_id, unnest(w) AS term FROM i) GROUP BY ALL
), weighed AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight
  FROM t, c GROUP BY term, nd
), scored AS (
  SELECT item_id, doc_id,
    CAST(sum(r * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // nl)))) AS BIGINT) AS score
  FROM asked JOIN weighed USING (term) JOIN t USING (term), c GROUP BY item_id, doc_id
)
SELECT * FROM (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0) WHERE rank <= 20"""

HARD_NEGATIVES_SQL = """
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT a.id AS anchor_id, b.id AS other, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.id % 50 = 0 AND a.id <> b.id
), p AS (
  SELECT * FROM (SELECT anchor_id, other AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) AS place FROM s WHERE same) WHERE place <= 5
)
SELECT * FROM (
  SELECT anchor_id, positive_id,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
    other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id)
  WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score) WHERE rank <= 3"""

#: name: (query, DuckDB text or None where SQL cannot express the result or is too slow on whole tables)
Q = {
    "op1_cross_polytope": (op1_cross_polytope, None),
    "op2_html_text": (op2_html_text, None),
    "op3_line_dedup": (op3_line_dedup, LINE_DEDUP_SQL),
    "op4_secrets": (op4_secrets, None),
    "op5_language_id": (op5_language_id, None),
    "op6_decontaminate": (op6_decontaminate, DECONTAMINATE_SQL),
    "op7_sentencepiece": (op7_sentencepiece, None),
    "op8_jaccard_join": (op8_jaccard_join, None),
    "op9_shards": (op9_shards, None),
    "op10_warc": (op10_warc, WARC_SQL),
    "op11_suffix_dedup": (op11_suffix_dedup, None),
    "op12_max_sketch": (op12_max_sketch, RANKED_SQL),
    "op13_hard_negatives": (op13_hard_negatives, HARD_NEGATIVES_SQL),
}
