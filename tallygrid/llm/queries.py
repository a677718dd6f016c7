"""The registered corpus queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrid.llm import pivot_search
from tallygrid.llm.alignment import token_alignment
from tallygrid.llm.byte_bpe import round_trip
from tallygrid.llm.common import content, table
from tallygrid.llm.exact_dedup import exact_dedup
from tallygrid.llm.fingerprint import edited_likeness
from tallygrid.llm.html_text import main_text
from tallygrid.llm.license_scan import TEMPLATES, THRESHOLD, license_scan
from tallygrid.llm.lm_scoring import log_probabilities
from tallygrid.llm.near_dedup import near_dedup
from tallygrid.llm.packing import pack, pieces
from tallygrid.llm.quality import scored, train
from tallygrid.llm.registry import ORACLES, QUERIES, query  # noqa: F401
from tallygrid.llm.resampling import resample
from tallygrid.llm.sharding import hilbert_ranked, shard_rows

EXACT_DEDUP_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
), g AS (
  SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""


@query("op3_exact_dedup", EXACT_DEDUP_SQL)
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query("op7_hilbert_sharding")
def op7_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = content("text").cast("binary")
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
    )
    ranked = hilbert_ranked(docs, ["lang", "source", "size"], ["text_crc32", "doc_id"])
    return shard_rows(ranked, 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op8_scaled_fingerprints")
def op8_scaled_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))


@query("op1_pu_quality")
def op1_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, train(docs, table(spark, sf_dir, "labels")))


@query("op2_prefix_bpe")
def op2_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return round_trip(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op5_setsketch_near_dedup")
def op5_setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), width=3, percent=85)


@query("op4_wrapper_text")
def op4_wrapper_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


@query("op10_context_mixing")
def op10_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_probabilities(table(spark, sf_dir, "documents"))


_TEMPLATE_ROWS = ", ".join(f"('{name}', '{text}')" for name, text in TEMPLATES.items())
LICENSE_SQL = rf"""
WITH templates(license, body) AS (VALUES {_TEMPLATE_ROWS}),
files AS (
  SELECT doc_id, coalesce(text, '') AS body,
    concat_ws('/', source, CASE WHEN doc_id % 3 > 0 THEN lang END, CASE WHEN doc_id % 3 > 1 THEN (doc_id // 64)::VARCHAR END,
      CASE WHEN doc_id % 4 = 0 THEN 'LICENSE-' || doc_id ELSE doc_id || '.txt' END) AS path
  FROM documents
),
template_tokens AS (
  SELECT license, token, count(*) AS tf
  FROM (SELECT license, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) AS token FROM templates) WHERE token <> '' GROUP BY ALL
),
df AS (
  SELECT token, count(DISTINCT doc_id) AS n
  FROM (SELECT doc_id, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) AS token FROM files)
  WHERE token IN (SELECT token FROM template_tokens) GROUP BY token
),
total AS (SELECT count(*) AS n FROM files),
lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line, unnest(parts) AS body
  FROM (SELECT doc_id, string_split(body, chr(10)) AS parts FROM files)
),
line_tokens AS (
  SELECT doc_id, line, token, count(*) AS tf
  FROM (SELECT doc_id, line, unnest(string_split_regex(lower(body), '[^a-z0-9]+')) AS token FROM lines)
  WHERE token <> '' GROUP BY ALL
),
vocabulary AS (SELECT DISTINCT token FROM template_tokens),
idf AS (
  SELECT v.token, ln((total.n + 1) / (coalesce(df.n, 0) + 1)) + 1 AS w FROM vocabulary v CROSS JOIN total LEFT JOIN df USING (token)
),
weighed AS (
  SELECT doc_id, line, token, tf * coalesce(idf.w, (SELECT ln(n + 1) + 1 FROM total)) AS w FROM line_tokens LEFT JOIN idf USING (token)
),
norms AS (SELECT doc_id, line, sqrt(sum(w * w)) AS norm FROM weighed GROUP BY ALL),
template_weights AS (SELECT license, token, tf * w AS w FROM template_tokens JOIN idf USING (token)),
template_norms AS (SELECT license, sqrt(sum(w * w)) AS norm FROM template_weights GROUP BY license),
scores AS (
  SELECT doc_id, line, license, round(sum(l.w * t.w) / (any_value(n.norm) * any_value(m.norm)), 6) AS score
  FROM weighed l JOIN template_weights t USING (token) JOIN norms n USING (doc_id, line) JOIN template_norms m USING (license)
  GROUP BY doc_id, line, license
),
best AS (
  SELECT doc_id, line, license, score FROM scores WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY score DESC, license) = 1
),
own AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, line, license) = 1),
named AS (
  SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, own.line, own.license, own.score FROM files f LEFT JOIN own USING (doc_id)
),
dirs AS (
  SELECT dir, b.license FROM named n JOIN best b USING (doc_id) WHERE path LIKE '%LICENSE-%'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY b.score DESC, path, b.line, b.license) = 1
),
inherited AS (
  SELECT n.doc_id, d.dir AS up, d.license FROM named n JOIN dirs d ON n.dir = d.dir OR starts_with(n.dir, d.dir || '/')
  WHERE n.license IS NULL QUALIFY row_number() OVER (PARTITION BY n.doc_id ORDER BY length(d.dir) DESC) = 1
)
SELECT n.doc_id, path, n.license AS own_license, score AS own_score, coalesce(n.license, i.license) AS license, i.up AS license_dir
FROM named n LEFT JOIN inherited i USING (doc_id)
"""


@query("op9_license_scan", LICENSE_SQL)
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of source/lang/block folders, at three depths; those named LICENSE-* speak for their folder."""
    path = F.concat_ws(
        "/",
        "source",
        F.when(F.expr("doc_id % 3 > 0"), F.col("lang")),
        F.when(F.expr("doc_id % 3 > 1"), F.expr("doc_id div 64").cast("string")),
        F.when(F.expr("doc_id % 4 = 0"), F.concat(F.lit("LICENSE-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))),
    )
    files = table(spark, sf_dir, "documents").withColumn("path", path)
    return license_scan(files, "doc_id", "path", "text", F.col("path").rlike(r"(^|/)LICENSE-[^/]*$"))


TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY rank <= 5
"""


@query("op11_pivot_top_k", TOP_K_SQL)
def op11_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of each vector whose id is divisible by 50; an empty table gives no rows."""
    vectors = table(spark, sf_dir, "embeddings")
    index = pivot_search.build(vectors)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return pivot_search.search(index, F.col("id") % 50 == 0, 5).withColumnRenamed("id", "vec_id")


@query("op12_token_alignment")
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the byte-level and the piece tokens of each whole text, with corpus counts of the linked pairs."""
    files = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    return token_alignment(table(spark, sf_dir, "documents"), *files)


# crc32 by its rule: 256 table entries from eight shifts each, then one step for each byte; once for each distinct feature
RESAMPLE_SQL = r"""
WITH RECURSIVE crc(i, step, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL
  SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE step < 8
), lookup AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE step = 8),
texts AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), split AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts
), features AS (
  SELECT side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM split
), hashed AS (
  SELECT f, xor(list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
      lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM features), lookup
), filled AS (SELECT side, id, bucket FROM features JOIN hashed USING (f)),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM filled GROUP BY bucket),
totals AS (SELECT sum(s)::BIGINT AS all_s, sum(t)::BIGINT AS all_t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (all_s + 10000))::DOUBLE / ((s + 1) * (all_t + 10000))::DOUBLE))::BIGINT AS gain
  FROM counts, totals
), weights AS (
  SELECT id, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM filled JOIN gains USING (bucket) WHERE side = 0 GROUP BY id
), scored AS (
  SELECT p.id AS doc_id, len(p.w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || p.id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM split p LEFT JOIN weights USING (id) WHERE p.side = 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_words >= 20) OVER () AS n
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 25 * n // 100 THEN place END AS rank FROM placed
"""


@query("op13_importance_resampling", RESAMPLE_SQL)
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn towards the benchmark's words and word pairs."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
