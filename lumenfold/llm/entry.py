"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, html, licenses, lm, media, mixing, neardup, resample, topk, toxicity, urls
from .common import crc_bucket, read


def op1_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t (turn, role)")
    out = chat.format_chat(rows.unionByName(own)).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    lines = F.transform("turns", lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n")))
    return out.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), s AS (
  SELECT *, CASE WHEN contains(text, chr(92)) OR regexp_matches(text, '\[/?INST\]|</?s>|\[TURN|\[/TURN\]')
      THEN length(regexp_replace(text, '([\\\[<])', '\\\1', 'g')) ELSE length(text) END
    + CASE WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 9 ELSE 15 + CASE WHEN role IS NULL THEN 0
        WHEN regexp_full_match(role, '[A-Za-z0-9_.-]+') THEN 1 + length(role) ELSE 2 + 2 * octet_length(encode(role)) END END AS shown
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
""".replace("\\\\", "\\")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(read(spark, sf_dir, "documents"), width=3, threshold=(85, 100))
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) END) AS g FROM w
), n AS MATERIALIZED (
  SELECT doc_id, count(g) AS n FROM w LEFT JOIN s USING (doc_id) GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), links AS MATERIALIZED (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * same >= 85 * (x.n + y.n - same)
), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT a AS doc_id, b AS other FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other
)
SELECT doc_id, n AS n_shingles, coalesce(least(doc_id, min(other)), doc_id) AS component_id, coalesce(least(doc_id, min(other)), doc_id) = doc_id AS kept
FROM n LEFT JOIN reach USING (doc_id) GROUP BY doc_id, n
"""


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return html.main_text(pages, html.fit(pages)).withColumnRenamed("id", "page_id")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return mixing.mix_sources(docs, mixing.word_count(F.col("text"))).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "source", "copies"
    )


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP6_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    docs = bpe.encode_texts(read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN)
    return docs.withColumnRenamed("id", "doc_id")


def op8_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(read(spark, sf_dir, "documents"), crc_bucket(F.col("id"), 7) == 2).withColumnRenamed("id", "doc_id")


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op9_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "confidence")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op11_align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as tokenizers

    out = align.align_texts(read(spark, sf_dir, "documents"), tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("id", "doc_id")


BASE_PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def op12_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), BASE_PHRASES).withColumnRenamed("id", "doc_id").drop("found")


def _op12_sql() -> str:
    """Every rule at every word of every document that holds one of its keywords, without blocks."""
    found = licenses.rules(BASE_PHRASES)
    reach = max(licenses.width(r[5]) for r in found)
    rows = ", ".join(f"({rank}, {cls}, '{label}', {weight}, '{needs[0]}', '^((?:{pattern.replace('W', '[^ ]+')}))(?: |$)')" for rank, cls, label, weight, needs, pattern in found)
    return f"""
WITH rules (rank, class, label, weight, needs, pattern) AS (VALUES {rows}),
w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), able AS MATERIALIZED (
  SELECT doc_id, w, list(rank) AS ranks FROM w JOIN rules ON list_contains(w, needs) GROUP BY doc_id, w
), places AS MATERIALIZED (
  SELECT doc_id, i - 1 AS start, array_to_string(w[i:i + {reach - 1}], ' ') AS here, ranks FROM (SELECT doc_id, w, ranks, unnest(range(1, len(w) + 1)) AS i FROM able)
), tried AS (
  SELECT doc_id, start, here, unnest(ranks) AS rank FROM places
), hits AS MATERIALIZED (
  SELECT doc_id, start, rank, class, label, weight, start + len(hit) - len(replace(hit, ' ', '')) AS stop FROM (
    SELECT *, regexp_extract(here, pattern, 1) AS hit FROM tried JOIN rules USING (rank) WHERE contains(here, needs)
  ) WHERE hit <> ''
), kept AS (
  SELECT * FROM hits d WHERE class < 0 OR NOT EXISTS (
    SELECT 1 FROM hits e WHERE e.doc_id = d.doc_id AND e.class >= 0 AND e.rank < d.rank AND e.start <= d.start AND e.stop >= d.stop)
), found AS (
  SELECT doc_id, count(*) FILTER (class < 0) AS n_base, min(start) FILTER (class < 0) AS first_word, max(start) FILTER (class < 0) AS last_word,
    array_to_string(list_sort(list(DISTINCT label) FILTER (class < 0)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(weight) AS score
  FROM kept GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
  coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN found USING (doc_id)
"""


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.withColumnRenamed("id", "doc_id")


OP13_SQL = r"""
WITH RECURSIVE crc (n, k, v) AS (
  SELECT n, 0, n FROM range(256) t (n)
  UNION ALL SELECT n, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM crc WHERE k < 8
), steps AS MATERIALIZED (SELECT list(v ORDER BY n) AS t FROM crc WHERE k = 8),
texts AS (
  SELECT doc_id, text, true AS raw FROM documents UNION ALL SELECT NULL, text, false FROM benchmark
), words AS MATERIALIZED (
  SELECT doc_id, raw, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), each AS MATERIALIZED (
  SELECT doc_id, raw, w, count(*) AS k FROM (SELECT doc_id, raw, unnest(w) AS w FROM words) GROUP BY ALL
), hashed AS MATERIALIZED (
  SELECT w, xor(list_reduce(list_concat([4294967295], [CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT) FOR i IN range(1, octet_length(encode(w)) + 1)]),
    lambda a, b: xor(a >> 8, t[CAST(xor(a % 256, b) AS BIGINT) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM each), steps
), counts AS (
  SELECT bucket, coalesce(sum(k) FILTER (raw), 0) AS s, coalesce(sum(k) FILTER (NOT raw), 0) AS t FROM each JOIN hashed USING (w) GROUP BY bucket
), gain AS MATERIALIZED (
  SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM counts) + 10000) / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM counts) + 10000)))) AS g FROM counts
), weights AS (
  SELECT doc_id, CAST(sum(g * k) AS BIGINT) AS weight FROM each JOIN hashed USING (w) JOIN gain USING (bucket) WHERE raw GROUP BY doc_id
), scored AS (
  SELECT d.doc_id, len(d.w) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
  FROM words d LEFT JOIN weights USING (doc_id) WHERE raw
), drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= (SELECT count(*) FROM scored WHERE n_features >= 20) * 10 // 100
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_format_chat": OP1_SQL, "op3_near_duplicates": OP3_SQL, "op6_exact_top_k": OP6_SQL, "op12_scan_licenses": _op12_sql(), "op13_importance_resampling": OP13_SQL}
