"""The registered queries of this subpackage: thin callers of the operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import bpe, decontam, langid, negatives, pii, resample, secrets, simhash, tokencount, topk, toxicity, urlfilter, warc
from corvane.llm.common import bounded_batches

MULTI_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096
#: A stand-in: in use, the key comes from where secrets are kept.
PII_KEY = "a key for tests"
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.private_texts(table(spark, sf_dir, "documents"), PII_KEY)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), MULTI_RANKS)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return urlfilter.judged(pages, URL_RULES, urlfilter.listed_labels(pages, URL_RULES))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.findings(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(found["fp"]).alias("fingerprint"), "component_id")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(documents, PIECE_MODEL, TOKEN_LIMIT).drop("text")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(table(spark, sf_dir, "documents"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label)


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_url_filter": op3_url_filter,
    "op4_secrets": op4_secrets,
    "op5_simhash": op5_simhash,
    "op6_top_k": op6_top_k,
    "op7_token_counts": op7_token_counts,
    "op8_decontamination": op8_decontamination,
    "op9_warc": op9_warc,
    "op10_language_id": op10_language_id,
    "op11_toxicity": op11_toxicity,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_resampling": op13_resampling,
}


def _secret_spans() -> str:
    """All rules' spans, the pieces between matches giving their places, in SQL."""
    parts = []
    for order, rule in enumerate(secrets.RULES):
        pattern = (("(?i)" if rule.any_case else "") + rule.pattern).replace("'", "''")
        parts.append(f"""
        SELECT doc_id, '{rule.kind}' AS kind, {order} AS ord, unnest(list_transform(range(1, len(m) + 1), lambda i: {{
            'start': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0), 'n': length(m[i]), 'own': length(g[i])}})) AS s
        FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS m, regexp_extract_all(text, '{pattern}', {rule.group}) AS g, string_split_regex(text, '{pattern}') AS p FROM documents WHERE regexp_matches(text, '{pattern}'))
        """)
    kept = f"spans AS (SELECT doc_id, kind, ord, s.start::BIGINT AS a, (s.start + s.n)::BIGINT AS b, s.own AS own FROM ({' UNION ALL '.join(parts)}))"
    least = " AND ".join(f"(kind <> '{r.kind}' OR own >= {r.least})" for r in secrets.RULES if r.least)
    return f"{kept}, found AS (SELECT doc_id, kind, ord, a, kind || ':' || a || ':' || b AS mark FROM spans WHERE {least})"


ORACLES: dict[str, str] = {
    "op4_secrets": f"""
        WITH {_secret_spans()}
        SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
               sha256(coalesce(string_agg(mark, ',' ORDER BY a, ord) FILTER (ord < {len(secrets.BASE_RULES)}), '')) AS base_sha256, coalesce(string_agg(mark, ',' ORDER BY a, ord), '') AS spans
        FROM documents d LEFT JOIN found f ON f.doc_id = d.doc_id GROUP BY d.doc_id
    """,
    "op8_decontamination": r"""
        WITH w AS (SELECT doc_id AS id, 0 AS side, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents UNION ALL SELECT item_id, 1, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') FROM benchmark),
        s AS (SELECT DISTINCT id, side, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM w WHERE len(w) > 0),
        n AS (SELECT id AS item_id, count(*) AS n FROM s WHERE side = 1 GROUP BY id),
        j AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared FROM s d JOIN s i ON d.s = i.s AND d.side = 0 AND i.side = 1 GROUP BY ALL)
        SELECT doc_id, item_id, n_shared, n AS n_item, n_shared / n AS containment FROM j JOIN n USING (item_id) WHERE n_shared >= 0.8 * n
    """,
    "op6_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op12_hard_negatives": """
        WITH v AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i]))::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id % 50 = 0 AND c.vec_id <> a.vec_id
        ), p AS (
            SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
        ), n AS (
            SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
            FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
        )
        SELECT * FROM n WHERE rank <= 3
    """,
    "op9_warc": """
        WITH p AS (SELECT page_id, COALESCE(html, '') AS html FROM pages),
        d AS (SELECT page_id, sha256(html) AS digest, strlen(html) AS n FROM p),
        m AS (SELECT digest, min(page_id) AS least FROM d WHERE n >= 100 GROUP BY digest)
        SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM least AND least IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
        FROM d LEFT JOIN m USING (digest)
    """,
}
