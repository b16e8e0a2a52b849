"""op1, op2, op4, op5, op7 and op9: thin queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barflow.llm import fingerprints, jaccard_join, licences, near_vectors, secret_scan, toxicity
from barflow.llm.common import load, query


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


@query
def op1_toxicity(spark, sf_dir):
    docs = load(spark, sf_dir, "documents", "doc_id", "lang", "text")
    labels = load(spark, sf_dir, "labels", "doc_id", "toxic").filter(~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "threshold", "rejected")


@query
def op2_license_scan(spark, sf_dir):
    return licences.scan(load(spark, sf_dir, "documents", "doc_id", "text"), spark.createDataFrame(licences.TEMPLATES, "licence string, text string"))


def _op2_sql() -> str:
    """Exact containment of every template in every document; the notices have one licence each, so every true match is
    one that the bands must have retrieved."""
    names = ", ".join(f"('{n}', '{t}')" for n, t in licences.TEMPLATES)
    grams = "list_transform(range(1, len(w) - 1), lambda i: list_extract(w, i) || ' ' || list_extract(w, i + 1) || ' ' || list_extract(w, i + 2))"
    words = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    return f"""
WITH t AS (SELECT licence, list_distinct({grams}) AS g FROM (SELECT licence, {words.format("txt")} AS w FROM (VALUES {names}) v(licence, txt))),
d AS (SELECT doc_id, {grams} AS g FROM (SELECT doc_id, {words.format("text")} AS w FROM documents WHERE text IS NOT NULL))
SELECT doc_id, licence, len(list_intersect(t.g, d.g))::BIGINT AS found, len(t.g)::BIGINT AS of
FROM d, t WHERE len(list_intersect(t.g, d.g)) >= 0.75 * len(t.g)
"""


@query
def op4_document_fingerprints(spark, sf_dir):
    return fingerprints.compare_in_order(load(spark, sf_dir, "documents", "doc_id", "text"))


@query
def op5_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.near_classes(load(spark, sf_dir, "documents", "doc_id", "text"))


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w
), g AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM s),
link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, least(s.doc_id, coalesce(c.low, s.doc_id)) AS component_id
FROM s LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = s.doc_id
"""


@query
def op7_embedding_near_dedup(spark, sf_dir):
    return near_vectors.near_vectors(load(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


OP7_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), u AS (SELECT * FROM v WHERE list_dot_product(e, e) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.98
), reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(c.low, e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(c.low, e.vec_id)) AS kept,
       CASE WHEN EXISTS (SELECT 1 FROM link) THEN 1.0::DOUBLE END AS audited_recall
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM link GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) c ON c.a = e.vec_id
"""


@query
def op9_secret_scan(spark, sf_dir):
    return secret_scan.scan(load(spark, sf_dir, "documents", "doc_id", "text"), secret_scan.train())


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_license_scan": op2_license_scan,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op9_secret_scan": op9_secret_scan,
}
ORACLES = {"op2_license_scan": _op2_sql(), "op5_ngram_jaccard_join": OP5_SQL, "op7_embedding_near_dedup": OP7_SQL}
