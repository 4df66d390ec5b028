"""The queries of the corpus operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, hard_negatives, html_extract, language, lexical, mixing, packing, quality, secrets, sharding, simhash, token_counts, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(_table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), ["source", "lang", "n_chars", "doc_id"])


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    ratios = secrets.fit(secrets.labelled_strings(spark, documents, _table(spark, sf_dir, "labels")))
    return secrets.report(secrets.scan(documents, ratios))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of remainder 0 are held out, those of remainder 4 calibrate, the others train."""
    documents = _table(spark, sf_dir, "documents").withColumn("_part", language.remainder(F.col("doc_id")))
    model = language.train(documents.where("_part between 1 and 3"))
    model = language.calibrate(model, documents.where("_part = 4"))
    return language.predict(documents, model).withColumn("held_out", language.remainder(F.col("doc_id")) == 0)


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_html_extract": op2_html_extract,
    "op3_packing": op3_packing,
    "op4_mixing": op4_mixing,
    "op5_token_counts": op5_token_counts,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_topk": op8_topk,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_language": op11_language,
    "op12_lexical": op12_lexical,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": """
        WITH n AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
        )
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM n""",
    "op8_topk": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r
        ), n AS (
            SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id))::INT AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM n WHERE rank <= 20""",
    "op12_lexical": r"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents
        ), g AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
        q AS MATERIALIZED (
            SELECT DISTINCT r, item_id, term FROM (
                SELECT r, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
                FROM (SELECT row_number() OVER () AS r, * FROM benchmark))
        ), tf AS MATERIALIZED (
            SELECT r, any_value(doc_id) AS doc_id, any_value(n)::BIGINT AS n, term, count(*) AS tf
            FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term
        ), w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, n_docs),
        s AS (
            SELECT q.r, q.item_id, tf.r AS d, any_value(tf.doc_id) AS doc_id, sum(w * (1000000000 * tf // (1000 * tf + 8 * (10 + 90 * n * n_docs // n_terms))))::BIGINT AS score
            FROM q JOIN w USING (term) JOIN tf USING (term), g GROUP BY q.r, q.item_id, tf.r
        ), n AS (SELECT *, (row_number() OVER (PARTITION BY r ORDER BY score DESC, doc_id))::INT AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM n WHERE rank <= 10""",
    "op13_hard_negatives": """
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
            FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS MATERIALIZED (
            SELECT a.r, a.vec_id AS anchor_id, a.label = c.label AS same, c.r AS other, c.vec_id, list_inner_product(a.v, c.v)::BIGINT AS score
            FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r
        ), p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS n FROM s WHERE same) WHERE n <= 5),
        n AS (
            SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER (PARTITION BY p.r, p.other ORDER BY s.score DESC, s.vec_id))::INT AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
            FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
        )
        SELECT * FROM n WHERE rank <= 10""",
}
