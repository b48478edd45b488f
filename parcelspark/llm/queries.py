"""The numbered queries bound to the test tables, and their SQL for an independent engine."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelspark.llm.bpe_queue import encode_documents
from parcelspark.llm import bloom_lm, centroids, crf_secrets, heap_counts, html_trees, langid, minhash_forest, resample, templates, toxicity
from parcelspark.llm.textblocks import remainder
from parcelspark.llm.token_files import read_token_files, write_token_files
from parcelspark.llm.topk import quantised, top_products
from parcelspark.session import shared_folder, ship_package


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bloom_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (remainder(F.col("doc_id"), 7) != 2).alias("learn"))
    found = bloom_lm.score(docs)
    return found.select("doc_id", (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_trees.extract(pages, html_trees.train(pages)).select("page_id", "url", "text", "n_chars")


def op3_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(_table(spark, sf_dir, "documents"), width=3, percent=85)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = crf_secrets.scan(docs, crf_secrets.train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_token_files(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(remainder(F.col("doc_id"), 3) != 1))
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return langid.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")


def op8_top_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return top_products(vectors, vectors.filter("id % 50 = 0"), 5)


def op9_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    labels = _table(spark, sf_dir, "labels").filter(remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels)
    rows = docs.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return toxicity.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op11_heap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_counts.count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, limit=1024)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=25, least_words=20, buckets=10_000, seed=7)


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, width=64, scale=1024, seed=3)


QUERIES = {f.__name__: f for f in (
    op1_bloom_scores, op2_main_text, op3_minhash_forest, op4_secrets, op5_token_files, op6_byte_bpe, op7_language, op8_top_products,
    op9_template_leaks, op10_toxicity, op11_heap_counts, op12_resample, op13_centroids)}


def _centroid_sql(clusters: int = 8, rounds: int = 10) -> str:
    """All rounds written out, each with every distance computed in full."""
    steps = ["""
        v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
        c0 AS MATERIALIZED (
            SELECT CAST(row_number() OVER (ORDER BY h, q) - 1 AS INTEGER) AS k, q
            FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, q FROM v ORDER BY h, q LIMIT {clusters}))"""]
    for r in range(rounds + 1):
        steps.append(f"""
        a{r} AS MATERIALIZED (
            SELECT row, k, d FROM (
                SELECT row, k, d, row_number() OVER (PARTITION BY row ORDER BY d, k) AS place FROM (
                    SELECT v.row, c.k, list_sum(list_transform(list_zip(v.q, c.q), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{r} c))
            WHERE place = 1)""")
        if r < rounds:
            steps.append(f"""
        c{r + 1} AS MATERIALIZED (
            SELECT o.k, coalesce(n.q, o.q) AS q FROM c{r} o LEFT JOIN (
                SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS q FROM (
                    SELECT k, j, sum(x) AS s, count(*) AS n FROM (
                        SELECT a.k, unnest(v.q) AS x, generate_subscripts(v.q, 1) AS j FROM v JOIN a{r} a ON v.row = a.row)
                    GROUP BY k, j)
                GROUP BY k) n ON o.k = n.k)""")
    return "WITH" + ",".join(steps) + f"""
        SELECT v.vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(a.d AS BIGINT) AS distance,
            CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
            sha256(array_to_string(c.q, ',')) AS centroid_sha256
        FROM v JOIN a{rounds} a ON v.row = a.row JOIN c{rounds} c ON c.k = a.k"""


ORACLES = {
    "op8_top_products": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 256) AS DOUBLE)) AS q
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op13_centroids": _centroid_sql(),
}
