"""Corpus pipeline: language, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of ``docs``.

* language_id drops texts without a letter, and texts whose best language has a calibrated
  probability below ``LEAST_LANGUAGE``. It learns from all labelled rows it is given.
* near_dedup keeps one document of each group of near copies (word shingles of five, similarity 0.8).
* decontaminate drops documents that hold a benchmark item, with its own or with other values.
* redact_secrets replaces secrets by ``[SECRET]`` and sets ``n_chars`` anew where there were any.
* encode_bpe returns doc_id, lang, source, n_tokens, ids and digests of the ids and of the decoded bytes.

A doc_id names one document: of its repeated rows one stays. Rows with a null doc_id pass the
second and third stage unmatched.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelspark.llm import bpe_queue, crf_secrets, langid, minhash_forest, templates
from parcelspark.session import materialise, ship_package

#: Below this probability of the best language a text counts as in no known language.
LEAST_LANGUAGE = 0.35


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = langid.predict(docs, langid.train(docs))
    return found.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE)).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    groups = minhash_forest.near_duplicates(docs, width=5, percent=80)
    dropped = groups.filter(~F.col("kept")).select("doc_id").distinct()
    # repeated rows of a kept id are one document
    return docs.join(dropped, "doc_id", "left_anti").select(docs.columns).transform(_once)


def _once(docs: DataFrame) -> DataFrame:
    """One row of each non-null doc_id that stands more than once."""
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 and doc_id is not null").select("doc_id")
    if not repeated.limit(1).count():
        return docs
    repeated = materialise(repeated, "repeated")
    single = docs.join(repeated, "doc_id", "left_anti").select(docs.columns)
    return single.unionByName(docs.join(repeated, "doc_id").select(docs.columns).dropDuplicates(["doc_id"]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = templates.contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = crf_secrets.scan(docs, crf_secrets.train(docs))
    changed = F.coalesce(F.col("spans"), F.lit("")) != ""
    columns = {"text": F.col("redacted"), "n_chars": F.when(changed, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))}
    return found.withColumns(columns).select(docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe_queue.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=("lang", "source"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("redact_secrets", redact_secrets),
    ("encode_bpe", encode_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


#: Trained models and hashing decide on rows, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None
