"""Secrets without a pattern: planted into texts the field was not fitted to."""

import random
import string

import pytest
from pyspark.sql import functions as F

from parcelspark.llm import crf_secrets as crf


@pytest.fixture(scope="module")
def model(spark):
    return crf.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 0"))


def measured(model, texts, seed):
    """(secrets, found, field spans, right field spans); right: it touches a planted secret."""
    secrets = found = spans = right = 0
    for k, text in enumerate(texts):
        made, planted, _ = crf.plant(text, random.Random(seed + k))
        every = crf.find_spans([made], model)[0]
        base = [(a, b) for a, b, kind in every if kind < 3]
        field = [(a, b) for a, b, kind in every if kind == 3]
        hidden = [(a, b) for a, b in planted if not any(c < b and a < d for c, d in base)]
        secrets += len(hidden)
        found += sum(any(c <= a + 1 and d >= b - 3 for c, d in field) for a, b in hidden)
        spans += len(field)
        right += sum(any(c < b and a < d for c, d in planted) for a, b in field)
    return secrets, found, spans, right


def test_held_out_precision_and_recall_of_secrets_without_a_pattern(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id % 2 = 1 and text <> ''").select("text").limit(300).collect()
    secrets, found, spans, right = measured(model, [r.text for r in rows], 10**10)
    print(f"recall {found}/{secrets}, precision {right}/{spans}")
    assert secrets > 300
    assert found >= 0.9 * secrets and right >= 0.9 * spans


def test_secrets_in_plain_sentences(model):
    draw = random.Random(3)
    mixed = lambda n, letters=string.ascii_letters + string.digits: "".join(draw.choices(letters, k=n))
    secrets = [mixed(n) for n in (20, 24, 32, 40, 44)] + ["ghp_" + mixed(36), mixed(40, "0123456789ABCDEF"), mixed(32, string.ascii_uppercase + string.digits)]
    for words in ("We met on Tuesday and wrote {} on the board before lunch.", "Send it with bearer {} please.", "The aws_key {} is old."):
        hits = sum(any(kind == 3 and text[a:b].strip() == s for a, b, kind in crf.find_spans([text], model)[0]) for s in secrets for text in [words.format(s)])
        assert hits >= len(secrets) - 1


def test_harmless_look_alikes_are_left(model):
    for text in ("The record 123e4567-e89b-42d3-a456-426614174000 was closed.", "See https://example.org/page/aB3dE9xYz12kLmNoPq for more.",
                 "Donaudampfschifffahrtsgesellschaftskapitän war er nie.", "Invoice INV-2021-004512 is paid.", "", "a", "plain words only, nothing else"):
        assert [s for s in crf.find_spans([text], model)[0] if s[2] == 3] == []


def test_equal_rows_count_once_in_the_sample(spark):
    rows = [(None, f"text number {i % 3} of the sample") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    a, b = crf.train(docs), crf.train(docs.dropDuplicates())
    assert (a.weights == b.weights).all()
    assert crf.scan(docs, a).filter(F.col("spans") != "").count() == 0
