"""Heap-merged token counts, importance resampling and exact clustering against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from parcelspark.llm import centroids, heap_counts, queries, resample

JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def some_texts():
    draw = random.Random(11)
    parts = ["a", "'", "s", "'re", "'ll", " ", "  ", "\n", "\t", "12", "é", "日", "!", "--", "\xa0", "\x1c", "²", "th", "er", "😀", "=", "_", "<|endoftext|>", "<|endoftext", "\x85", "the", "in"]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    return [*texts, "", None, "a" * 20000, "ab" * 2000, " " * 500, "0123456789" * 300, "\U0010ffff x \U0010ffff", "<|endoftext|>" * 3, "\U0010ffff<|endoftext|>it's"]


def test_counts_equal_the_library(tokenizer):
    texts = some_texts()
    got = heap_counts.counter(JSON, PATTERN).count(texts)
    assert got.tolist() == [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_store_of_counts_begins_anew(tokenizer):
    own = heap_counts.TextCounter(heap_counts.MergeRules(JSON), PATTERN, most=5)
    for text in ("one two three four five six", "seven eight", "one two", "nine"):
        assert own.count([text]).tolist() == [len(tokenizer.encode(text).ids)]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        heap_counts.MergeRules(public_tokenizers.path("word_bpe_49k.json"))


def test_count_tokens(spark, odd, tokenizer):
    odd = odd.withColumn("n_tokens", F.lit("x"))
    rows = heap_counts.count_tokens(odd, JSON, PATTERN, limit=7).collect()
    wanted = [(r.doc_id, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "").ids), n > 7) for r in odd.collect()]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, wanted))
    assert heap_counts.count_tokens(odd.limit(0), JSON, PATTERN).count() == 0


def test_op11_query(spark, documents, tokenizer):
    rows = {r.doc_id: r for r in queries.op11_heap_counts(spark, SF).collect()}
    for r in documents.collect():
        n = len(tokenizer.encode(r.text or "", add_special_tokens=False).ids)
        assert tuple(rows[r.doc_id]) == (r.doc_id, len((r.text or "").encode()), n, n > 1024)


# resampling


def drawn_by_hand(docs, target, percent=25, least=20, buckets=10_000, seed=7):
    def parts(text):
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
        return len(words), [zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = Counter(), Counter()
    read = [(i, *parts(text)) for i, text in docs]
    for _, _, found in read:
        s.update(found)
    for text in target:
        t.update(parts(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in range(buckets)]
    out, able = [], []
    for i, n, found in read:
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        row = [i, len(found), weight, score, None]
        out.append(row)
        if n >= least:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted(map(str, map(tuple, out)))


def same(frame):
    return sorted(str(tuple(r)) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect())


def test_op12_query_equals_brute_force(spark, documents):
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert same(queries.op12_resample(spark, SF)) == drawn_by_hand([(r.doc_id, r.text) for r in documents.collect()], target)


@pytest.mark.parametrize("percent", [0, 1, 30, 50, 99, 100])
def test_resample_with_ties_repeats_and_null_ids(spark, percent):
    text = "one two three Four five"
    docs = [(None, text)] * 9 + [(4, text)] * 7 + [(i, f"{text} {'x' * (i % 3)}") for i in range(-20, 20)] + [(50, None), (51, ""), (52, "... !!"), (53, "word " * 40000)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for name in ("score", "rank", "part", "piece", "eligible"):
        frame = frame.withColumn(name, F.lit("x"))
    target = spark.createDataFrame([("four five six",), (None,)], "text string")
    got = resample.resample(frame, target, percent=percent, least_words=3, buckets=50)
    assert same(got) == drawn_by_hand(docs, ["four five six", None], percent, 3, 50)


def test_resample_cut_inside_equal_scores(spark):
    """All scores equal: the cutoff is decided by the id alone."""
    rows = spark.createDataFrame([(i, 1, True, 0, 5, (i or 0) % 3) for i in (9, -4, 7, 2, 2, 2, 30, None, None)], "doc_id long, n_features long, eligible boolean, weight long, score long, part int")
    for wanted in range(1, 10):
        kept = rows.filter(resample.cutoff(rows, wanted))
        ranks = sorted((r["rank"], r.doc_id) for r in resample.ranked(kept).collect())
        assert [i for n, i in ranks if n <= wanted] == [-4, 2, 2, 2, 7, 9, 30, None, None][:wanted]


def test_resample_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert resample.resample(docs.limit(0), docs.limit(0)).count() == 0
    assert same(resample.resample(docs, docs.limit(0), 100, 1)) == drawn_by_hand([(1, "a b c")], [], 100, 1)


# clustering


def clusters_by_hand(rows, clusters=8, rounds=10, width=64, scale=1024, seed=3):
    kept = []
    for i, vector in rows:
        if vector is not None and len(vector) == width and all(x is not None and math.isfinite(x) for x in vector):
            kept.append((i, [math.floor(scale * x) for x in vector]))
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    middles = [q for _, q in start[:clusters]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), k) for k, c in enumerate(middles))

    for _ in range(rounds):
        own = [nearest(q)[1] for _, q in kept]
        for k in range(len(middles)):
            mine = [q for (_, q), o in zip(kept, own) if o == k]
            if mine:
                middles[k] = [sum(column) // len(mine) for column in zip(*mine)]
    ends = [nearest(q) for _, q in kept]
    inertia = Counter()
    for d, k in ends:
        inertia[k] += d
    text = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middles]
    return sorted(str((i, k, d, inertia[k], sum(inertia.values()), text[k])) for (i, _), (d, k) in zip(kept, ends))


def plain(frame):
    return sorted(str(tuple(r)) for r in frame.collect())


def test_clusters_equal_brute_force_and_sql(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = plain(queries.op13_centroids(spark, SF))
    assert got == clusters_by_hand(rows)
    base = duckdb.connect()
    base.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    assert got == sorted(map(str, base.sql(queries.ORACLES["op13_centroids"]).fetchall()))


def test_clusters_of_odd_vectors(spark):
    draw = random.Random(2)
    rows = [(i, [draw.uniform(-2, 2) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (100, None), (101, [1.0, 2.0, 3.0]), (102, [1.0, None, 0.0, 0.0]),
             (103, [float("nan"), 0.0, 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0, 0.0]), (105, [1.0] * 5), (106, []), (107, [1000.0, -1000.0, 5.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cluster", F.lit("x")).withColumn("x", F.lit("x")).repartition(4)
    for clusters, rounds in ((1, 3), (3, 0), (5, 10), (100, 4)):
        assert plain(centroids.cluster(frame, clusters, rounds, width=4)) == clusters_by_hand(rows, clusters, rounds, width=4)
    same_point = frame.withColumn("embedding", F.array(*[F.lit(0.5)] * 4))
    assert {(r.cluster, r.distance) for r in centroids.cluster(same_point, 3, 5, width=4).collect()} == {(0, 0)}
    assert centroids.cluster(frame.limit(0), width=4).count() == 0 and centroids.cluster(frame, width=9).count() == 0


def test_large_components(spark):
    rows = [(i, [(-1.0) ** i * 100000.0 + i, 0.25 * i]) for i in range(12)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert plain(centroids.cluster(frame, 3, 6, width=2)) == clusters_by_hand(rows, 3, 6, width=2)
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>"), 3, 6, width=2)
