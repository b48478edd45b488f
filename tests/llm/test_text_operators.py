"""Scores, duplicates, secrets, leaks and the classifiers against brute force or held-out rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelspark.llm import bloom_lm, crf_secrets, langid, minhash_forest, templates, toxicity
from parcelspark.llm.graph import components
from parcelspark.llm.textblocks import remainder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORDS.findall((text or "").translate(LOWER))


def lm_rows(rows):
    tokens = [([*words(t), None], learn) for t, learn in rows]
    counts = collections.Counter(w for own, learn in tokens if learn for w in own)
    n, v = sum(counts.values()), len(counts)
    return sorted((len(own), sum(counts[w] > 0 for w in own), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own), 4)) for own, _ in tokens)


def test_base_scores_are_exact(documents, odd, monkeypatch):
    monkeypatch.setattr(bloom_lm, "BUCKET_WORDS", 500)
    monkeypatch.setattr(bloom_lm, "SEGMENT_GRAMS", 3000)
    for frame in (documents, odd):
        rows = frame.select("doc_id", "text", (remainder(F.col("doc_id"), 7) != 2).alias("learn"))
        got = bloom_lm.score(rows, most_bytes=6000).collect()  # several rounds of segments
        assert sorted((r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == lm_rows([(r.text, r.learn) for r in rows.collect()])
        assert all(math.isfinite(r.score) for r in got)
    whole = {r.doc_id: r.score for r in bloom_lm.score(rows).collect() if r.doc_id != 5}
    assert whole == {r.doc_id: r.score for r in got if r.doc_id != 5}
    held = bloom_lm.score(documents.select("doc_id", "text", (remainder(F.col("doc_id"), 7) != 2).alias("learn"))).filter("not learn").agg(F.sum("score"), F.sum("base_score")).first()
    assert held[0] > held[1]
    assert bloom_lm.score(rows.limit(0)).count() == 0
    assert {r.base_score for r in bloom_lm.score(rows.withColumn("learn", F.lit(False))).collect()} == {0.0}


def test_filter_has_all_levels():
    rng = np.random.default_rng(0)
    grams = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    size, levels = 8 * 3 * 3000, rng.integers(1, 5, 3000)
    bits = np.zeros(size, np.uint8)
    for depth in range(1, 5):
        for probe in range(bloom_lm.PROBES):
            bits[bloom_lm._items((grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)[levels >= depth], depth, probe, size)] = 1
    found = bloom_lm.gram_levels(grams, {0: (size, np.packbits(bits))}, 1)
    assert (found >= levels).all() and (found == levels).mean() > 0.9
    unseen = bloom_lm.gram_levels(rng.integers(0, 1 << 63, 3000, dtype=np.uint64), {0: (size, np.packbits(bits))}, 1)
    assert (unseen > 0).mean() < 0.1


def brute_components(rows, width, percent):
    sets = []
    for _, text in rows:
        own = words(text)
        n = min(width, len(own))
        sets.append({tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set())
    root = list(range(len(rows)))

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), doc_id), doc_id)
    return sorted((doc_id, len(sets[k]), least[find(k)]) for k, (doc_id, _) in enumerate(rows))


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_brute_force(spark, documents, odd, width, percent):
    base = ("the quick brown fox jumps over a lazy dog while nine wise men read very old books in the quiet hall of the town " * 3).split()
    copies = [(1000 + k, " ".join(base[:k % 60] + [f"new{k}"] + base[k % 60 :])) for k in range(150)]  # more than a leaf holds
    rows = [(r.doc_id, r.text) for r in documents.collect()] + copies
    got = minhash_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_duplicates_of_odd_rows(odd):
    got = minhash_forest.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    assert {r.component_id for r in got if r.doc_id in (5, 6)} == {5}
    assert all(r.n_shingles == 0 and r.component_id == r.doc_id for r in got if r.doc_id in (1, 2, 3))
    assert minhash_forest.near_duplicates(odd.limit(0)).count() == 0


def test_graph(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)}


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(0)
    moves = rng.normal(size=(3, 3)) + crf_secrets.FORBIDDEN
    counts = np.array([1, 5, 0, 256, 257, 700, 3, 513])
    emit = rng.normal(size=(counts.sum(), 3)) * 2
    tags, at = crf_secrets.viterbi(emit, counts, moves), 0
    for n in counts[counts > 0]:
        best, back = moves[2] + emit[at], []
        for t in range(1, n):
            every = best[:, None] + moves
            back.append(every.argmax(0))
            best = every.max(0) + emit[at + t]
        path = [int(best.argmax())]
        for step in back[::-1]:
            path.append(int(step[path[-1]]))
        assert tags[at : at + n].tolist() == path[::-1]
        at += n


def base_matches(text):
    out = [("assign", m) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
    out += [("access", m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    order = {"assign": 0, "access": 1, "hex": 2}
    return [f"{kind}:{m.start()}:{m.end()}" for kind, m in sorted(out, key=lambda x: (x[1].start(), order[x[0]]))]


def test_base_spans(documents):
    texts = [r.text or "" for r in documents.collect()]
    texts += ["Token=abc", "secret: token: abcdefg", "API_KEY = 'x1y2z3a4'", "AKIA" + "A" * 15, "AKIAKIA" + "B" * 20, "f" * 23 + " " + "0" * 30, "paſſword=abcdefgh", "token=token=abcdef"]
    for text in texts:
        assert crf_secrets.joined(crf_secrets.base_spans(text)) == ",".join(base_matches(text))


def test_scan(spark, documents, odd):
    model = crf_secrets.train(documents)
    for frame in (documents, odd):
        for row in crf_secrets.scan(frame, model).collect():
            want = base_matches(row.text or "")
            assert row.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert set(want) <= set(row.spans.split(","))
            assert (row.redacted == row.text) == (row.spans == "")
    assert crf_secrets.scan(odd.limit(0), crf_secrets.train(odd.limit(0))).count() == 0
    assert crf_secrets.redact("ab token=abcdef12 cd", [(3, 17, 0), (9, 17, 3)]) == "ab [SECRET] cd"


def test_field_learns_shapes():
    draw = np.random.default_rng(3)
    features, tags = np.zeros((300, 12, 7), np.int16), np.full((300, 12), crf_secrets.OUTSIDE)
    for k in range(300):
        parts = ["plain"] * 12
        at = int(draw.integers(2, 11))
        parts[at] = "".join(draw.choice(list("ABCDEFabcdef0123456789"), 30))
        features[k] = crf_secrets.tokens_of([" ".join(parts)]).features
        tags[k, at] = crf_secrets.BEGIN
    model = crf_secrets.fit(features, tags, np.ones((300, 12), bool))
    text = "some plain text with Ab3Cd9eF00aB12cD34eF56aB78cD90 inside of it"
    assert [text[a:b] for a, b, _ in crf_secrets.find_spans([text], model)[0]] == ["Ab3Cd9eF00aB12cD34eF56aB78cD90"]


def test_leaks(spark, documents, odd):
    item = "Once Alice had 5 apples and gave 3 apples to Bob before the long day ended quietly there."
    docs = spark.createDataFrame([
        (1, f"Foo bar. {item} Tail"), (2, item.replace("Alice", "Carol").replace("5", "71")), (3, "Once she had nothing to do with the day"), (4, None), (5, ""),
        (6, "Once Alice had 5 km and gave 3 apples to Bob before it rained"), (7, "short item here now yes"), (7, "short item here now yes")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, item), (3, None), (4, "short item here now yes"), (5, "x y")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.exact for r in templates.contaminated(docs, bench).collect()}
    assert got.keys() == {(1, 1), (2, 1), (7, 4)} and not got[2, 1]
    assert templates.contaminated(odd, bench).count() == 0
    assert templates.contaminated(docs.limit(0), bench).count() == templates.contaminated(docs, bench.limit(0)).count() == 0


def test_slots_must_agree(spark):
    bench = spark.createDataFrame([(1, "if Tom has seven sheep then Tom sells all sheep when old Tom moves away")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "if Ann has seven sheep then Ann sells all sheep when old Ann moves away"),
                                  (2, "if Ann has seven sheep then Bob sells all sheep when old Cid moves away")], "doc_id long, text string")
    assert [r.doc_id for r in templates.contaminated(docs, bench).collect()] == [1]


def test_leaks_equal_brute_force(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "benchmark"))
    plain = lambda text: " ".join(re.findall(r"[^\W_]+", (text or "").lower()))
    items = {r.item_id: f" {plain(r.text)} " for r in bench.collect()}
    want = {(r.doc_id, k) for r in docs.collect() for k, text in items.items() if text in f" {plain(r.text)} "}
    assert {(r.doc_id, r.item_id) for r in templates.contaminated(docs, bench).collect()} == want and want


def test_language(spark, documents, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(remainder(F.col("doc_id"), 3) != 1))
    held = langid.predict(docs.filter(remainder(F.col("doc_id"), 3) == 1), model).collect()
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    rows = langid.predict(odd, model).collect()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 3, 4)) and all(0 <= r.score <= 1 for r in rows)
    empty = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.predict(odd, empty).collect()} == {"und"}


def test_toxicity(spark, odd):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{name}.parquet") for name in ("documents", "labels"))
    model = toxicity.train(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    held = toxicity.score(docs, model).join(labels.filter(remainder(F.col("doc_id"), 5) == 0), "doc_id").collect()
    assert np.mean([r.toxic == r.predicted for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in toxicity.score(odd, model).collect())
    empty = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(odd.limit(0), empty).count() == 0 and len(empty.weights) == 0


def test_counterfactual_penalty():
    texts = ["muslims are idiot people", "muslims walk home", "christians walk home", "some idiot here", "nice day out", "jews bake bread"] * 20
    labels = np.array([1, 0, 0, 1, 0, 0] * 20)
    texts += ["muslims here"] * 15  # a biased sample
    labels = np.concatenate([labels, np.ones(15, int)])
    rows = [np.array(sorted(toxicity.features_of(t))) for t in texts]
    gap = lambda m: abs(dict(zip(m.places.tolist(), m.weights)).get(toxicity.features(b"muslims")[0], 0) - dict(zip(m.places.tolist(), m.weights)).get(toxicity.features(b"christians")[0], 0))
    assert gap(toxicity._fit(rows, labels, 1e-4, fairness=50.0)) < 0.3 * gap(toxicity._fit(rows, labels, 1e-4, fairness=0.0))


def test_remainder(spark):
    got = spark.createDataFrame([(k,) for k in range(50)], "doc_id long").withColumn("r", remainder(F.col("doc_id"), 7)).collect()
    assert all(r.r == zlib.crc32(str(r.doc_id).encode()) % 7 for r in got)
