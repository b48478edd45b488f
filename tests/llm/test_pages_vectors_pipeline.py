"""Page extraction, vector search and the pipeline."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelspark.llm import html_trees
from parcelspark.llm.topk import quantised, top_products


@pytest.fixture(scope="module")
def model(spark):
    return html_trees.train(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))


def test_main_text(spark, model):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for row in html_trees.extract(pages, model).collect():
        article = re.search(r"<article>(.*?)</article>", row.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", part)).split()) for part in re.split(r"</?(?:p|h1)>", article))
        assert row.text == "\n".join(filter(None, blocks)) and row.n_chars == len(row.text)


def test_other_layouts(model):
    page = """<body><div id="header"><a href="/">Site</a></div><div class="sidebar"><p>Popular posts are here for you to read.</p></div>
      <div class="post-content"><h1>Title here</h1><p>The first paragraph of the story, with text.</p><p>And a second &amp; last&nbsp;one.</p></div>
      <div id="comments"><p>I liked this story, thanks a lot for it.</p></div><form><p>Search it</p></form><div class="footer">All rights.</div>"""
    nodes, blocks = html_trees.parse(page)
    keep = html_trees.decode(nodes, model.log_odds(html_trees.features(nodes, blocks)))
    assert [text for at, text, _ in blocks if keep[at]] == ["Title here", "The first paragraph of the story, with text.", "And a second & last one."]


def test_decoding_is_the_best_closed_set():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 9
        nodes = [html_trees.Node("div", -1 if k == 0 else int(rng.integers(0, k)), 0, 0, 0, 0, 0) for k in range(n)]
        odds = rng.normal(size=n)
        keep = html_trees.decode(nodes, odds)
        closed = lambda s: all(k == 0 or not s >> k & 1 or s >> nodes[k].parent & 1 for k in range(n))  # noqa: E731,B023
        best = max(sum(odds[k] for k in range(n) if s >> k & 1) for s in range(1 << n) if closed(s))
        assert np.isclose(odds[keep].sum(), best)


def test_odd_pages(spark, model):
    pages = spark.createDataFrame([(1, None), (2, ""), (3, "<p"), (4, "<script>x</p>"), (5, "<div>" * 500 + "x"), (5, "<li><li></ul></b>a<td>b")], "page_id long, html string").withColumn("text", F.lit("mine"))
    rows = html_trees.extract(pages, model).collect()
    assert len(rows) == 6 and all(r.text == "" for r in rows if r.page_id in (1, 2, 4))
    empty = html_trees.train(pages.limit(0))
    assert {r.text for r in html_trees.extract(pages, empty).collect()} == {""} and html_trees.extract(pages.limit(0), empty).count() == 0


def brute_top(rows, every, k):
    out = []
    for q, v in {q: v for q, v in rows if q % every == 0}.items():
        best = sorted((-int(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6, 1e8])
def test_top_products(spark, scale):
    rng = np.random.default_rng(4)
    values = [(k, [float(x) for x in rng.normal(size=6) * scale]) for k in range(400)]
    values[20:60] = [(k, values[20][1]) for k in range(20, 60)]  # ties
    bad = [(1000, None), (1050, []), (1100, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (1150, [float("inf")] * 6), (None, [1.0] * 6), (1200, [1.0, None, 0.0, 0.0, 0.0, 0.0])]
    frame = spark.createDataFrame([*values, *bad, values[3]], "vec_id long, v array<double>")
    vectors = quantised(frame, "vec_id", "v")
    rows = [(k, np.floor(256 * np.array(v)).astype(np.int64)) for k, v in values]
    got = top_products(vectors, vectors.filter("id % 50 = 0"), 5, shard_rows=30, tile_rows=3).collect()
    assert sorted(map(tuple, got)) == brute_top(rows, 50, 5)
    few = vectors.filter("id < 3")
    assert sorted(map(tuple, top_products(few, few.filter("id = 0"), 5).collect())) == brute_top(rows[:3], 50, 5)
    assert top_products(few.limit(0), few.limit(0), 5).count() == 0


def test_pipeline(spark, odd):
    docs = spark.createDataFrame([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()], "doc_id long, text string")
    docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})
    docs = docs.unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("doc_id", F.col("doc_id") + 100000))
    sf, seen = "/root/testdata/sf0.001", {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.materialise(stage(spark, docs, sf), f"test-{name}")
        seen[name] = docs.count()
        if name != "encode_bpe":
            assert docs.columns == before.columns
        if name == "language_id":
            assert docs.filter("doc_id in (1, 2, 3, 4) and text rlike '^[^a-zA-Z]*$'").count() == 0
        if name == "near_dedup":
            assert docs.filter("text = 'one two three four five six seven'").count() == 1
        if name == "redact_secrets":
            assert docs.filter("text rlike 'AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}'").count() == 0
    assert seen["encode_bpe"] == seen["redact_secrets"] > 100
    assert corpus_pipeline.run(spark, sf).columns == docs.columns
