"""Exact vector search: every unit is met once, whatever the size of a product."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

from parcelspark.operators import nearest


def _vectors(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 4)) if kind == "even" else np.concatenate([rng.normal(size=(1400, 4)) * 0.01 + 1, np.zeros((2, 4)), rng.normal(size=(98, 4))])
    x[5], x[6] = x[7], x[7] * 2
    return x, spark.createDataFrame([(f"v{i:04d}", v.tolist()) for i, v in enumerate(x)], "i string, v array<double>")


def _found(df, k, pivots, block):
    rows = nearest.topk_cosine(df, df.withColumnRenamed("i", "j"), "i", "j", "v", k, True, pivots, block).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.i, r.rank)):
        got.setdefault(r.i, []).append(r.j)
    return got


@pytest.mark.parametrize("kind,pivots,unit_bytes", [("even", 5, 32 << 20), ("lumps", 7, 4000), ("lumps", 1, 8000)])
def test_units_of_any_size_give_exact_hits(spark, monkeypatch, kind, pivots, unit_bytes):
    monkeypatch.setattr(nearest, "UNIT_BYTES", unit_bytes)
    x, df = _vectors(spark, kind)
    size = np.linalg.norm(x, axis=1)[:, None]
    u = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
    scores = np.round(u @ u.T, 9)
    np.fill_diagonal(scores, -2)
    names = np.array([f"v{i:04d}" for i in range(len(x))])
    want = {names[i]: names[np.lexsort((names, -scores[i]))[:4]].tolist() for i in range(len(x))}
    assert _found(df, 4, pivots, 64) == want


def test_queries_go_once_to_a_unit(spark, monkeypatch):
    """Rows that meet do not grow with the number of products."""
    met = []
    cogroup = PandasGroupedOpsMixin.cogroup
    monkeypatch.setattr(PandasGroupedOpsMixin, "cogroup", lambda a, b: met.append(a._df.count() + b._df.count()) or cogroup(a, b))
    x, df = _vectors(spark, "even")
    nearest.topk_cosine(df, df.withColumnRenamed("i", "j"), "i", "j", "v", 4, True, 4, 16)
    assert sum(met) < 20 * len(x)


def test_a_vector_that_is_not_a_number_hides_no_other(spark):
    rows = [(i, [1.0, i / 50.0]) for i in range(100)] + [(100, [float("nan"), 1.0])]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    got = {r.i: r.j for r in nearest.topk_cosine(df, df.withColumnRenamed("i", "j"), "i", "j", "v", 1, True, 3, 16).collect()}
    assert len(got) == 100 and all(abs(i - j) == 1 for i, j in got.items())


def test_a_norm_is_summed_once_a_vector(spark):
    """The sum stands in no lambda over components, and null, zero and ordinary vectors keep their values."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,), ([1.0, None],)], "v array<double>")
    got = df.select(nearest.unit(F.col("v")).alias("u"))
    assert [r.u for r in got.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None, [0.0, 0.0]]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "/ sqrt(" not in plan.lower()
