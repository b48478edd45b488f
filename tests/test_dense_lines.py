"""Nearest lines where lines lie far denser than the base grid."""

import math

from pyspark.sql import functions as F

from parcelspark.functions import geo
from parcelspark.operators import spatial


def _lines(spark, n):
    """Slanting lines of three pieces over 0.02 degrees, one of them long, and a single vertex."""
    rows = []
    for i in range(n):
        x, y = 127.0 + 0.02 * (i * 37 % n) / n, 37.5 + 0.02 * (i * 61 % n) / n
        step = 0.05 if i == 7 else 0.0004
        rows.append((i, [(x, y), (x + step, y + step * (i % 5 - 2)), (x + step, y + 3 * step), (x, y + 2 * step)]))
    rows.append((n, [(127.01, 37.51)]))
    return spark.createDataFrame(rows, "line_id long, line array<struct<lon:double,lat:double>>")


def _points(spark):
    rows = [(f"p{i}", 126.99 + 0.04 * (i * 29 % 211) / 211, 37.49 + 0.04 * (i * 83 % 211) / 211) for i in range(211)]
    return spark.createDataFrame(rows + [("far", 120.0, 30.0), ("none", None, 37.5)], "id string, lon double, lat double")


def _edges(lines):
    return lines.select("line_id", F.explode(geo.edges_of(F.col("line"), closed=False)).alias("edge"))


def test_dense_lines_get_a_finer_grid_and_few_candidates(spark):
    lines = _lines(spark, 600)
    edges = _edges(lines)
    finest = spatial._finest_level(edges)
    assert finest < 0
    # a point of the finest level meets only a part of what lies in a cell of the base grid
    cells = spatial._edge_cells(edges.withColumn("level", F.explode(F.array(F.lit(finest + 1), F.lit(1)))))
    most = {r["level"]: r["n"] for r in cells.groupBy("level", *spatial.CELL).count().groupBy("level").agg(F.avg("count").alias("n")).collect()}
    assert most[finest + 1] * 4 < most[1]
    assert spatial._finest_level(edges.limit(0)) == 0


def test_dense_lines_equal_brute_force(spark):
    lines, points = _lines(spark, 600), _points(spark)
    brute = geo.with_edge_distance(
        points.filter("lon is not null").crossJoin(_edges(lines)), "lon", "lat", "edge", "metres", "degrees").cache()
    for metric, by in (("degree", "degrees"), ("metre", "metres")):
        want = {r["id"]: r["hit"] for r in brute.groupBy("id").agg(F.min(F.struct(by, "line_id", "metres")).alias("hit")).collect()}
        got = {r["id"]: r for r in spatial.nearest_line(points, lines, "id", "line_id", metric=metric).collect()}
        assert set(got) == set(want)
        for key, hit in want.items():
            assert got[key]["line_id"] == hit["line_id"], (metric, key)
            assert math.isclose(got[key]["distance_m"], hit["metres"], rel_tol=1e-12)
