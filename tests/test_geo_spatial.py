import math
import random

import pytest
from pyspark.sql import functions as F

from parcelspark.functions import geo
from parcelspark.operators.covers import area_line_pairs, area_point_pairs, cover
from parcelspark.operators.spatial import nearest_line, point_pairs
from parcelspark.operators.skew import grouped_median, salted_join


def metres(lon1, lat1, lon2, lat2):
    m = math.radians((lat1 + lat2) / 2)
    w = 1 - geo.ECCENTRICITY_SQ * math.sin(m) ** 2
    n = geo.SEMI_MAJOR_M / math.sqrt(w)
    dx = (lon2 - lon1) * math.radians(1) * n * math.cos(m)
    dy = (lat2 - lat1) * math.radians(1) * n * (1 - geo.ECCENTRICITY_SQ) / w
    return math.hypot(dx, dy)


def scatter(n, seed, lon=(126.8, 127.0), lat=(37.4, 37.6)):
    r = random.Random(seed)
    return [(i, r.uniform(*lon), r.uniform(*lat)) for i in range(n)]


def test_two_centroids_are_8732_m_apart(spark):
    d = geo.distance_m(F.lit(126.6534), F.lit(37.6517), F.lit(126.7341), F.lit(37.6062))
    assert spark.range(1).select(d).first()[0] == pytest.approx(8732.07, abs=0.05)


def test_haversine_has_three_digits(spark):
    got = spark.range(1).select(geo.haversine_km(F.lit(126.0), F.lit(37.0), F.lit(126.0), F.lit(38.0))).first()[0]
    assert got == 111.195


@pytest.mark.parametrize("hot_rows", [1_000_000, 20])
def test_point_pairs_match_brute_force_also_when_salted(spark, hot_rows):
    queries, points = scatter(60, 1), scatter(300, 2) + [(1000 + i, 126.9, 37.5) for i in range(100)]
    q = spark.createDataFrame(queries, "q long, q_lon double, q_lat double")
    p = spark.createDataFrame(points, "p long, lon double, lat double")
    got = {(r.q, r.p): r.distance_m for r in point_pairs(q, p, 2500.0, hot_rows).collect()}
    want = {(a[0], b[0]): metres(a[1], a[2], b[1], b[2]) for a in queries for b in points}
    want = {k: d for k, d in want.items() if d <= 2500.0}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_pairs_are_found_at_any_latitude(spark):
    for lat in (-71.0, 45.0, 60.0, 80.0):
        q, p = scatter(30, 3, lat=(lat, lat + 0.1)), scatter(90, 4, lat=(lat, lat + 0.1))
        got = {(r.q, r.p) for r in point_pairs(
            spark.createDataFrame(q, "q long, q_lon double, q_lat double"),
            spark.createDataFrame(p, "p long, lon double, lat double"), 4000.0).collect()}
        assert got == {(a[0], b[0]) for a in q for b in p if metres(a[1], a[2], b[1], b[2]) <= 4000.0}
        shape = [{"lon": x, "lat": y} for x, y in ring(126.9, lat + 0.05, 0.001)]
        areas = spark.createDataFrame([(1, shape)], "a long, polygon array<struct<lon:double,lat:double>>")
        east = 126.901 + 4900 / metres(126.9, lat + 0.05, 127.9, lat + 0.05)
        near = spark.createDataFrame([(1, east, lat + 0.05)], "p long, lon double, lat double")
        assert area_point_pairs(areas, near, 5000.0, "p").count() == 1
        line = [{"lon": east, "lat": lat + 0.0495}, {"lon": east, "lat": lat + 0.0505}]
        lines = spark.createDataFrame([(7, line)], "l long, line array<struct<lon:double,lat:double>>")
        assert area_line_pairs(areas, lines, 5000.0, "a", "l").count() == 1


def test_nearest_line_has_no_bound_of_distance(spark):
    points = spark.createDataFrame([(1, 126.9, 37.5), (2, -70.0, -30.0)], "p long, lon double, lat double")
    line = [{"lon": 127.0, "lat": 37.5}, {"lon": 127.1, "lat": 37.5}]
    lines = spark.createDataFrame([(7, line)], "l long, line array<struct<lon:double,lat:double>>")
    assert {(r.p, r.l) for r in nearest_line(points, lines, "p", "l").collect()} == {(1, 7), (2, 7)}


def ring(lon, lat, half):
    return [(lon + half * a, lat + half * b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def test_area_distance_inside_edge_corner_and_far(spark):
    areas = spark.createDataFrame([(1, ring(126.9, 37.5, 0.01))], "a long, polygon array<struct<lon:double,lat:double>>")
    spots = [("in", 126.9, 37.5), ("east", 126.92, 37.5), ("corner", 126.915, 37.515), ("far", 127.2, 37.5)]
    points = spark.createDataFrame(spots, "p string, lon double, lat double")
    got = {r.p: r.distance_m for r in area_point_pairs(areas, points, 3000.0, "p").collect()}
    assert got["in"] == 0.0
    assert got["east"] == pytest.approx(metres(126.92, 37.5, 126.91, 37.5), abs=1e-3)
    assert got["corner"] == pytest.approx(metres(126.915, 37.515, 126.91, 37.51), abs=1e-3)
    assert "far" not in got


def test_area_line_crossing_touching_and_near(spark):
    areas = spark.createDataFrame([(1, ring(126.9, 37.5, 0.01))], "a long, polygon array<struct<lon:double,lat:double>>")
    lines = spark.createDataFrame([
        ("through", [(126.8, 37.5), (127.0, 37.5)]), ("within", [(126.895, 37.5), (126.896, 37.501)]),
        ("near", [(126.92, 37.4), (126.92, 37.6)]), ("far", [(127.3, 37.4), (127.3, 37.6)])],
        "l string, line array<struct<lon:double,lat:double>>")
    got = {r.l: r.distance_m for r in area_line_pairs(areas, lines, 3000.0, "a", "l").collect()}
    assert got["through"] == 0.0 and got["within"] == 0.0 and "far" not in got
    assert got["near"] == pytest.approx(metres(126.92, 37.5, 126.91, 37.5), rel=1e-3)


def test_nearest_line_over_wide_gaps(spark):
    lines = [(i, [(x, y), (x + 0.01, y + 0.004)]) for i, x, y in scatter(15, 3, (126.5, 128.5), (36.0, 38.0))]
    points = scatter(120, 4, (126.0, 129.0), (35.5, 38.5))
    l = spark.createDataFrame(lines, "l long, line array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame(points, "p long, lon double, lat double")

    def planar(px, py, seg):
        (x1, y1), (x2, y2) = seg
        bx, by = x2 - x1, y2 - y1
        t = max(0.0, min(1.0, ((px - x1) * bx + (py - y1) * by) / (bx * bx + by * by)))
        return math.hypot(x1 + t * bx - px, y1 + t * by - py)

    got = {r.p: r.l for r in nearest_line(p, l, "p", "l").collect()}
    assert got == {i: min(lines, key=lambda s: (planar(x, y, s[1]), s[0]))[0] for i, x, y in points}


def test_nearest_line_without_lines_is_empty(spark):
    l = spark.createDataFrame([], "l long, line array<struct<lon:double,lat:double>>")
    p = spark.createDataFrame(scatter(3, 5), "p long, lon double, lat double")
    assert nearest_line(p, l, "p", "l").count() == 0


def test_salted_join_keeps_every_row(spark):
    big = spark.createDataFrame([(i, 1 if i % 3 else i % 7) for i in range(900)], "id long, k int")
    small = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "k int, v string")
    got = salted_join(big, small, ["k"], ["id"], hot_rows=50)
    assert sorted(r.id for r in got.collect()) == list(range(900))
    assert all(r.v == f"v{r.k}" for r in got.collect())


def test_grouped_median_equals_builtin(spark):
    r = random.Random(6)
    rows = [(g, r.gauss(0, 100) if g != 2 else 5.0) for g in range(4) for _ in range(101 + g)]
    df = spark.createDataFrame(rows + [(9, 1.0), (9, None)], "g int, v double")
    got = {x.g: x.median for x in grouped_median(df, ["g"], "v").collect()}
    want = {x.g: x.m for x in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


RING, RINGS = "array<struct<lon:double,lat:double>>", "array<array<struct<lon:double,lat:double>>>"


def wobbly(lon, lat, size, n, seed):
    """A ring of n points around a middle."""
    r = random.Random(seed)
    return [(lon + size * f * math.cos(2 * math.pi * i / n), lat + size * f * math.sin(2 * math.pi * i / n)) for i in range(n) for f in [r.uniform(0.5, 1.0)]]


def pieces_of(ring):
    return list(zip(ring, ring[1:] + ring[:1]))


def to_piece(x, y, a, b):
    k = math.cos(math.radians(y))
    bx, by = (b[0] - a[0]) * k, b[1] - a[1]
    t = max(0.0, min(1.0, ((x - a[0]) * k * bx + (y - a[1]) * by) / ((bx * bx + by * by) or 1.0)))
    return metres(x, y, a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))


def to_shape(x, y, rings):
    pieces = [p for ring in rings for p in pieces_of(ring)]
    odd = sum((a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0] for a, b in pieces) % 2
    return 0.0 if odd else min(to_piece(x, y, a, b) for a, b in pieces)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rings_and_holes_against_every_edge(spark, seed):
    shapes = {1: [wobbly(126.9, 37.5, 0.05, 90, seed), wobbly(126.9, 37.5, 0.02, 25, seed + 9), wobbly(127.03, 37.52, 0.01, 5, seed)],
              2: [ring(126.95, 37.45, 0.03), ring(126.95, 37.45, 0.015), ring(126.95, 37.45, 0.005)],
              3: [[(126.85, 37.44)]], 4: [[(126.8, 37.4), (127.0, 37.6)]]}
    areas = spark.createDataFrame(list(shapes.items()) + [(8, []), (9, None), (10, [[]])], f"a long, polygon {RINGS}").withColumn("corner", F.lit("x"))
    spots = scatter(700, seed, (126.78, 127.1), (37.38, 37.62)) + [(5000 + i, x, y) for i, (x, y) in enumerate(p for r in shapes[2] for p in r)]
    points = spark.createDataFrame(spots, "p long, lon double, lat double")
    got = {(r.a, r.p): r.distance_m for r in area_point_pairs(areas, points, 2000.0, "p").collect()}
    want = {(a, i): d for a, rings in shapes.items() for i, x, y in spots if (d := to_shape(x, y, rings)) <= 2000.0}
    on_border = {k for k in got.keys() | want.keys() if abs(max(got.get(k, 0), want.get(k, 0)) - 2000) < 0.01}
    assert got.keys() - on_border == want.keys() - on_border
    assert all(got[k] == pytest.approx(want[k], abs=0.05) for k in want.keys() - on_border)
    assert {k for k, d in got.items() if d == 0} == {k for k, d in want.items() if d < 1e-9}


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_and_rings_against_every_edge(spark, seed):
    shapes = {1: [wobbly(126.9, 37.5, 0.05, 60, seed), wobbly(126.9, 37.5, 0.02, 15, seed + 9)], 2: [ring(127.02, 37.45, 0.01)]}
    r = random.Random(seed)
    tracks = {i: [(x, y), (x + r.uniform(-0.03, 0.03), y + r.uniform(-0.03, 0.03)), (x + 0.04, y + r.uniform(-0.05, 0.05))] for i, x, y in scatter(120, seed, (126.8, 127.05), (37.4, 37.6))}
    tracks[500] = [(126.905, 37.5), (126.91, 37.503)]  # in the hole
    areas = spark.createDataFrame(list(shapes.items()), f"a long, polygon {RINGS}")
    lines = spark.createDataFrame(list(tracks.items()) + [(900, []), (901, None)], f"l long, line {RING}")
    got = {(x.a, x.l): x.distance_m for x in area_line_pairs(areas, lines, 1500.0, "a", "l").collect()}

    def turn(a, b, p):
        return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])

    def apart(rings, track):
        best = min(to_shape(x, y, rings) for x, y in track)
        for a, b in (p for one in rings for p in pieces_of(one)):
            for c, d in zip(track, track[1:]):
                if turn(a, b, c) * turn(a, b, d) < 0 and turn(c, d, a) * turn(c, d, b) < 0:
                    return 0.0
                best = min(best, to_piece(*a, c, d))
        return best

    want = {(a, i): d for a, rings in shapes.items() for i, track in tracks.items() if (d := apart(rings, track)) <= 1500.0}
    on_border = {k for k in got.keys() | want.keys() if abs(max(got.get(k, 0), want.get(k, 0)) - 1500) < 0.01}
    assert got.keys() - on_border == want.keys() - on_border
    assert all(got[k] == pytest.approx(want[k], abs=0.05) for k in want.keys() - on_border)
    assert 0 < sum(d == 0 for d in got.values()) < len(got) and got.get((1, 500), 1e9) > 0


def test_edges_tested_do_not_grow_with_the_ring(spark):
    """A cell lists the edges near to it, whatever the number of edges of the ring."""
    longest = {}
    for n in (200, 3200):  # the same coast line, sixteen times as long
        row = [(126.0 + 0.01 * i, 37.0 + 0.003 * (i % 2)) for i in range(n // 2)]
        shape = row + [(x, y - 0.2) for x, y in reversed(row)]
        areas = spark.createDataFrame([(1, [shape])], f"a long, polygon {RINGS}")
        cells = cover(areas, "a", "polygon", 5000.0)
        longest[n] = cells.agg(F.max(F.size("_edges"))).first()[0]
        assert {r._kind for r in cells.select("_kind").distinct().collect()} == {"inside", "crossed", "outside"}
    assert longest[3200] <= longest[200] + 1
