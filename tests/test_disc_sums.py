"""Sums within circles without pairs, against the pairs themselves."""

import datetime as dt
import random

from pyspark.sql import functions as F

from parcelspark.operators import discs
from parcelspark.operators.spatial import point_pairs
from parcelspark.plans import features


def _sides(spark):
    r = random.Random(11)
    points, queries = [], []
    for middle, spread, n in (((127.0, 37.5), 0.04, 1500), ((10.0, 0.0), 0.02, 300), ((20.0, 69.5), 0.1, 300), ((-50.0, -33.0), 0.001, 200)):
        at = lambda: (middle[0] + r.uniform(-spread, spread), middle[1] + r.uniform(-spread, spread))
        points += [(*at(), r.choice(["a", "b", None]), r.randrange(1, 4)) for _ in range(n)]
        queries += [(f"q{r.randrange(400)}", *at(), r.choice(["a", "b", "c", None])) for _ in range(200)]
    queries += [(f"on{i}", *p[:2], p[2]) for i, p in enumerate(points[::50])] + [("none", None, 37.5, "a"), (None, 127.0, 37.5, "a")]
    return (spark.createDataFrame(queries, "id string, q_lon double, q_lat double, kind string"),
            spark.createDataFrame(points + [(127.0, 37.5, "a", 1)] * 50, "lon double, lat double, sort string, n long"))


def _sums(df, names):
    rows = df.groupBy("id", "kind").agg(*[F.sum(c).alias(c) for c in names]).collect()
    return {(x["id"], x["kind"]): tuple(x[c] for c in names) for x in rows}


def test_disc_sums_equal_pairs(spark, monkeypatch):
    queries, points = _sides(spark)
    monkeypatch.setattr(discs, "CHUNK", 64)
    pairs = point_pairs(queries, points, 3000.0).cache()
    inside = lambda m: F.when(F.col("distance_m") <= m, F.col("n")).otherwise(0)
    want = _sums(pairs.select("id", "kind", inside(3000).alias("wide"), inside(700).alias("near")), ["wide", "near"])
    assert _sums(discs.disc_sums(queries, points, {"wide": 3000.0, "near": 700.0}, "n"), ["wide", "near"]) == want
    want = _sums(pairs.filter(F.col("kind") == F.col("sort")).select("id", "kind", F.col("n").alias("wide")), ["wide"])
    assert _sums(discs.disc_sums(queries, points, {"wide": 3000.0}, "n", ("kind", "sort")), ["wide"]) == want


def test_only_entities_without_a_near_store_form_pairs(spark, monkeypatch):
    stores = spark.createDataFrame([(1, 127.0, 37.5, "a"), (2, 127.001, 37.5, "a"), (3, 127.025, 37.5, None)], "id long, lon double, lat double, brand string")
    rows = [("store:1", None, 127.0, 37.5, None, dt.date(2000, 1, 1), 1, "a", 1.0, 1.0), ("parcel:x", None, 127.0, 37.505, None, dt.date(2000, 1, 1), None, None, 1.0, 1.0),
            ("parcel:y", None, 127.0, 37.52, None, dt.date(2000, 1, 1), None, None, 1.0, 1.0), ("parcel:z", None, 128.0, 37.5, None, dt.date(2000, 1, 1), None, None, 1.0, 1.0)]
    entities = spark.createDataFrame(rows, "entity_id string, pnu string, lon double, lat double, region_code string, snapshot_date date, owner_store_id long, brand string, land_area_m2 double, building_area_m2 double")
    asked = []
    monkeypatch.setattr(features, "point_pairs", lambda q, p, m: asked.extend(r["entity_id"] for r in q.collect()) or point_pairs(q, p, m))
    got = {r["entity_id"]: tuple(r)[1:] for r in features.competitor_counts(entities, stores).collect()}
    assert got == {"store:1": (1.0, 1.0, 1.0), "parcel:x": (2.0, 0.0, 0.0), "parcel:y": (0.0, 0.0, 0.0)}
    assert sorted(asked) == ["parcel:y", "parcel:z"]
