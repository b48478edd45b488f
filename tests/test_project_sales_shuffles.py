"""Sales near projects: points are shuffled once, pairs and rows of a median not at all."""

import re

from pyspark.sql import functions as F

from parcelspark.operators.covers import area_point_pairs
from parcelspark.operators.skew import grouped_median
from parcelspark.plans import impact


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def corners(lon, lat, half):
    return [(lon + half * a, lat + half * b) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1))]


def test_pairs_are_folded_where_the_points_lie(spark):
    areas = spark.createDataFrame([(1, corners(126.9, 37.5, 0.01)), (2, corners(126.92, 37.5, 0.01))], "a long, polygon array<struct<lon:double,lat:double>>")
    rows = [(f"s{i}", i % 3, 126.85 + 0.0021 * (i % 50), 37.45 + 0.0013 * (i % 77)) for i in range(300)]
    points = spark.createDataFrame(rows + rows[:20], "p string, v long, lon double, lat double")
    pairs = area_point_pairs(areas, points, 3000.0, "p")
    text = plan(pairs)
    assert not re.search(r"hashpartitioning\([^)]*\bp#", text) and "SortAggregate" not in text
    assert pairs.columns == ["a", "p", "v", "distance_m"]
    # a repeated point gives a pair once
    assert pairs.count() == pairs.select("a", "p").distinct().count() > 300


def test_rows_of_a_median_are_shuffled_within_the_middle_slice_only(spark):
    rows = spark.range(5000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 5003).cast("double").alias("v"))
    found = grouped_median(rows, ["g"], "v")
    assert not re.search(r"hashpartitioning\(g#\d+L?, _v#", plan(found))
    assert {r.g: r.median for r in found.collect()} == {r.g: r.m for r in rows.groupBy("g").agg(F.median("v").alias("m")).collect()}


def test_samples_without_ids_are_the_same_samples(spark, tables):
    arguments = tables.projects, tables.project_stages, tables.land_transactions
    full, slim = impact.uplift_samples(*arguments), impact.uplift_samples(*arguments, with_ids=False)
    assert "source_id" not in slim.columns
    assert sorted(map(tuple, full.drop("source_id").collect())) == sorted(map(tuple, slim.collect()))
