"""Pieces of the adaptive grid stay bounded on both sides, sales sums of regions, lookups of hot projects."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from parcelspark.operators.skew import salted_join
from parcelspark.operators.spatial import PIECE, point_pairs, routed_sides
from parcelspark.plans import halo, impact


def frames(spark, queries, points):
    return (spark.createDataFrame(queries, "q long, q_lon double, q_lat double"), spark.createDataFrame(points, "p long, lon double, lat double"))


@pytest.mark.parametrize("crowd", ["points", "queries", "both"])
def test_a_crowded_cell_is_cut_on_the_crowded_side(spark, crowd):
    r = random.Random(5)
    spread = lambda n, first: [(first + i, r.uniform(126.0, 128.0), r.uniform(36.0, 38.0)) for i in range(n)]
    spot = lambda n: [(10_000 + i, 127.0, 37.0) for i in range(n)]
    q, p = frames(spark, spread(200, 0) + spot(3000 if crowd != "points" else 5), spread(200, 0) + spot(3000 if crowd != "queries" else 5))
    held, sent = routed_sides(q, p, 1000.0, 100)
    for side in (held, sent):
        sizes = [x["count"] for x in side.groupBy(*PIECE).count().collect()]
        assert max(sizes) < 200
    if crowd != "points":
        assert held.select(*PIECE).distinct().count() >= 30
    assert point_pairs(q, p, 1000.0, 100).filter("q >= 10000 and p >= 10000").count() == q.filter("q >= 10000").count() * p.filter("p >= 10000").count()


def test_scattered_queries_visit_few_cells(spark):
    r = random.Random(6)
    q, p = frames(spark, *[[(i, r.uniform(126.0, 127.0), r.uniform(37.0, 38.0)) for i in range(2000)] for _ in range(2)])
    held, sent = routed_sides(q, p, 1000.0)
    assert sent.count() < 2 * 2000 and held.count() <= 2000


def test_empty_sides_give_no_pair(spark):
    q, p = frames(spark, [(1, 127.0, 37.0), (2, None, 37.0)], [(1, 127.0, 37.0), (2, 127.0, None)])
    assert [(x.q, x.p) for x in point_pairs(q, p, 10.0).collect()] == [(1, 1)]
    assert point_pairs(q.limit(0), p, 10.0).count() == 0 and point_pairs(q, p.limit(0), 10.0).count() == 0


def test_every_hot_key_is_salted_however_many(spark):
    big = spark.range(4000).select("id", (F.col("id") % 40).cast("int").alias("k"))
    small = spark.range(40).select(F.col("id").cast("int").alias("k"), F.col("id").alias("v"))
    got = salted_join(big, small, ["k"], ["id"], hot_rows=10)
    assert got.count() == 4000 and got.filter("v <> k").count() == 0
    known = big.groupBy("k").agg(F.count("*").alias("_n"))
    assert salted_join(big, small, ["k"], ["id"], 10, known).count() == 4000


def test_region_baseline_equals_plain_means(spark):
    r = random.Random(7)
    day = dt.date(2000, 1, 1)
    sales = [(f"r{r.randrange(3)}" if i % 50 else None, day + dt.timedelta(r.randrange(3500)), 1000 * r.randrange(1, 10**6), float(r.randrange(0, 90))) for i in range(1500)]
    stores = [(i, f"r{r.randrange(4)}", day + dt.timedelta(r.randrange(3500))) for i in range(40)] + [(90, None, day), (91, "r1", None)]
    got = {(x.region_code, x.opened_at, x.horizon): x.baseline for x in halo.baseline_change(
        spark.createDataFrame(stores, "id long, region_code string, opened_at date"),
        spark.createDataFrame(sales, "region_code string, contract_date date, deal_amount_krw long, area_m2 double")).collect()}
    want = {}
    for region, opened in {(s[1], s[2]) for s in stores if s[1] and s[2]}:
        own = [((d - opened).days, price / area) for where, d, price, area in sales if where == region and area > 0]
        if not any(-365 <= age <= 1825 for age, _ in own):
            continue
        mean = lambda low, high: (lambda x: sum(x) / len(x) if x else None)([u for age, u in own if low <= age <= high])
        before = mean(-365, -1)
        for horizon, days in halo.HORIZONS.items():
            after = mean(0, days)
            want[region, opened, horizon] = (after - before) / before if before and after is not None else None
    assert got.keys() == want.keys()
    assert all(got[k] == (None if want[k] is None else pytest.approx(want[k], rel=1e-9)) for k in want)


def test_region_baseline_has_no_join(spark, tables):
    plan = halo.baseline_change(tables.stores, tables.land_transactions.select("region_code", "contract_date", "deal_amount_krw", "area_m2"))
    assert "contract_date" in plan._jdf.queryExecution().optimizedPlan().toString()
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins(plan) == joins(tables.stores) + joins(tables.land_transactions)


def test_sales_meet_their_project_without_a_join_on_the_project(spark, tables):
    """The nearby sales are stored with their anchors; only the salted lookup of the median follows."""
    text = impact.uplift_samples(tables.projects, tables.project_stages, tables.land_transactions)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in text and "polygon" not in text
