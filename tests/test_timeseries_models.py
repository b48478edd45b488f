import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from parcelspark.operators import timeseries as ts
from parcelspark.operators.nearest import topk_cosine
from parcelspark.plans import forecast, impact, rationale, roads, similar, siting
from parcelspark.plans.features import FEATURE_NAMES


def test_gap_fill(spark):
    series = {"a": [1, None, None, 4], "b": [None, None, 5, 7], "c": [None, None], "d": [3, None]}
    rows = [(k, i, None if v is None else float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    df = ts.fill_gaps(spark.createDataFrame(rows, "k string, i int, v double"), ["k"], "i", "v", "f")
    got = {}
    for r in df.orderBy("k", "i").collect():
        got.setdefault(r.k, []).append(r.f)
    assert got == {"a": [1, 2, 3, 4], "b": [5, 5, 5, 7], "c": [0, 0], "d": [3, 3]}


def test_scaling(spark):
    rows = [("flat", i, 5.0) for i in range(4)] + [("line", i, float(i + 1)) for i in range(5)]
    df = spark.createDataFrame(rows, "k string, i int, v double").select(
        "k", ts.minmax_scale("v", ["k"]).alias("m"), ts.standardize("v", ["k"]).alias("z"), ts.zscore_clip("v", ["k"], 1.0).alias("c"))
    got = df.collect()
    assert all(r.m == 0 and r.z == 0 for r in got if r.k == "flat")
    line = [r for r in got if r.k == "line"]
    assert sum(r.z**2 for r in line) / 5 == pytest.approx(1.0) and max(r.m for r in line) == 1.0
    assert all(-1 <= r.c <= 1 for r in line)


def test_stage_progress(spark):
    stages = spark.createDataFrame(
        [(1, "planned", dt.date(2018, 1, 1)), (1, "under_construction", dt.date(2020, 1, 1)),
         (1, "odd", dt.date(2021, 1, 1)), (1, "completed", dt.date(2022, 6, 1))], "road_id int, stage string, occurred_at date")
    days = [dt.date(2017, 1, 1), dt.date(2018, 1, 1), dt.date(2021, 3, 1), dt.date(2023, 1, 1)]
    months = spark.createDataFrame([(1, d) for d in days], "road_id int, month_first date")
    got = [r.road_progress for r in ts.asof_progress(months, stages, "road_id").orderBy("month_first").collect()]
    assert got == [0.0, 0.10, 0.60, 1.0]


def lag_frame(spark, a, b):
    return spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(zip(a, b))], "k int, i int, a double, b double")


def test_lead_lag_finds_a_shift_of_five_and_rejects_noise(spark):
    r, walk = random.Random(42), [0.0]
    for _ in range(130):
        walk.append(walk[-1] + r.gauss(0, 1))
    led = lag_frame(spark, walk[5:125], walk[:120])
    got = ts.lead_lag(ts.cross_correlation(led, "k", "i", "a", "b"), "k").first()
    assert got.classification == "leading" and -8 <= got.best_lag_months <= -3
    noise = lag_frame(spark, [r.gauss(0, 1) for _ in range(400)], [r.gauss(0, 1) for _ in range(400)])
    assert ts.lead_lag(ts.cross_correlation(noise, "k", "i", "a", "b"), "k").first().classification == "uncertain"


def test_short_and_flat_series(spark):
    short = lag_frame(spark, [1.0, 2.0], [2.0, 4.0])
    got = {(r.a, r.b): r.r for r in ts.pearson_pairs(short, "k", ["a", "b"]).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0, ("b", "b"): 1.0}
    flat = lag_frame(spark, [1.0] * 5, [1.0, 2.0, 3.0, 4.0, 5.0])
    got = {(r.a, r.b): r.r for r in ts.pearson_pairs(flat, "k", ["a", "b"]).collect()}
    assert got[("a", "a")] == 0.0 and got[("a", "b")] == 0.0 and got[("b", "b")] == 1.0
    assert ts.lead_lag(ts.cross_correlation(flat, "k", "i", "a", "b"), "k").first().best_lag_months == 0


def test_previous_year_needs_the_very_year(spark):
    p = spark.createDataFrame([("x", 2020, 1_500_000), ("x", 2021, 1_575_000), ("x", 2023, 1_600_000)], "pnu string, year int, price_per_m2 long")
    got = {r.year: r.change_rate for r in ts.previous_year_change(p).collect()}
    assert got == {2020: None, 2021: 5.0, 2023: None}


def uplift_rows(noise=0.01):
    r = random.Random(7)
    return [(p, "new_town", 1.0, float(d), m, 0.30 * math.exp(-0.40 * d / 1000) * (1 + r.gauss(0, noise)))
            for p in range(4) for d in (100, 500, 1000, 2000, 3000) for m in (0, 6, 12, 18, 24)]


SAMPLE = "project_id int, project_type string, weight double, distance_m double, months_since_anchor int, uplift_pct double"


def test_decay_fit_recovers_and_predicts_decreasing(spark):
    samples = spark.createDataFrame(uplift_rows(), SAMPLE)
    fit = impact.fit_surface(samples, "project_type").first()
    assert 0.2 <= fit.b <= 0.6 and 0.1 <= fit.a <= 0.5 and fit.rmse < 0.10 and fit.confidence == 0.85
    assert fit.b == pytest.approx(0.40, abs=0.02)
    errors = impact.leave_one_out_error(samples).collect()
    assert len(errors) == 4 and all(e.rmse < 0.10 for e in errors)


def test_few_projects_keep_defaults(spark):
    samples = spark.createDataFrame([r for r in uplift_rows() if r[0] == 0], SAMPLE)
    fit = impact.fit_surface(samples, "project_type").first()
    assert (fit.a, fit.b, fit.m0, fit.m3, fit.rmse) == (0.20, 0.30, 0.20, 1.10, None)


def test_default_grid_values(spark):
    anchors = spark.createDataFrame([(1, dt.date(2024, 1, 1))], "project_id int, anchor_date date")
    grid = {(r.distance_m, r.months_after_anchor): r.expected_uplift_pct for r in impact.uplift_grid(impact.default_surface(anchors)).collect()}
    assert len(grid) == 36 and grid[(0.0, 24)] == 0.2 and grid[(1000.0, 24)] == round(0.2 * math.exp(-0.3), 4)
    assert grid[(0.0, 12)] > grid[(250.0, 12)] > grid[(3000.0, 12)]


def test_weighted_cosine(spark):
    names = list(similar.REGION_WEIGHTS)
    row = lambda v: [float(x) for x in v]
    df = spark.createDataFrame([tuple(row([1, 2, 3, 4, 5]) * 2), tuple(row([1, 0, 0, 0, 0]) + row([0, 1, 0, 0, 0])), tuple([0.0] * 10)],
                               [f"a_{n}" for n in names] + [f"b_{n}" for n in names])
    got = [r[0] for r in df.select(similar.weighted_cosine("a_", "b_", similar.REGION_WEIGHTS)).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == 0.0 and got[2] == 0.0
    assert sum(similar.normalised_weights({"x": 2.0, "y": 6.0}).values()) == 1.0


@pytest.mark.parametrize("pivots,block", [(1, 2048), (6, 16)])
def test_topk_cosine_is_exact_with_copies_and_zero_vectors(spark, pivots, block):
    r = random.Random(11)
    vectors = [[r.gauss(0, 1) + (3 if i % 2 else -3) for _ in range(4)] for i in range(80)]
    vectors += [[1.0, 2.0, 3.0, 4.0]] * 40 + [[0.0] * 4] * 3
    rows = [(i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "i long, v array<double>")
    got = {}
    for x in topk_cosine(df, df.withColumnRenamed("i", "j"), "i", "j", "v", 3, True, pivots, block).orderBy("i", "rank").collect():
        got.setdefault(x.i, []).append(x.j)

    def cosine(a, b):
        na, nb = math.sqrt(sum(x * x for x in a)), math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / (na * nb), 9) if na and nb else 0.0

    want = {i: [j for _, j in sorted((-cosine(v, w), j) for j, w in rows if j != i)[:3]] for i, v in rows}
    assert got == want


def test_forecast_shapes(spark):
    prices = spark.createDataFrame(
        [("up", y, int(1000 * 1.05 ** (y - 2018))) for y in range(2018, 2024)] + [("two", 2020, 1000), ("two", 2022, 1210), ("one", 2020, 5)],
        "pnu string, year int, price_per_m2 long")
    parcels = spark.createDataFrame([("up",), ("two",), ("one",), ("none",)], "pnu string")
    got = {r.pnu: r for r in forecast.forecast(prices, parcels).collect()}
    assert got["up"].growth_1y == pytest.approx(0.05, abs=0.002) and got["two"].growth_1y == pytest.approx(0.1)
    assert got["one"].growth_5y == 0.0 and got["none"].method == "empty" and got["none"].confidence == 0.0


def features(spark, **values):
    return spark.createDataFrame([("x", *[float(values.get(n, 0.0)) for n in FEATURE_NAMES])], ["entity_id", *FEATURE_NAMES])


def test_rules_good_bad_and_model_factors(spark):
    good = dict(land_area_m2=1800, land_price_5y_growth=0.4, population_within_3km=60000, aadt_nearest_road=20000,
                distance_to_nearest_road_m=30, nearby_road_expansion=1, nearby_new_town=1, population_growth_3y_pct=0.06)
    rows = rationale.rationale_rows(rationale.with_rationales(features(spark, **good)), "entity_id").collect()
    assert {r.category for r in rows} == {"property", "surroundings", "traffic", "catalyst"}
    assert all(r.impact == "positive" for r in rows) and len(rows) == 8
    assert any(r.detail.startswith("3km 이내 인구 60,000명") for r in rows)
    bad = dict(land_area_m2=300, population_within_3km=500, competitor_count_within_500m=6, aadt_nearest_road=100,
               distance_to_nearest_road_m=900, population_growth_3y_pct=-0.1)
    df = features(spark, **bad).withColumn("factors", F.expr(
        "array(named_struct('factor','land_area_m2','value',300D,'impact','negative'),"
        "named_struct('factor','floor_area_ratio','value',0.5D,'impact','positive'))"))
    rows = rationale.rationale_rows(rationale.with_rationales(df, "factors"), "entity_id").collect()
    assert sum(r.impact == "negative" for r in rows) >= 5
    assert [r.feature for r in rows if r.category == "property"] == ["land_area_m2", "floor_area_ratio"]


def test_classifier_on_separable_rows(spark, tmp_path):
    r = random.Random(3)
    rows = []
    for i in range(80):
        label = float(i % 2)
        rows.append((f"e{i}", label, *[r.gauss(5 * label if n == "land_area_m2" else 0, 1) for n in FEATURE_NAMES]))
    df = spark.createDataFrame(rows, ["entity_id", "label", *FEATURE_NAMES]).coalesce(1)
    folds = siting.cross_validate(df, folds=2, trees=5)
    assert folds.count() == 2 and folds.agg(F.min("auc")).first()[0] > 0.9
    model = siting.fit_model(df, trees=5)
    model.write().overwrite().save(str(tmp_path / "m"))
    from pyspark.ml import PipelineModel

    again = PipelineModel.load(str(tmp_path / "m"))
    first = {r.entity_id: r.score_raw for r in siting.score(df, model, "DT").collect()}
    assert first == {r.entity_id: r.score_raw for r in siting.score(df, again, "DT").collect()}
    assert siting.score(df, model, "DT").filter("score_100 < 0 or score_100 > 100").count() == 0
    # The reference point lies in the negative class, so only positives can differ from it.
    told = siting.explain(df.filter("label = 1"), model, siting.reference_point(df))
    assert told.filter((F.col("factors")[0]["factor"] == "land_area_m2") & (F.col("factors")[0]["impact"] == "positive")).count() == 40
    assert siting.importance_factors(df, model).first().factors[0].factor == "land_area_m2"
    counts = siting.with_folds(df, 4).groupBy("label", "fold").count().agg(F.max("count") - F.min("count")).first()[0]
    assert counts <= 1


def test_similar_regions_rank_over_all_areas_of_a_level(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 40)
    names = list(similar.REGION_WEIGHTS)
    r = random.Random(5)
    rows = [(f"{i:04d}", f"n{i}", "city" if i % 3 else "town", *[float(r.randint(-9, 9)) for _ in names]) for i in range(260)]
    rows[200] = rows[200][:3] + (0.0,) * 5
    df = spark.createDataFrame(rows, "code string, name string, level string, " + ", ".join(f"{n} double" for n in names))
    got = {}
    for hit in similar.similar_regions(df, top_n=3).orderBy("code", "rank").collect():
        got.setdefault(hit.code, []).append(hit.peer_code)

    def cosine(a, b):
        x, y = ([v * w for v, w in zip(r[3:], similar.REGION_WEIGHTS.values())] for r in (a, b))
        size = sum(v * v for v in x) ** 0.5 * sum(v * v for v in y) ** 0.5
        return round(sum(v * w for v, w in zip(x, y)) / size, 10) if size >= 1e-12 else 0.0

    want = {a[0]: [b[0] for b in sorted((b for b in rows if b[2] == a[2] and b[0] != a[0]), key=lambda b: (-cosine(a, b), b[0]))[:3]] for a in rows}
    assert got == want
    assert max(p for peers in got.values() for p in peers) > "0200"


def test_neutral_score_without_model(spark):
    got = siting.score(features(spark), None, "DI").first()
    assert (got.score_raw, got.score_100, got.label_text, got.confidence) == (0.5, 50, "medium", 0.20)


def test_plans_have_no_cross_join_and_no_row_udf(spark, tables):
    aligned = roads.aligned_months(tables.traffic_volumes, tables.road_segments, tables.population_stats, tables.road_expansion_stages)
    from parcelspark.plans import halo, views

    for df in (roads.road_report(aligned), halo.store_halo(tables.stores, tables.land_transactions),
               views.project_nearby_sales(tables.projects, tables.land_transactions)):
        text = df._jdf.queryExecution().executedPlan().toString()
        assert not any(bad in text for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython"))


def test_correlation_of_a_narrow_range_is_finite(spark):
    rows = [(1, t, 0.5 + 1e-9 * ((t * 7919) % 13) / 13, 0.5 + 1e-9 * ((t * 104729) % 11) / 11) for t in range(60)]
    frame = spark.createDataFrame(rows, "k int, t int, a double, b double")
    want = frame.agg(F.corr("a", "b")).first()[0]
    lags = {r.lag: r.r for r in ts.cross_correlation(frame, "k", "t", "a", "b").collect()}
    assert all(-1 <= r <= 1 for r in lags.values())
    assert abs(lags[0]) in (0.0, abs(want)) or abs(lags[0] - want) < 1e-6


def test_percent_change_rounds_halves_away_from_zero(spark):
    from parcelspark.functions.numbers import percent_change

    rows = [(80000, 80100, 0.13), (80000, 79900, -0.13), (100, 250, 150.0), (0, 5, None), (3, 4, 33.33), (None, 4, None)]
    got = spark.createDataFrame(rows, "old long, new long, want double").withColumn("got", percent_change("new", "old")).collect()
    assert [r.got for r in got] == [r.want for r in got]
