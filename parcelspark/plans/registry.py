"""Every operator and report bound to the test tables, by inventory id."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelspark.functions.geo import haversine_km
from parcelspark.functions.numbers import change, percent_change, round_even
from parcelspark.operators import timeseries as ts
from parcelspark.operators.skew import grouped_median, top_rows
from parcelspark.operators.nearest import topk_cosine
from parcelspark.operators.ranking import rank_auc
from parcelspark.plans import features, forecast, halo, impact, rationale, roads, similar, siting, views
from parcelspark.operators import sinks
from parcelspark.operators.snapshots import SnapshotTable
from parcelspark.session import cut_lineage, shared_folder
from parcelspark.sources import feeds
from parcelspark.streaming import ingest
from parcelspark.sources.standin import AS_OF, StandIn

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Callable[[StandIn], DataFrame]) -> Callable[[StandIn], DataFrame]:
    QUERIES[function.__name__] = lambda spark, directory: function(StandIn(spark, directory))
    return function


def rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: round_even(n, digits) for n in names})


def priced(df: DataFrame, *names: str) -> DataFrame:
    """Mean prices at three digits for display.

    Averages of few sales end exactly on a half; the rounding border is set just
    below it, so that summation order cannot decide the last digit.
    """
    return df.withColumns({n: F.floor(F.col(n) * 1000.0 + F.lit(0.500001)) / F.lit(1000.0) for n in names})


# Views, listings, records


@query
def s11_p2_sales_scan(t: StandIn) -> DataFrame:
    import datetime as dt

    scan = views.optional_filters(
        t.land_transactions, {"region_code": None, "transaction_type": "land"},
        dt.date(1998, 1, 1), dt.date(1999, 12, 31), "contract_date")
    return scan.select("source_id", "region_code", "contract_date", "deal_amount_krw")


@query
def l1_project_page(t: StandIn) -> DataFrame:
    return views.page(views.list_projects(t.projects, t.project_stages), "id", 10, 5)


@query
def l1_road_page(t: StandIn) -> DataFrame:
    return views.page(views.list_roads(t.road_segments, t.road_expansion_stages), "id", 50, 0)


@query
def l1_store_page(t: StandIn) -> DataFrame:
    return views.page(views.list_stores(t.stores, t.store_brands, store_type="DT"), "id", 200, 0)


@query
def j17_project_anchors(t: StandIn) -> DataFrame:
    counted = views.with_stage_count(t.projects, t.project_stages, "project_id").select(
        F.col("id").alias("project_id"), "stage_count")
    return views.anchor_dates(t.projects, t.project_stages).join(counted, "project_id")


@query
def j18_road_records(t: StandIn) -> DataFrame:
    record = views.with_stages(t.road_segments, t.road_expansion_stages, "road_id", ["stage"])
    text = F.concat_ws("|", F.transform(
        "stages", lambda s: F.concat_ws(":", s["occurred_at"].cast("string"), s["stage"])))
    return record.select("id", "name", F.size("stages").alias("n_stages"), text.alias("stages"))


@query
def j11_road_yearly_metrics(t: StandIn) -> DataFrame:
    return views.road_yearly_metrics(t.traffic_volumes, t.road_segments, t.population_stats, "equal")


@query
def j11_road_yearly_metrics_prefix(t: StandIn) -> DataFrame:
    return views.road_yearly_metrics(t.traffic_volumes, t.road_segments, t.population_stats, "prefix")


@query
def j12_store_full_profile(t: StandIn) -> DataFrame:
    profile = views.store_full_profile(t.stores, t.store_brands, t.buildings, t.official_land_prices)
    return profile.drop("price_by_year")


@query
def g9_yearly_traffic(t: StandIn) -> DataFrame:
    return views.yearly_traffic(t.traffic_volumes)


@query
def g10_price_series(t: StandIn) -> DataFrame:
    s = views.price_series(t.official_land_prices)
    return s.select(
        "pnu", views.series_text(F.col("series")).alias("series"), "first_year", "latest_year",
        "earliest_price", "latest_price",
        percent_change("latest_price", "earliest_price").alias("price_change_pct"))


@query
def j14_w1_price_yoy(t: StandIn) -> DataFrame:
    return ts.previous_year_change(t.official_land_prices)


@query
def w2_w3_price_change(t: StandIn) -> DataFrame:
    return ts.price_change(t.official_land_prices)


# Development projects


@query
def j1_project_nearby_sales(t: StandIn) -> DataFrame:
    return rounded(views.project_nearby_sales(t.projects, t.land_transactions), 3, "distance_m")


@query
def j2_p8_impact_zone(t: StandIn) -> DataFrame:
    d = F.col("distance_m")
    ring = F.when(d <= 1000, "1km").when(d <= 3000, "3km").when(d <= 5000, "5km")
    zone = impact.impact_zone(t.projects, t.admin_areas).withColumn("ring", ring)
    return rounded(zone, 3, "distance_m")


@query
def j3_p7_road_impact(t: StandIn) -> DataFrame:
    scored = impact.road_impact(t.projects, t.road_segments)
    return rounded(scored.withColumn("length_m", F.col("length_m").cast("double")), 3, "distance_m")


@query
def j1_split_project_sales(t: StandIn) -> DataFrame:
    """Sales near projects of several parts and with holes."""
    return rounded(views.project_nearby_sales(t.split_projects, t.land_transactions), 3, "distance_m").select("project_id", "source_id", "distance_m")


@query
def j2_split_project_zone(t: StandIn) -> DataFrame:
    return rounded(impact.impact_zone(t.split_projects, t.admin_areas), 3, "distance_m").drop("admin_name")


@query
def j3_split_project_roads(t: StandIn) -> DataFrame:
    return rounded(impact.road_impact(t.split_projects, t.road_segments), 3, "distance_m").select("project_id", "road_id", "distance_m", "weight")


@query
def w9_uplift_samples(t: StandIn) -> DataFrame:
    s = impact.uplift_samples(t.projects, t.project_stages, t.land_transactions)
    return priced(rounded(s, 3, "distance_m"), "base").withColumn("uplift_pct", round_even("uplift_pct", 6)).drop("project_type")


@query
def g12_region_median_price(t: StandIn) -> DataFrame:
    sales = halo.unit_prices(t.land_transactions)
    return priced(grouped_median(sales, ["region_code"], "unit_price", "median_price"), "median_price")


@query
def m1_m2_m3_fit_by_project_type(t: StandIn) -> DataFrame:
    samples = impact.uplift_samples(t.projects, t.project_stages, t.land_transactions, with_ids=False)
    fitted = impact.fit_surface(samples, "project_type")
    return rounded(fitted, 4, "a", "b", "m0", "m1", "m2", "m3", "rmse")


@query
def m4_default_uplift_grid(t: StandIn) -> DataFrame:
    anchors = views.anchor_dates(t.projects, t.project_stages)
    grid = impact.uplift_grid(impact.default_surface(anchors))
    return grid.select("project_id", "anchor_date", "distance_m", "months_after_anchor", "expected_uplift_pct", "confidence")


@query
def m4_sale_level_uplift(t: StandIn) -> DataFrame:
    samples = impact.uplift_samples(t.projects, t.project_stages, t.land_transactions, with_ids=False)
    scored = impact.default_surface(samples.drop("weight")).withColumn(
        "expected", impact.spatial_kernel(F.col("distance_m")) * impact.time_factor(F.col("months_since_anchor")))
    return scored.groupBy("project_id").agg(
        F.count("*").alias("n"), round_even(F.avg("expected"), 6).alias("mean_expected"))


@query
def m16_leave_one_out(t: StandIn) -> DataFrame:
    samples = impact.uplift_samples(t.projects, t.project_stages, t.land_transactions, with_ids=False)
    return rounded(impact.leave_one_out_error(samples), 4, "a", "b", "rmse")


@query
def q1_project_impact_report(t: StandIn) -> DataFrame:
    report = impact.impact_report(
        t.projects, t.project_stages, t.land_transactions, t.admin_areas, t.road_segments)
    return rounded(report, 4, "a", "b", "expected_uplift_pct").withColumn("zone_nearest_m", round_even("zone_nearest_m", 3))


@query
def q1_top_factors(t: StandIn) -> DataFrame:
    return impact.top_factors(impact.default_surface(views.anchor_dates(t.projects, t.project_stages)))


@query
def r1_uplift_pivot(t: StandIn) -> DataFrame:
    anchors = views.anchor_dates(t.projects, t.project_stages)
    grid = impact.uplift_grid(impact.default_surface(anchors))
    wide = grid.withColumn("d", F.concat(F.lit("d"), F.col("distance_m").cast("int").cast("string")))
    names = [f"d{d}" for d in impact.DISTANCES_M]
    return wide.groupBy("project_id", "months_after_anchor").pivot("d", names).agg(F.first("expected_uplift_pct"))


# Roads, population and traffic


def _aligned(t: StandIn) -> DataFrame:
    return roads.aligned_months(t.traffic_volumes, t.road_segments, t.population_stats, t.road_expansion_stages)


@query
def j7_g1_region_population(t: StandIn) -> DataFrame:
    return roads.region_population(t.population_stats, t.road_segments)


@query
def j8_j9_aligned_months(t: StandIn) -> DataFrame:
    return _aligned(t)


@query
def w4_w7_scaled_series(t: StandIn) -> DataFrame:
    return rounded(roads.scaled_series(_aligned(t)), 9, *roads.VARIABLES)


@query
def w5_w6_traffic_zscore(t: StandIn) -> DataFrame:
    scored = t.traffic_volumes.select(
        "road_id", "observed_at", ts.standardize("aadt", ["road_id"]).alias("z"),
        ts.zscore_clip("aadt", ["road_id"], 2.0).alias("z_clipped"))
    return rounded(scored, 8, "z", "z_clipped")


@query
def m5_pearson_matrix(t: StandIn) -> DataFrame:
    return roads.correlations(roads.scaled_series(_aligned(t)))


@query
def w8_cross_correlation(t: StandIn) -> DataFrame:
    return rounded(roads.lags(roads.scaled_series(_aligned(t))), 4, "r")


@query
def w8_lead_lag(t: StandIn) -> DataFrame:
    return ts.lead_lag(roads.lags(roads.scaled_series(_aligned(t))), "road_id")


@query
def w10_g15_cumulative_change(t: StandIn) -> DataFrame:
    return rounded(roads.cumulative_change(_aligned(t)), 6, "growth")


@query
def q2_road_report(t: StandIn) -> DataFrame:
    return rounded(roads.road_report(_aligned(t)), 6, "growth")


@query
def m14_road_insights(t: StandIn) -> DataFrame:
    return roads.insights(roads.road_report(_aligned(t)), t.road_segments)


@query
def l7_top_factors(t: StandIn) -> DataFrame:
    return roads.top_factors(roads.road_report(_aligned(t)))


# Store halo


@query
def g7_band_prices(t: StandIn) -> DataFrame:
    return priced(halo.band_prices(t.stores, t.land_transactions), "pre_avg", "post_avg")


@query
def g8_baseline_change(t: StandIn) -> DataFrame:
    return rounded(halo.baseline_change(t.stores, t.land_transactions), 6, "baseline")


@query
def m15_store_halo(t: StandIn) -> DataFrame:
    return priced(halo.store_halo(t.stores, t.land_transactions), "pre_avg", "post_avg")


@query
def q3_halo_report(t: StandIn) -> DataFrame:
    return halo.halo_report(halo.store_halo(t.stores, t.land_transactions))


@query
def r2_halo_pivot(t: StandIn) -> DataFrame:
    wide = halo.halo_pivot(halo.store_halo(t.stores, t.land_transactions))
    return wide.select("band_m", *[round_even(f"`{h}`", 5).alias("h" + h[1:]) for h in halo.HORIZONS])


# Feature rows


def _entities(t: StandIn) -> DataFrame:
    return features.store_entities(t.stores, AS_OF).unionByName(features.parcel_entities(t.buildings, AS_OF))


@query
def j4_competitor_counts(t: StandIn) -> DataFrame:
    return features.competitor_counts(_entities(t), t.stores)


@query
def j4_g2_population_around(t: StandIn) -> DataFrame:
    return features.population_around(_entities(t), t.admin_areas, t.population_stats)


@query
def j5_g13_nearest_road_degree(t: StandIn) -> DataFrame:
    return rounded(features.nearest_road(
        _entities(t), t.road_segments, t.traffic_volumes, AS_OF), 3, "distance_to_nearest_road_m")


@query
def j5_g13_nearest_road_metre(t: StandIn) -> DataFrame:
    return rounded(features.nearest_road(
        _entities(t), t.road_segments, t.traffic_volumes, AS_OF, "metre"), 3, "distance_to_nearest_road_m")


@query
def j6_geocode_drift(t: StandIn) -> DataFrame:
    """Drift of each store from its parcel's district centroid."""
    centroid = t.admin_areas.select(
        F.col("code").alias("region_code"), F.col("lon").alias("c_lon"), F.col("lat").alias("c_lat"))
    return t.stores.join(centroid, "region_code").select(
        "id", haversine_km(F.col("lon"), F.col("lat"), F.col("c_lon"), F.col("c_lat")).alias("drift_km"))


def _region_snapshots(t: StandIn) -> DataFrame:
    """Every admin code at the reference date and every opening date of its stores."""
    now = t.admin_areas.select(F.col("code").alias("region_code"), F.lit(AS_OF).alias("snapshot_date"))
    opened = t.stores.select("region_code", F.col("opened_at").alias("snapshot_date"))
    return now.unionByName(opened).distinct()


@query
def g4_population_growth(t: StandIn) -> DataFrame:
    return features.population_growth(_region_snapshots(t), t.population_stats)


@query
def g5_stage_counts(t: StandIn) -> DataFrame:
    pairs, keys = _region_snapshots(t), ["region_code", "snapshot_date"]
    road = features.recent_stage_count(
        pairs, t.road_segments, t.road_expansion_stages, "road_id", ["completed"], 36, "nearby_road_expansion")
    town = features.recent_stage_count(
        pairs, t.projects, t.project_stages, "project_id", ["designated", "announced"], 60, "nearby_new_town")
    return road.join(town, keys, "full")


@query
def g6_sales_growth(t: StandIn) -> DataFrame:
    return features.sales_growth(_region_snapshots(t), t.land_transactions)


@query
def q4_p6_feature_table(t: StandIn) -> DataFrame:
    f = features.extract_features(_entities(t), t, AS_OF, region_match="prefix")
    return rounded(f, 3, "distance_to_nearest_road_m")


# Similar regions and stores


def _region_features(t: StandIn, scale: str | None = None) -> DataFrame:
    return similar.region_features(
        t.admin_areas, t.population_stats, t.road_segments, t.traffic_volumes, t.road_expansion_stages, AS_OF, scale)


@query
def g3_j13_g11_region_features(t: StandIn) -> DataFrame:
    return rounded(_region_features(t), 6, *similar.REGION_WEIGHTS)


@query
def l6_region_peers(t: StandIn) -> DataFrame:
    return similar.region_peers(t.admin_areas)


@query
def l5_q7_similar_regions(t: StandIn) -> DataFrame:
    return rounded(similar.similar_regions(_region_features(t)), 6, *similar.REGION_WEIGHTS)


@query
def l5_similar_regions_zscore(t: StandIn) -> DataFrame:
    hits = similar.similar_regions(_region_features(t, "zscore"))
    return hits.select("code", "peer_code", "score", "rank")


@query
def l4_embedding_neighbours(t: StandIn) -> DataFrame:
    vectors = t.embeddings.select("vec_id", "embedding")
    return topk_cosine(
        vectors, vectors.withColumnRenamed("vec_id", "near_id"), "vec_id", "near_id", "embedding", 5, exclude_self=True)


def _store_features(t: StandIn) -> DataFrame:
    return features.extract_features(features.store_entities(t.stores, AS_OF), t, AS_OF, region_match="prefix")


@query
def p4_q8_similar_stores(t: StandIn) -> DataFrame:
    return similar.similar_stores(_store_features(t), t.stores)


# Forecast


@query
def m10_forecast(t: StandIn) -> DataFrame:
    f = forecast.forecast(t.official_land_prices, t.buildings)
    return rounded(f, 6, "slope", "annual_growth", "boosted_annual")


@query
def m10_m11_forecast_with_catalysts(t: StandIn) -> DataFrame:
    parcels = features.parcel_entities(t.buildings, AS_OF)
    signals = features.catalysts(
        parcels, t.population_stats, t.road_segments, t.road_expansion_stages, t.projects, t.project_stages,
        t.land_transactions, "prefix")
    per_parcel = parcels.join(signals, ["region_code", "snapshot_date"]).select("pnu", *features.CATALYSTS)
    f = forecast.forecast(t.official_land_prices, None, per_parcel)
    return rounded(f, 6, "slope", "annual_growth", "boosted_annual", "catalyst_score")


@query
def m12_backtest_errors(t: StandIn) -> DataFrame:
    return rounded(forecast.backtest_errors(t.official_land_prices), 6, "actual", "ape")


@query
def m12_g14_backtest_summary(t: StandIn) -> DataFrame:
    return forecast.backtest_summary(forecast.backtest_errors(t.official_land_prices))


@query
def m12_g14_backtest_summary_leaky(t: StandIn) -> DataFrame:
    return forecast.backtest_summary(forecast.backtest_errors(t.official_land_prices, leaky=True))


@query
def r3_forecast_bands(t: StandIn) -> DataFrame:
    return rounded(forecast.forecast_bands(forecast.forecast(t.official_land_prices)), 6, "upper", "lower")


# Siting


@query
def p3_l2_candidates(t: StandIn) -> DataFrame:
    return siting.largest_candidates(siting.candidate_parcels(t.buildings)).select(
        "region_code", "pnu", "parcel_area_m2", "use_type", "area_rank")


@query
def m9_u1_training_samples(t: StandIn) -> DataFrame:
    """Positives and sampled negatives of both targets with their labels."""
    out = []
    for target in ("DT", "DI"):
        positives = siting.positive_stores(t.stores, target)
        negatives = siting.negative_parcels(t.buildings, positives)
        out += [positives.select(F.lit(target).alias("target"), "pnu", "region_code", F.lit(1).alias("label")),
                negatives.select(F.lit(target).alias("target"), "pnu", "region_code", F.lit(0).alias("label"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query
def j15_negatives_away_from_stores(t: StandIn) -> DataFrame:
    positives = siting.positive_stores(t.stores, "DT")
    return siting.negative_parcels(t.buildings, positives, min_distance_m=200.0).select("pnu", "region_code", "draw")


@query
def m7_p9_q5_untrained_suitability(t: StandIn) -> DataFrame:
    rows = features.parcel_entities(t.buildings, AS_OF).select("entity_id", "pnu", "region_code")
    return siting.land_suitability(rows, t.official_land_prices, None, "DT")


@query
def l3_p9_m7_rule_ranking(t: StandIn) -> DataFrame:
    """Candidates of both store kinds under a fixed rule of lot size, from a least score on, best ten of every region."""
    area = F.col("parcel_area_m2").cast("double")
    rows = siting.candidate_parcels(t.buildings).select("pnu", "region_code", "parcel_area_m2")
    rules = {"DT": area / F.lit(2500.0), "DI": F.lit(1.0) - area / F.lit(3000.0)}
    out = [siting.ranked_candidates(rows, rule, target, 10, 0.4).select(
        "target", "region_code", "rank", "pnu", "score_raw", "score_100", "label_text") for target, rule in rules.items()]
    return out[0].unionByName(out[1])


def _parcel_features(t: StandIn) -> DataFrame:
    return features.extract_features(_entities(t), t, AS_OF, region_match="prefix")


@query
def m13_l8_rationales(t: StandIn) -> DataFrame:
    return rounded(rationale.rationale_rows(rationale.with_rationales(_parcel_features(t)), "entity_id"), 4, "value")


@query
def r4_rationale_groups(t: StandIn) -> DataFrame:
    rows = rationale.rationale_rows(rationale.with_rationales(_parcel_features(t)), "entity_id")
    grouped = views.rationales_by_category(rows, "entity_id")
    return grouped.select(
        "entity_id", "category", F.size("items").alias("n_items"),
        F.concat_ws("|", F.transform("items", lambda i: F.concat_ws(":", i["impact"], i["feature"]))).alias("items"))


@query
def r5_factor_chart(t: StandIn) -> DataFrame:
    factors = roads.top_factors(roads.road_report(_aligned(t)), 4).select(
        "road_id", F.col("factor_rank").alias("position"), "factor", "value", F.lit(None).cast("double").alias("contribution"))
    return views.factor_chart(factors, "road_id").select("road_id", "factor", "bar", "bar_no")


@query
def m6_g17_linear_auc(t: StandIn) -> DataFrame:
    """AUC of a fixed linear score of lot sizes for both store kinds, per fold and over all, with the release verdict."""
    score = F.round(F.col("building_area_m2") / 100) - F.round(F.col("land_area_m2") / 200)
    rows = t.stores.select(F.explode(F.array(F.lit("DT"), F.lit("DI"))).alias("target"), (F.col("id") % 5).cast("int").alias("fold"), "store_type", score.alias("score"))
    rows = rows.withColumn("label", (F.col("store_type") == F.col("target")).cast("int"))
    folds = rank_auc(rows, ["target", "fold"])
    whole = rank_auc(rows, ["target"]).withColumn("fold", F.lit(-1))
    return rounded(folds.unionByName(whole), 9, "auc").withColumn("passed", F.col("auc") >= siting.MIN_AUC)


@query
def m6_g17_cross_validation(t: StandIn) -> DataFrame:
    """Held-out AUC per fold and the release verdict, for drive-thru stores."""
    rows = siting.training_set(t, "DT", AS_OF, region_match="prefix")
    folds = siting.cross_validate(rows)
    gate = siting.training_gate(siting.positive_stores(t.stores, "DT"), folds)
    verdict = gate.select(F.lit(-1).alias("fold"), F.col("auc_mean").alias("auc"), "passed")
    return folds.withColumn("passed", F.lit(None).cast("boolean")).unionByName(verdict)


@query
def m8_q5_trained_suitability(t: StandIn) -> DataFrame:
    rows = siting.training_set(t, "DT", AS_OF, region_match="prefix")
    model = siting.fit_model(rows)
    parcels = features.extract_features(features.parcel_entities(t.buildings, AS_OF), t, AS_OF, region_match="prefix")
    out = siting.land_suitability(parcels, t.official_land_prices, model, "DT", siting.reference_point(rows))
    return out.select(
        "entity_id", "pnu", "score_raw", "score_100", "label_text", "explanation_confidence", "growth_1y", "growth_3y",
        "growth_5y", F.to_json("factors").alias("factors"), F.size("rationales").alias("n_rationales"))


@query
def l3_q6_candidate_ranking(t: StandIn) -> DataFrame:
    rows = siting.training_set(t, "DT", AS_OF, region_match="prefix")
    model = siting.fit_model(rows)
    ranking = siting.candidate_ranking(
        t, model, siting.reference_point(rows), "DT", AS_OF, store_rows=_store_features(t), region_match="prefix")
    return ranking.select(
        "region_code", "rank", "pnu", "score_raw", "label_text", "growth_1y", "growth_3y", "growth_5y", "region_confidence",
        F.to_json("factors").alias("factors"), F.to_json("rationales").alias("rationales"),
        F.to_json("similar_stores").alias("similar_stores"))


@query
def q9_feature_importances(t: StandIn) -> DataFrame:
    rows = siting.training_set(t, "DI", AS_OF, region_match="prefix")
    return siting.importances(siting.fit_model(rows), t.spark)


# Ingest: feed texts are derived from the tables, then parsed back


def _json(**fields) -> F.Column:
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()]))


def _page(item: F.Column, single: F.Column) -> F.Column:
    """Response text holding one object or a one-element list."""
    body = F.when(single, item).otherwise(F.concat(F.lit("["), item, F.lit("]")))
    return F.concat(F.lit('{"response":{"body":{"items":{"item":'), body, F.lit('},"totalCount":1}}}'))


def _sales_pages(t: StandIn) -> DataFrame:
    """Sale records of both key generations, every eleventh with a broken date."""
    li = t.fact("lineitem", "l_orderkey").withColumn("d", F.col("l_shipdate").cast("date"))
    k = F.col("l_orderkey")
    amount = F.format_number(F.floor(F.col("l_extendedprice")).cast("bigint"), 0)
    day = F.when(k % 11 == 0, F.lit("32")).otherwise(F.dayofmonth("d").cast("string"))
    legacy = _json(**{
        "일련번호": F.concat_ws("-", k, "l_linenumber", "l_partkey"), "년": F.year("d").cast("string"), "월": F.month("d").cast("string"),
        "일": day, "법정동": F.concat(F.lit("동"), F.col("l_suppkey").cast("string")), "거래금액": amount,
        "거래면적": F.col("l_quantity").cast("string"), "용도지역": F.col("l_returnflag")})
    current = _json(
        dealYear=F.year("d").cast("string"), dealMonth=F.month("d").cast("string"), dealDay=day,
        umdNm=F.concat(F.lit("동"), F.col("l_suppkey").cast("string")), jibun=F.col("l_linenumber").cast("string"),
        dealAmount=amount, dealArea=F.col("l_quantity") * 10, landUse=F.col("l_linestatus"), sggCd=F.lit(41220) + F.col("l_suppkey") % 7)
    return li.select(
        F.lit("41280").alias("sigungu"), F.date_format("d", "yyyy-MM").alias("year_month"),
        _page(F.when(k % 2 == 0, legacy).otherwise(current), k % 3 == 0).alias("payload"))


@query
def s1_s2_s3_sales_feed(t: StandIn) -> DataFrame:
    return feeds.normalise_sales(feeds.unwrap(_sales_pages(t))).drop("raw_data", "_item")


@query
def k4_g16_k6_ingest_counts(t: StandIn) -> DataFrame:
    typed = feeds.normalise_sales(feeds.unwrap(_sales_pages(t)))
    return sinks.ingest_counts({"molit_real_estate": feeds.split_rejects(typed, "molit_real_estate")})


def _population_pages(t: StandIn) -> DataFrame:
    """Population records: current keys with a code, or names only."""
    p = t.population_stats.join(
        t.admin_areas.select(F.col("code").alias("region_code"), F.col("name").alias("dong"), F.col("parent_code").alias("sg")), "region_code").join(
        t.admin_areas.select(F.col("code").alias("sg"), F.col("name").alias("sgg"), F.col("parent_code").alias("sd")), "sg").join(
        t.admin_areas.select(F.col("code").alias("sd"), F.col("name").alias("sido")), "sd")
    coded = _json(
        admmCd=F.col("region_code"), ctpvNm=F.col("sido"), sggNm=F.col("sgg"), dongNm=F.col("dong"), tong=F.lit(""),
        totNmprCnt=F.col("total_population").cast("string"), maleNmprCnt=F.col("male_population").cast("string"),
        femlNmprCnt=F.col("female_population").cast("string"), hhCnt=F.col("household_count").cast("string"), hhNmpr=F.lit("2.50"))
    named = _json(
        sidoNm=F.col("sido"), sigungu_nm=F.col("sgg"), emdNm=F.col("dong"), total=F.format_number("total_population", 0),
        male=F.format_number("male_population", 0), female=F.format_number("female_population", 0),
        households=F.format_number("household_count", 0))
    item = F.when(F.month("observed_at") % 2 == 0, coded).otherwise(named)
    return p.select(
        F.date_format("observed_at", "yyyy-MM").alias("year_month"),
        F.concat(F.lit('{"Response":{"head":{"totalCount":"1"},"items":{"item":['), item, F.lit("]}}}")).alias("payload"))


@query
def s4_j10_q10_population_feed(t: StandIn) -> DataFrame:
    typed = feeds.normalise_population(feeds.unwrap(_population_pages(t)))
    return feeds.resolve_region_codes(typed, t.admin_areas).drop("raw_data", "_item", "tong", "ban")


@query
def k2_missing_admin_areas(t: StandIn) -> DataFrame:
    """Admin rows the population feed would add to the provinces and districts."""
    typed = feeds.normalise_population(feeds.unwrap(_population_pages(t)))
    known = t.admin_areas.filter(F.col("level") != "eupmyeondong")
    return sinks.absent_rows(known, feeds.missing_admin_areas(typed), ["code"])


@query
def s5_price_feed(t: StandIn) -> DataFrame:
    p = t.official_land_prices
    key = F.when(F.col("year") % 2 == 0, _json(pnu=F.col("pnu"), indvdLandPrice=F.format_number("price_per_m2", 0))).otherwise(
        _json(pnuCode=F.when(F.col("price_per_m2") % 13 == 0, F.substring("pnu", 1, 18)).otherwise(F.col("pnu")), pblntfPclnd=F.col("price_per_m2")))
    pages = p.select("year", F.concat(F.lit('{"indvdLandPrices":['), key, F.lit("]}")).alias("payload"))
    return feeds.normalise_prices(feeds.unwrap(pages)).drop("raw_data", "_item")


@query
def s6_building_feeds(t: StandIn) -> DataFrame:
    b = t.buildings.withColumn("day", F.date_format("approval_date", "yyyyMMdd"))
    registry = b.select("pnu", _json(
        newPlatPlc=F.lit(""), address=F.col("region_code"), platArea=F.format_number("parcel_area_m2", 1),
        building_area_m2=F.col("building_area_m2").cast("string"), grndFlrCnt=F.lit("12"), use_type=F.col("use_type"), useAprDay=F.col("day")).alias("raw"))
    title = b.select("pnu", _json(
        platPlc=F.col("region_code"), platArea=F.col("parcel_area_m2"), archArea=F.col("building_area_m2"),
        totArea=F.lit("n/a"), grndFlrCnt=F.lit(3), mainPurpsCdNm=F.col("use_type"), bldNm=F.lit("Tower")).alias("raw"))
    return feeds.normalise_buildings(feeds.with_fields(registry), feeds.with_fields(title)).drop("raw_data")


@query
def s6_p5_stored_buildings(t: StandIn) -> DataFrame:
    """Registry rows as the building table takes them: typed approval date, district of the parcel id; parcels of 18 digits are rejects."""
    b = t.buildings
    day = F.when(F.col("parcel_area_m2") % 100 == 0, F.date_format("approval_date", "yyyy-MM-dd")).otherwise(F.date_format("approval_date", "yyyyMMdd"))
    raw = b.select(F.when(F.col("parcel_area_m2") == 350, F.substring("pnu", 1, 18)).otherwise(F.col("pnu")).alias("pnu"), _json(
        address=F.col("region_code"), platArea=F.col("parcel_area_m2").cast("string"), use_type=F.col("use_type"), useAprDay=day).alias("raw"))
    typed = feeds.checked(feeds.storable_buildings(feeds.normalise_registry(feeds.with_fields(raw))), "buildings")
    return typed.select("pnu", "region_code", "approval_date", "parcel_area_m2", "use_type", "error")


@query
def s7_parcel_characteristics(t: StandIn) -> DataFrame:
    raw = t.buildings.select("pnu", _json(
        stdrYear=F.lit("2001"), ldCpsgCode=F.col("region_code"), lndpclAr=F.format_number("parcel_area_m2", 2),
        lndcgrCodeNm=F.lit("대"), prposArea1Nm=F.col("use_type"), prposArea2Nm=F.lit(""), roadSideCodeNm=F.lit("중로한면")).alias("raw"))
    return feeds.normalise_characteristics(feeds.with_fields(raw)).drop("raw_data")


@query
def s8_store_feeds(t: StandIn) -> DataFrame:
    c = t.stores.withColumn("zero", F.when(F.col("id") % 9 == 0, F.lit(0.0)))
    at = lambda x: F.coalesce(F.col("zero"), F.col(x))
    first = c.select(_page(_json(
        s_code=F.col("id").cast("string"), s_name=F.concat("name", F.when(F.col("store_type") == "DT", " dt점").otherwise("")),
        addr=F.col("address"), lat=at("lat").cast("string"), lot=at("lon").cast("string")), F.lit(False)).alias("payload"))
    second = c.select(F.concat(F.lit('{"stores":['), _json(
        id=F.col("id"), storeName=F.col("name"), address=F.col("address"), latitude=at("lat"), longitude=at("lon"),
        is_dt=F.when(F.col("store_type") == "DT", F.lit(True))), F.lit("]}")).alias("payload"))
    return feeds.normalise_stores(feeds.unwrap(first), "스타벅스").unionByName(
        feeds.normalise_stores(feeds.unwrap(second), "맥도날드")).drop("raw_data", "_item")


def _store_pages(t: StandIn) -> DataFrame:
    """Store records of one catalogue, some without a source id and some outside the service area."""
    lat = F.when(F.col("id") % 9 == 0, F.lit(0.0)).when(F.col("id") % 13 == 0, F.col("lat") + 5).otherwise(F.col("lat"))
    return t.stores.select(F.concat(F.lit('{"stores":['), _json(
        s_code=F.when(F.col("id") % 17 != 0, F.col("id").cast("string")), s_name=F.col("name"), addr=F.col("address"),
        lat=lat, lot=F.col("lon")), F.lit("]}")).alias("payload"))


@query
def s8_k3_p1_stored_stores(t: StandIn) -> DataFrame:
    """Catalogue rows as the store table takes them: brand id, own id, outcome under the table's rules."""
    typed = cut_lineage(ingest.with_outcome(feeds.normalise_stores(feeds.unwrap(_store_pages(t)), "스타벅스"), "stores"))
    brands = sinks.surrogate_ids(t.store_brands.limit(0).select(F.lit(0).alias("id"), "name"), typed.select(F.col("brand").alias("name")))
    known = t.stores.filter("store_type = 'DT'").select("id", F.lit(1).alias("brand_id"), F.col("id").cast("string").alias("source_id"))
    return feeds.storable_stores(typed, brands, known).select("id", "brand_id", "source_id", "name", "lat", "lon", "outcome", "error")


@query
def s9_j19_geocode_match(t: StandIn) -> DataFrame:
    """Two search hits per store, the second named with the type's suffix."""
    hit = lambda r, extra: _json(
        title=F.concat(F.lit("<b>"), F.col("brand"), F.lit("</b> "), extra), address=F.lit(""), roadAddress=F.lit("r"),
        mapx=F.floor((F.col("lon") + 0.001 * r) * 1e7).cast("bigint").cast("string"),
        mapy=F.floor((F.col("lat") + 0.001 * r) * 1e7).cast("bigint").cast("string"))
    found = t.stores.filter(F.col("store_type") != "standard")
    raw = found.select("id", F.posexplode(F.array(
        hit(1, F.lit("본점")), hit(2, F.concat("store_type", F.lit("점"))))).alias("hit_rank", "raw"))
    hits = feeds.normalise_geocodes(feeds.with_fields(raw))
    return feeds.match_geocodes(t.stores, hits).select(
        "id", "query", "status", "hit_name", round_even("verified_lon", 7).alias("verified_lon"),
        round_even("verified_lat", 7).alias("verified_lat"), "drift_km")


@query
def s10_p5_parcel_list(t: StandIn) -> DataFrame:
    p, n = F.col("pnu"), F.length("use_type")
    dashed = F.concat_ws("-", F.substring(p, 1, 10), F.substring(p, 11, 1), F.substring(p, 12, 4), F.substring(p, 16, 4))
    line = F.when(n % 3 == 0, F.concat(F.lit("  "), p)).when(n % 3 == 1, dashed).otherwise(F.concat(p, F.lit("x")))
    listed, rejected = feeds.parcel_list(t.buildings.select(line.alias("value")))
    good = listed.select("pnu", feeds.parcel_parts(F.col("pnu")).alias("p")).select("pnu", "p.*", F.lit(True).alias("accepted"))
    return good.unionByName(
        rejected.select(F.col("line").alias("pnu"), F.lit(False).alias("accepted")), allowMissingColumns=True)


@query
def p1_violations(t: StandIn) -> DataFrame:
    shifted = t.stores.select(
        "id", F.when(F.col("store_type") == "DI", F.substring("pnu", 1, 18)).otherwise(F.col("pnu")).alias("pnu"),
        F.when(F.col("brand") == "BUILDING", F.col("lon")).otherwise(F.col("lat")).alias("lat"), "lon",
        F.col("closed_at").alias("first_day"), F.col("opened_at").alias("last_day"), F.lower("store_type").alias("store_type"))
    broken = feeds.violations("pnu", "lat", "lon", ("first_day", "last_day"), ["id"], {"store_type": "store_type"})
    return shifted.select("id", F.concat_ws("|", broken).alias("violations"))


# Sinks as pure table functions


def _corrections(t: StandIn) -> DataFrame:
    """Corrected prices for 1998 and later, and one new year for every parcel."""
    p = t.official_land_prices
    newer = p.filter(F.col("year") >= 1998).select("pnu", "year", (F.col("price_per_m2") + 7).alias("price_per_m2"))
    fresh = p.groupBy("pnu").agg(F.max("price_per_m2").alias("price_per_m2")).select("pnu", F.lit(2002).alias("year"), "price_per_m2")
    return newer.unionByName(fresh)


@query
def k1_merged_prices(t: StandIn) -> DataFrame:
    old = t.official_land_prices.withColumn("note", F.lit("stored"))
    new = _corrections(t).withColumn("note", F.lit("incoming"))
    return sinks.merge_rows(old, new, ["pnu", "year"], ["price_per_m2"])


@query
def k1_w1_incoming_change_rate(t: StandIn) -> DataFrame:
    return ts.change_from_stored(_corrections(t), t.official_land_prices)


@query
def k3_brand_ids(t: StandIn) -> DataFrame:
    """Known brands keep their id; how many new names and whether ids are unique."""
    known = t.store_brands.filter(F.length("name") > 8).select(F.length("name").cast("bigint").alias("id"), "name").dropDuplicates(["id"])
    ids = sinks.surrogate_ids(known, t.store_brands)
    kept = ids.join(known.select("name", F.col("id").alias("old")), "name", "left")
    return kept.agg(
        F.count("*").alias("n"), F.countDistinct("id").alias("n_ids"), F.countDistinct("name").alias("n_names"),
        F.sum((F.col("id") == F.col("old")).cast("int")).alias("kept"))


@query
def k3_named_ids(t: StandIn) -> DataFrame:
    """A row per customer name: a third of them keep their id, the others follow the highest one without a gap."""
    c = t.raw("customer")
    known = c.filter("c_custkey % 3 = 0").groupBy(F.col("c_name").alias("name")).agg(F.min("c_custkey").cast("bigint").alias("id"))
    return sinks.surrogate_ids(known, c.select(F.col("c_name").alias("name")), part_rows=1000).select("name", "id")


def _price_table(t: StandIn, use: str) -> SnapshotTable:
    folder = f"{shared_folder(t.spark)}/{use}-{uuid.uuid4().hex}"
    return SnapshotTable(t.spark, folder, t.official_land_prices.withColumn("note", F.lit("")).schema, ["pnu", "year"], "year")


@query
def k1_snapshot_prices(t: StandIn) -> DataFrame:
    """The corrections applied to stored prices, twice: the second time changes nothing."""
    stored = _price_table(t, "k1-prices")
    stored.upsert(t.official_land_prices.withColumn("note", F.lit("stored")), ["price_per_m2"])
    for _ in range(2):
        stored.upsert(_corrections(t).withColumn("note", F.lit("incoming")), ["price_per_m2"])
    return stored.read()


@query
def k2_snapshot_absent_prices(t: StandIn) -> DataFrame:
    """The corrections offered to stored prices where only unknown keys are taken."""
    stored = _price_table(t, "k2-prices")
    stored.replace(t.official_land_prices.withColumn("note", F.lit("stored")))
    stored.insert_absent(_corrections(t).withColumn("note", F.lit("incoming")))
    return stored.read()


@query
def k8_reloaded_prices(t: StandIn) -> DataFrame:
    """The price table emptied and loaded anew with the corrections alone."""
    root = f"{shared_folder(t.spark)}/k8-{uuid.uuid4().hex}"
    for rows in (t.official_land_prices, _corrections(t)):
        sinks.reload({"official_land_prices": rows}, root)
    return sinks.stored(t.spark, root, "official_land_prices").select("pnu", "year", "price_per_m2")


@query
def k6_g16_t1_ledger(t: StandIn) -> DataFrame:
    """Sales pages ingested twice: outcomes by file, and how often each reject text came."""
    root = f"{shared_folder(t.spark)}/k6-{uuid.uuid4().hex}"
    pages = _sales_pages(t).withColumn("_path", F.concat(F.lit("sales/"), "year_month"))
    rows = feeds.normalise_sales(feeds.unwrap(pages))
    for _ in range(2):
        ingest.ingest(rows, root, "land_transactions", "molit", f"{root}/_ledger/batch=0", f"{root}/rejects", f"{root}/counts")
    bad = sinks.rejects_table(t.spark, f"{root}/rejects").read().groupBy("source_file").agg(F.sum("times").alias("rows"))
    counts = sinks.counts_table(t.spark, f"{root}/counts").read().select("source_file", "outcome", "rows")
    kept = sinks.stored(t.spark, root, "land_transactions").agg(F.count("*").alias("rows"))
    return counts.unionByName(bad.withColumn("outcome", F.lit("reject records"))).unionByName(
        kept.select(F.lit("").alias("source_file"), F.lit("stored").alias("outcome"), "rows"))


@query
def k5_analysis_rows(t: StandIn) -> DataFrame:
    grid = impact.uplift_grid(impact.default_surface(views.anchor_dates(t.projects, t.project_stages)))
    keyed = grid.withColumn("radius_m", F.lit(5000)).withColumn("distance", F.col("distance_m").cast("int"))
    return sinks.analysis_rows(
        keyed, "a", "project", "project_id", ["radius_m", "distance", "months_after_anchor"], ["expected_uplift_pct"]).drop("result", "finished_at")


@query
def k7_feature_snapshots(t: StandIn) -> DataFrame:
    """Latest unexpired snapshot of district prices, written for two dates."""
    import datetime as dt

    now = dt.datetime(2001, 6, 30, 12)
    base = t.official_land_prices.select(
        F.col("pnu").alias("entity_id"), F.make_date("year", F.lit(12), F.lit(31)).alias("snapshot_date"),
        F.create_map(F.lit("price"), F.col("price_per_m2").cast("double")).alias("features"))
    stored = sinks.feature_snapshots(base.filter(F.year("snapshot_date") < 2000), "parcel", "v1", now).unionByName(
        sinks.feature_snapshots(base.filter(F.year("snapshot_date") >= 2000), "parcel", "v1", now, ttl_hours=-1))
    wanted = t.buildings.select(F.lit("parcel").alias("entity_type"), F.col("pnu").alias("entity_id"))
    return sinks.get_features(stored, wanted, now).select(
        "entity_id", "snapshot_date", F.col("features")["price"].alias("price"))


@query
def u2_j16_region_labels(t: StandIn) -> DataFrame:
    """Distinct region codes of stores, parcels and roads with their names."""
    codes = t.stores.select("region_code").union(t.buildings.select("region_code")).union(
        t.road_segments.select("region_code")).distinct()
    return codes.join(t.admin_areas.select(F.col("code").alias("region_code"), "name"), "region_code", "left")
