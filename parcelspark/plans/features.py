"""The 25-value feature row for stores, parcels and plain locations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelspark.functions.numbers import change, round_even, round_up
from parcelspark.operators import timeseries as ts
from parcelspark.operators.discs import disc_sums
from parcelspark.operators.spatial import nearest_line, point_pairs
from parcelspark.plans.views import with_prefixes
from parcelspark.session import cut_lineage

# Feature order is part of the model contract.
FEATURE_NAMES = [
    "land_area_m2", "building_area_m2", "floor_area_ratio", "land_price_per_m2", "land_price_yoy",
    "land_price_5y_growth", "is_commercial_zone", "is_corner_lot",
    "population_within_1km", "population_within_3km", "household_count_within_1km",
    "competitor_count_within_1km", "competitor_count_within_500m", "same_brand_count_within_3km",
    "transit_score_500m", "office_count_within_1km",
    "nearby_road_expansion", "nearby_new_town", "subway_extension_planned",
    "population_growth_3y_pct", "transaction_count_growth_3y",
    "distance_to_nearest_road_m", "aadt_nearest_road", "elevation_relative", "drive_thru_accessible",
]
CATALYSTS = [
    "nearby_road_expansion", "nearby_new_town", "subway_extension_planned",
    "population_growth_3y_pct", "transaction_count_growth_3y",
]
# Columns of the contract for which no source exists; they stay 0.
UNFILLED = [
    "is_commercial_zone", "is_corner_lot", "transit_score_500m", "office_count_within_1km",
    "subway_extension_planned", "elevation_relative",
]
NO_ROAD_M = 9999.0
ENTITY_COLUMNS = [
    "entity_id", "pnu", "lon", "lat", "region_code", "snapshot_date", "owner_store_id", "brand",
    "land_area_m2", "building_area_m2",
]


def store_entities(stores: DataFrame, as_of: dt.date, snapshot: dt.date | None = None) -> DataFrame:
    """Stores at their opening date, or all at one ``snapshot``."""
    snap = F.lit(snapshot) if snapshot else F.coalesce("opened_at", F.lit(as_of))
    return stores.select(
        F.concat(F.lit("store:"), F.col("id").cast("string")).alias("entity_id"), "pnu", "lon", "lat", "region_code",
        snap.alias("snapshot_date"), F.col("id").alias("owner_store_id"), "brand", "land_area_m2", "building_area_m2")


def parcel_entities(buildings: DataFrame, as_of: dt.date) -> DataFrame:
    return buildings.select(
        F.concat(F.lit("parcel:"), "pnu").alias("entity_id"), "pnu", "lon", "lat", "region_code",
        F.lit(as_of).alias("snapshot_date"), F.lit(None).cast("bigint").alias("owner_store_id"),
        F.lit(None).cast("string").alias("brand"),
        F.coalesce(F.col("parcel_area_m2").cast("double"), F.lit(0.0)).alias("land_area_m2"),
        F.coalesce(F.col("building_area_m2").cast("double"), F.lit(0.0)).alias("building_area_m2"))


def location_entities(points: DataFrame, as_of: dt.date, key: str) -> DataFrame:
    """Plain coordinates: no parcel, no region, no areas."""
    text = F.lit(None).cast("string")
    return points.select(
        F.concat(F.lit("point:"), F.col(key).cast("string")).alias("entity_id"), text.alias("pnu"), "lon", "lat",
        text.alias("region_code"), F.lit(as_of).alias("snapshot_date"),
        F.lit(None).cast("bigint").alias("owner_store_id"), text.alias("brand"),
        F.lit(0.0).alias("land_area_m2"), F.lit(0.0).alias("building_area_m2"))


def _queries(entities: DataFrame, *extra: str) -> DataFrame:
    return entities.select(
        "entity_id", F.col("lon").alias("q_lon"), F.col("lat").alias("q_lat"), *extra)


def competitor_counts(entities: DataFrame, stores: DataFrame) -> DataFrame:
    """Stores within 500 m and 1 km and of the same brand within 3 km.

    Stores at one spot are counted before the join, and circles are summed up without pairs (``disc_sums``); only an entity
    without a store in these is searched for any within 3 km, which gives it a row of zeros. An entity that is itself a
    store stands at distance zero, so leaving it out is a subtraction.
    """
    spots = stores.groupBy("lon", "lat", F.col("brand").alias("spot_brand")).agg(F.count("*").alias("n"))
    own = F.when(F.col("owner_store_id").isNotNull(), F.lit(1)).otherwise(F.lit(0))
    queries = _queries(entities, "brand", own.alias("own"))
    zero = F.lit(0).cast("bigint")
    counts = ["c1", "c5", "sb"]
    near = disc_sums(queries.drop("brand"), spots.drop("spot_brand"), {"c1": 1000.0, "c5": 500.0}, "n").withColumn("sb", zero)
    alike = disc_sums(
        queries.filter("brand is not null"), spots.filter("spot_brand is not null"), {"sb": 3000.0}, "n", ("brand", "spot_brand"))
    alike = alike.select("entity_id", "own", zero.alias("c1"), zero.alias("c5"), "sb")
    found = cut_lineage(near.select("entity_id", "own", *counts).unionByName(alike).groupBy("entity_id", "own").agg(
        *[F.sum(c).alias(c) for c in counts]))
    known = found.select(F.col("entity_id").alias("known_id"), F.col("own").alias("known_own"))
    others = queries.drop("brand").join(
        known, F.col("entity_id").eqNullSafe(F.col("known_id")) & (F.col("own") == F.col("known_own")), "left_anti")
    far = point_pairs(others, spots.select("lon", "lat").distinct(), 3000.0).select(
        "entity_id", "own", *[zero.alias(c) for c in counts]).distinct()
    return found.unionByName(far).select(
        "entity_id", (F.col("c1") - F.col("own")).cast("double").alias("competitor_count_within_1km"),
        (F.col("c5") - F.col("own")).cast("double").alias("competitor_count_within_500m"),
        (F.col("sb") - F.col("own")).cast("double").alias("same_brand_count_within_3km"))


def population_windows(population: DataFrame, snapshots: DataFrame, mode: str = "sum") -> DataFrame:
    """Population per region in the 90 days up to each distinct snapshot.

    ``mode='sum'`` adds every observation in the window, about three monthly
    rows; ``mode='latest'`` takes the newest one.
    """
    month = F.trunc("observed_at", "month")
    span = F.sequence(
        F.trunc(F.date_sub("snapshot_date", 90), "month"), F.trunc("snapshot_date", "month"), F.expr("interval 1 month"))
    dates = snapshots.select("snapshot_date").distinct().withColumn("_month", F.explode(span))
    met = (
        population.select("region_code", "observed_at", "total_population", "household_count", month.alias("_month"))
        .join(dates, "_month")
        .filter((F.col("observed_at") <= F.col("snapshot_date")) & (F.col("observed_at") >= F.date_sub("snapshot_date", 90))))
    take = F.sum if mode == "sum" else (lambda c: F.max_by(c, "observed_at"))
    return met.groupBy("region_code", "snapshot_date").agg(
        take("total_population").alias("people"), take("household_count").alias("households"))


def population_around(entities: DataFrame, admin_areas: DataFrame, population: DataFrame, mode: str = "sum") -> DataFrame:
    windows = population_windows(population, entities, mode).withColumnRenamed("region_code", "code")
    centroids = admin_areas.select("code", "lon", "lat")
    met = point_pairs(_queries(entities, "snapshot_date"), centroids, 3000.0).join(windows, ["code", "snapshot_date"])
    near = F.col("distance_m") <= 1000
    return met.groupBy("entity_id").agg(
        F.coalesce(F.sum(F.when(near, F.col("people"))), F.lit(0)).cast("double").alias("population_within_1km"),
        F.sum("people").cast("double").alias("population_within_3km"),
        F.coalesce(F.sum(F.when(near, F.col("households"))), F.lit(0)).cast("double").alias("household_count_within_1km"))


def road_traffic(traffic: DataFrame, as_of: dt.date) -> DataFrame:
    """Average traffic of the last twelve months per road."""
    recent = traffic.filter(F.col("observed_at") >= F.add_months(F.lit(as_of), -12))
    return recent.groupBy("road_id").agg(round_up(F.avg("aadt")).cast("double").alias("aadt"))


def nearest_road(
    entities: DataFrame, roads: DataFrame, traffic: DataFrame, as_of: dt.date, metric: str = "degree"
) -> DataFrame:
    lines = roads.select(F.col("id").alias("road_id"), "line")
    hit = nearest_line(entities, lines, "entity_id", "road_id", metric=metric)
    return hit.join(road_traffic(traffic, as_of), "road_id", "left").select(
        "entity_id", F.col("road_id").alias("nearest_road_id"),
        F.coalesce(F.nullif("distance_m", F.lit(0.0)), F.lit(NO_ROAD_M)).alias("distance_to_nearest_road_m"),
        F.coalesce("aadt", F.lit(0.0)).alias("aadt_nearest_road"))


def population_growth(pairs: DataFrame, population: DataFrame) -> DataFrame:
    """Smallest value 36-30 months ago against the largest of the last six, per
    (region, snapshot)."""
    date, snap = F.col("observed_at"), F.col("snapshot_date")
    old = date.between(F.add_months(snap, -36), F.add_months(snap, -30))
    new = date.between(F.add_months(snap, -6), snap)
    met = pairs.join(population.select("region_code", "observed_at", "total_population"), "region_code").filter(old | new)
    return met.groupBy("region_code", "snapshot_date").agg(
        F.min(F.when(old, F.col("total_population"))).alias("before"),
        F.max(F.when(new, F.col("total_population"))).alias("now"),
    ).select(
        "region_code", "snapshot_date",
        F.when(F.col("now") != 0, round_even(change("now", "before"), 4)).alias("population_growth_3y_pct"))


def recent_stage_count(
    pairs: DataFrame, entities: DataFrame, stages: DataFrame, key: str, kinds: list[str], months: int, name: str
) -> DataFrame:
    """Stages of some kinds in a region since ``months`` before each snapshot."""
    dated = (
        stages.filter(F.col("stage").isin(kinds)).join(entities.select(F.col("id").alias(key), "region_code"), key)
        .groupBy("region_code", "occurred_at").agg(F.count("*").alias("n")))
    met = pairs.join(dated, "region_code").filter(
        F.col("occurred_at") >= F.add_months("snapshot_date", -months))
    return met.groupBy("region_code", "snapshot_date").agg(F.sum("n").cast("double").alias(name))


def sales_growth(pairs: DataFrame, sales: DataFrame) -> DataFrame:
    """Sales of the last twelve months against the twelve from 1080 days ago.

    Day counts are swept once into running totals per region, and each window is
    a difference of two of them: linear in days plus snapshots, instead of one
    row per snapshot and day.
    """
    daily = sales.groupBy("region_code", F.col("contract_date").alias("day")).agg(F.count("*").alias("n"))
    cutoff = F.date_sub("snapshot_date", 1080)
    marks = F.array(
        F.struct(F.lit("new_hi").alias("mark"), F.col("snapshot_date").alias("day")),
        F.struct(F.lit("new_lo").alias("mark"), F.date_sub(F.add_months("snapshot_date", -12), 1).alias("day")),
        F.struct(F.lit("old_hi").alias("mark"), F.date_sub(F.add_months(cutoff, 12), 1).alias("day")),
        F.struct(F.lit("old_lo").alias("mark"), F.date_sub(cutoff, 1).alias("day")))
    probes = pairs.select("region_code", "snapshot_date", F.explode(marks).alias("m")).select(
        "region_code", "snapshot_date", "m.mark", "m.day", F.lit(0).cast("bigint").alias("n"))
    running = Window.partitionBy("region_code").orderBy("day").rangeBetween(Window.unboundedPreceding, 0)
    swept = probes.unionByName(daily, allowMissingColumns=True).withColumn("total", F.sum("n").over(running))
    at = lambda mark: F.max(F.when(F.col("mark") == mark, F.col("total")))
    return (
        swept.filter(F.col("mark").isNotNull()).groupBy("region_code", "snapshot_date")
        .agg((at("new_hi") - at("new_lo")).alias("new_n"), (at("old_hi") - at("old_lo")).alias("old_n"))
        .select("region_code", "snapshot_date", "new_n", "old_n",
                round_even(change("new_n", "old_n"), 4).alias("transaction_count_growth_3y")))


def catalysts(
    pairs: DataFrame, population: DataFrame, roads: DataFrame, road_stages: DataFrame,
    projects: DataFrame, project_stages: DataFrame, sales: DataFrame, region_match: str = "equal",
) -> DataFrame:
    """Five growth signals per distinct (region, snapshot)."""
    pairs = pairs.select("region_code", "snapshot_date").filter(F.col("region_code").isNotNull()).distinct()
    people = with_prefixes(population, pairs) if region_match == "prefix" else population
    keys = ["region_code", "snapshot_date"]
    out = (
        pairs.join(population_growth(pairs, people), keys, "left")
        .join(recent_stage_count(pairs, roads, road_stages, "road_id", ["completed"], 36, "nearby_road_expansion"), keys, "left")
        .join(recent_stage_count(pairs, projects, project_stages, "project_id", ["designated", "announced"], 60, "nearby_new_town"), keys, "left")
        .join(sales_growth(pairs, sales).drop("new_n", "old_n"), keys, "left"))
    return out.select(*keys, *[
        F.lit(0.0).alias(c) if c in UNFILLED else F.coalesce(c, F.lit(0.0)).alias(c) for c in CATALYSTS])


def extract_features(
    entities: DataFrame, domain, as_of: dt.date, region_match: str = "equal",
    population_mode: str = "sum", metric: str = "degree",
) -> DataFrame:
    """All 25 features of every entity in one plan.

    ``domain`` is any object with the domain tables as attributes.
    """
    prices = ts.price_change(domain.official_land_prices).drop("n_years")
    signals = catalysts(
        entities, domain.population_stats, domain.road_segments, domain.road_expansion_stages,
        domain.projects, domain.project_stages, domain.land_transactions, region_match)
    joined = (
        entities.join(prices, "pnu", "left")
        .join(competitor_counts(entities, domain.stores), "entity_id", "left")
        .join(population_around(entities, domain.admin_areas, domain.population_stats, population_mode), "entity_id", "left")
        .join(nearest_road(entities, domain.road_segments, domain.traffic_volumes, as_of, metric), "entity_id", "left")
        .join(signals, ["region_code", "snapshot_date"], "left"))
    land = F.coalesce(F.col("land_area_m2").cast("double"), F.lit(0.0))
    built = F.coalesce(F.col("building_area_m2").cast("double"), F.lit(0.0))
    has_point = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    road = F.when(has_point, F.coalesce("distance_to_nearest_road_m", F.lit(NO_ROAD_M))).otherwise(F.lit(0.0))
    share = built / F.nullif(land, F.lit(0.0))
    computed = {
        "land_area_m2": land, "building_area_m2": built,
        "floor_area_ratio": F.coalesce(round_even(share, 4), F.lit(0.0)),
        "distance_to_nearest_road_m": road,
        "drive_thru_accessible": F.when((built != 0) & (share < 0.7) & (road < 200), F.lit(1.0)).otherwise(F.lit(0.0)),
    }
    columns = []
    for name in FEATURE_NAMES:
        if name in computed:
            columns.append(computed[name].alias(name))
        elif name in UNFILLED:
            columns.append(F.lit(0.0).alias(name))
        else:
            columns.append(F.coalesce(F.col(name), F.lit(0.0)).alias(name))
    return joined.select("entity_id", "pnu", "region_code", "snapshot_date", "owner_store_id", *columns)


def feature_map(features: DataFrame) -> DataFrame:
    """Feature row as a map, the shape of the snapshot table."""
    pairs = [x for n in FEATURE_NAMES for x in (F.lit(n), F.col(n))]
    return features.select("entity_id", "snapshot_date", F.create_map(*pairs).alias("features"))
