"""Listings, records and the three standing views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.functions.numbers import percent_change, round_up
from parcelspark.operators.covers import area_point_pairs


def optional_filters(
    df: DataFrame, equals: dict[str, object] | None = None,
    start: dt.date | None = None, end: dt.date | None = None, date: str = "observed_at",
) -> DataFrame:
    """Apply only the conditions that were given; they reach the scan."""
    for name, value in (equals or {}).items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end))
    return df


def page(df: DataFrame, order: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """One ordered page; ``limit`` is bounded to 1..200 as in the service."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset >= 0")
    return df.orderBy(order).offset(offset).limit(limit)


def with_stage_count(entities: DataFrame, stages: DataFrame, stage_key: str, key: str = "id") -> DataFrame:
    counts = stages.groupBy(F.col(stage_key).alias(key)).agg(F.count("*").alias("stage_count"))
    return entities.join(counts, key, "left").withColumn("stage_count", F.coalesce("stage_count", F.lit(0)))


def list_projects(projects: DataFrame, stages: DataFrame, region_code: str | None = None) -> DataFrame:
    listed = with_stage_count(optional_filters(projects, {"region_code": region_code}), stages, "project_id")
    return listed.select(
        "id", "name", "project_type", "region_code", F.col("area_ha").cast("double").alias("area_ha"),
        F.col("expected_compensation_billion_krw").cast("double").alias("expected_compensation_billion_krw"),
        "planned_announcement_date", "planned_completion_date", "stage_count")


def list_roads(roads: DataFrame, stages: DataFrame, region_code: str | None = None) -> DataFrame:
    listed = with_stage_count(optional_filters(roads, {"region_code": region_code}), stages, "road_id")
    return listed.select(
        "id", "name", "route_no", "region_code", F.col("length_m").cast("double").alias("length_m"), "stage_count")


def list_stores(
    stores: DataFrame, brands: DataFrame, brand: str | None = None,
    store_type: str | None = None, region_code: str | None = None,
) -> DataFrame:
    kept = optional_filters(stores, {"brand": brand, "store_type": store_type, "region_code": region_code})
    names = brands.select(F.col("name").alias("brand"), F.col("category").alias("brand_category"))
    return kept.join(names, "brand").select(
        "id", "name", "address", "region_code", "pnu", "store_type", "opened_at", "closed_at",
        F.col("land_area_m2").cast("double").alias("land_area_m2"),
        F.col("building_area_m2").cast("double").alias("building_area_m2"),
        F.col("brand").alias("brand_name"), "brand_category", "lon", "lat")


def with_stages(entities: DataFrame, stages: DataFrame, stage_key: str, fields: list[str], key: str = "id") -> DataFrame:
    """Record with its ordered stages; a lifecycle has a handful of stages."""
    ordered = F.array_sort(F.collect_list(F.struct("occurred_at", *[f for f in fields if f != "occurred_at"])))
    grouped = stages.groupBy(F.col(stage_key).alias(key)).agg(ordered.alias("stages"))
    return entities.join(grouped, key, "left")


def anchor_dates(projects: DataFrame, stages: DataFrame) -> DataFrame:
    """Compensation start per project, else the planned announcement."""
    first = (
        stages.filter(F.col("stage") == "compensation_started")
        .groupBy(F.col("project_id").alias("id")).agg(F.min("occurred_at").alias("started")))
    return projects.join(first, "id", "left").select(
        F.col("id").alias("project_id"), "name", "project_type",
        F.coalesce("started", "planned_announcement_date").alias("anchor_date"))


def project_nearby_sales(projects: DataFrame, sales: DataFrame, radius_m: float = 5000.0, carry: tuple[str, ...] = ()) -> DataFrame:
    """Sales in reach of each project; ``carry`` names further project columns to keep."""
    areas = projects.select(
        F.col("id").alias("project_id"), F.col("name").alias("project_name"), "project_type", "polygon", *carry)
    points = sales.select(
        "source_id", "contract_date", "deal_amount_krw", "area_m2", "transaction_type", "lon", "lat")
    return area_point_pairs(areas, points, radius_m, "source_id")


def yearly_traffic(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy("road_id", F.trunc("observed_at", "year").alias("year_start")).agg(
        round_up(F.avg("aadt")).alias("avg_aadt"), F.max("peak_hour_volume").alias("peak_volume"),
        F.count("*").alias("sample_size"))


def road_yearly_metrics(traffic: DataFrame, roads: DataFrame, population: DataFrame, region_match: str = "equal") -> DataFrame:
    """Yearly traffic beside yearly population, either side may be missing.

    Population is averaged per region and year once and then fanned out to the
    region's roads. ``region_match='prefix'`` bridges the 5/10 digit code gap.
    """
    year = F.trunc("observed_at", "year").alias("year_start")
    codes = roads.select(F.col("id").alias("road_id"), "region_code")
    stats = population
    if region_match == "prefix":
        stats = with_prefixes(population, codes)
    yearly = stats.groupBy("region_code", year).agg(
        round_up(F.avg("total_population")).alias("avg_population"),
        round_up(F.avg("household_count")).alias("avg_households"))
    people = codes.join(yearly, "region_code").drop("region_code")
    return yearly_traffic(traffic).drop("sample_size").join(people, ["road_id", "year_start"], "full")


def with_prefixes(population: DataFrame, codes: DataFrame) -> DataFrame:
    """Population rows relabelled with every road region code they start with.

    A derived key turns the ``LIKE code || '%'`` nested loop into a hash join;
    the wanted codes are few, so most prefixes vanish before any shuffle.
    """
    wanted = codes.select("region_code").distinct()
    prefix = F.explode(F.transform(
        F.sequence(F.lit(1), F.length("region_code")), lambda n: F.substring(F.col("region_code"), F.lit(1), n)))
    return population.withColumn("region_code", prefix).join(wanted, "region_code", "left_semi")


def price_series(prices: DataFrame) -> DataFrame:
    """Year-to-price series per parcel with first and last values (one row per year)."""
    pair = F.struct(F.col("year").alias("year"), F.col("price_per_m2").alias("price"))
    return prices.groupBy("pnu").agg(
        F.array_sort(F.collect_list(pair)).alias("series"),
        F.min("year").alias("first_year"), F.max("year").alias("latest_year"),
        F.min_by("price_per_m2", "year").alias("earliest_price"), F.max_by("price_per_m2", "year").alias("latest_price"))


def series_text(series: Column) -> Column:
    return F.concat_ws("|", F.transform(
        series, lambda s: F.concat_ws(":", s["year"].cast("string"), s["price"].cast("string"))))


def store_full_profile(stores: DataFrame, brands: DataFrame, buildings: DataFrame, prices: DataFrame) -> DataFrame:
    brand = brands.select(F.col("name").alias("brand"), F.col("category").alias("brand_category"))
    parcel = buildings.select("pnu", "use_type", "approval_date", "total_floor_area_m2")
    return (
        stores.join(brand, "brand").join(parcel, "pnu", "left").join(price_series(prices), "pnu", "left")
        .select(
            F.col("id").alias("store_id"), F.col("name").alias("store_name"), "store_type",
            F.col("brand").alias("brand_name"), "brand_category", "address", "lon", "lat", "pnu", "opened_at",
            "land_area_m2", "building_area_m2", "use_type", "approval_date", "total_floor_area_m2",
            F.map_from_entries("series").alias("price_by_year"), series_text(F.col("series")).alias("price_series"),
            "first_year", "latest_year", "earliest_price", "latest_price",
            percent_change("latest_price", "earliest_price").alias("price_change_pct")))


def rationales_by_category(rationales: DataFrame, key: str) -> DataFrame:
    """Bullets grouped for display; the per-category cap bounds each list."""
    ordered = F.array_sort(F.collect_list(F.struct("rule_no", "impact", "feature", "detail")))
    return rationales.groupBy(key, "category").agg(ordered.alias("items"))


def factor_chart(factors: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Bars of the factor chart: contribution, else value, else 0; first ``limit``
    by position, drawn by magnitude."""
    from pyspark.sql import Window

    size = F.coalesce("contribution", "value", F.lit(0.0))
    first = factors.filter(F.col("position") <= limit).withColumn("bar", size)
    order = Window.partitionBy(key).orderBy(F.abs("bar").desc(), "position")
    return first.withColumn("bar_no", F.row_number().over(order))
