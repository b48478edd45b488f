"""Table schemas, natural keys and enumerations of the domain."""

from __future__ import annotations

from pyspark.sql import types as T

POINT = [("lon", T.DoubleType()), ("lat", T.DoubleType())]
VERTICES = T.ArrayType(T.StructType([T.StructField(n, t) for n, t in POINT]))
RINGS = T.ArrayType(VERTICES)  # outer rings and holes of all parts of a shape
S, L, I, D, B = T.StringType(), T.LongType(), T.IntegerType(), T.DateType(), T.DoubleType()
_MAP = T.MapType(S, B)


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


SCHEMAS: dict[str, T.StructType] = {
    "admin_areas": _schema(("code", S), ("name", S), ("level", S), ("parent_code", S), *POINT),
    "projects": _schema(
        ("id", L), ("name", S), ("project_type", S), ("region_code", S), ("polygon", RINGS), *POINT,
        ("area_ha", T.DecimalType(10, 2)), ("expected_compensation_billion_krw", T.DecimalType(12, 2)),
        ("planned_announcement_date", D), ("planned_completion_date", D)),
    "project_stages": _schema(("project_id", L), ("stage", S), ("occurred_at", D), ("sequence_no", I)),
    "land_transactions": _schema(
        ("source_id", S), ("source", S), ("region_code", S), ("pnu", S), ("address", S), *POINT,
        ("transaction_type", S), ("contract_date", D), ("deal_amount_krw", L),
        ("area_m2", T.DecimalType(12, 2)), ("use_district", S), ("raw_data", S)),
    "road_segments": _schema(
        ("id", L), ("name", S), ("route_no", S), ("region_code", S), ("line", VERTICES),
        ("length_m", T.DecimalType(10, 2))),
    "road_expansion_stages": _schema(
        ("road_id", L), ("stage", S), ("occurred_at", D), ("lanes_before", I), ("lanes_after", I),
        ("width_before_m", T.DecimalType(6, 2)), ("width_after_m", T.DecimalType(6, 2))),
    "traffic_volumes": _schema(
        ("road_id", L), ("observed_at", D), ("aadt", L), ("peak_hour_volume", L),
        ("heavy_vehicle_pct", T.DecimalType(5, 2))),
    "population_stats": _schema(
        ("region_code", S), ("observed_at", D), ("total_population", L), ("male_population", L),
        ("female_population", L), ("household_count", L), ("avg_age", T.DecimalType(5, 2)),
        ("source", S), ("raw_data", S)),
    "store_brands": _schema(("id", L), ("name", S), ("category", S)),
    "stores": _schema(
        ("id", L), ("brand_id", L), ("source_id", S), ("source_url", S), ("name", S), ("address", S),
        ("region_code", S), *POINT, ("pnu", S), ("store_type", S), ("opened_at", D), ("closed_at", D),
        ("land_area_m2", T.DecimalType(12, 2)), ("building_area_m2", T.DecimalType(12, 2)), ("raw_data", S)),
    "buildings": _schema(
        ("pnu", S), ("region_code", S), ("address", S), ("parcel_area_m2", T.DecimalType(12, 2)),
        ("building_area_m2", T.DecimalType(12, 2)), ("total_floor_area_m2", T.DecimalType(12, 2)),
        ("floors_above", I), ("floors_below", I), ("use_type", S), ("structure", S),
        ("approval_date", D), ("polygon", VERTICES), ("raw_data", S)),
    "official_land_prices": _schema(
        ("pnu", S), ("year", I), ("price_per_m2", L), ("change_rate", T.DecimalType(7, 4)), ("raw_data", S)),
    "store_features": _schema(
        ("entity_type", S), ("entity_id", S), ("snapshot_date", D), ("version", S),
        ("features", _MAP), ("expires_at", T.TimestampType())),
    "candidate_lands": _schema(
        ("pnu", S), ("model_name", S), ("model_version", S), ("evaluated_at", D),
        ("suitability_score", B), ("breakdown", S)),
    "store_impact_analysis": _schema(
        ("store_id", L), ("band_m", I), ("horizon", S), ("pre_avg", B), ("post_avg", B),
        ("sample_pre", L), ("sample_post", L), ("halo_pct", B), ("post_window_end", D)),
    "analysis_results": _schema(
        ("scenario", S), ("entity_type", S), ("entity_id", S), ("params_hash", S), ("params", S),
        ("result", S), ("status", S), ("finished_at", T.TimestampType())),
    "recommendations": _schema(
        ("source_entity_type", S), ("source_entity_id", S), ("target_entity_type", S),
        ("target_entity_id", S), ("score", B), ("rank", I), ("model_version", S)),
}

KEYS: dict[str, list[str]] = {
    "admin_areas": ["code"],
    "projects": ["name", "project_type"],
    "project_stages": ["project_id", "stage", "occurred_at"],
    "land_transactions": ["source_id"],
    "road_segments": ["name", "route_no"],
    "road_expansion_stages": ["road_id", "stage", "occurred_at"],
    "traffic_volumes": ["road_id", "observed_at"],
    "population_stats": ["region_code", "observed_at"],
    "store_brands": ["name"],
    "stores": ["brand_id", "source_id"],
    "buildings": ["pnu"],
    "official_land_prices": ["pnu", "year"],
    "store_features": ["entity_type", "entity_id", "snapshot_date", "version"],
    "candidate_lands": ["pnu", "model_name", "model_version", "evaluated_at"],
    "store_impact_analysis": ["store_id", "band_m", "horizon", "post_window_end"],
    "analysis_results": ["scenario", "entity_type", "entity_id", "params_hash"],
    "recommendations": [
        "source_entity_type", "source_entity_id", "target_entity_type", "target_entity_id", "model_version"],
}

# Partitions of the stored tables, as SQL over key columns. Sales arrive by month but are keyed by a digest: its
# first digits spread them evenly, and new sales are added without rewriting stored ones.
PARTITIONS: dict[str, str] = {
    "land_transactions": "substring(source_id, 1, 1)",
    "traffic_volumes": "year(observed_at)",
    "population_stats": "year(observed_at)",
    "stores": "brand_id",
    "buildings": "substring(pnu, 1, 5)",
    "official_land_prices": "year",
    "store_features": "year(snapshot_date)",
    "candidate_lands": "evaluated_at",
    "store_impact_analysis": "year(post_window_end)",
    "analysis_results": "scenario",
    "recommendations": "source_entity_type",
}

# Columns an upsert overwrites when the key exists; everything else keeps the stored value.
UPDATABLE: dict[str, list[str]] = {
    "land_transactions": ["deal_amount_krw", "area_m2", "use_district", "raw_data"],
    "population_stats": [
        "total_population", "male_population", "female_population", "household_count", "avg_age", "raw_data"],
    "official_land_prices": ["price_per_m2", "change_rate", "raw_data"],
    "buildings": ["address", "use_type", "approval_date", "raw_data"],
    "stores": ["name", "address", "lon", "lat", "store_type", "raw_data"],
    "analysis_results": ["result", "status", "finished_at"],
}

# Permitted enumeration members.
ENUMS: dict[str, list[str]] = {
    "project_type": ["public_housing", "urban_development", "industrial_complex", "logistics", "new_town", "other"],
    "project_stage": [
        "planned", "announced", "designated", "compensation_planned", "compensation_started",
        "relocation_complete", "ground_break", "under_construction", "completion"],
    "admin_level": ["sido", "sigungu", "eupmyeondong"],
    "transaction_type": ["land", "apartment", "officetel", "single_house", "commercial", "other"],
    "road_stage": ["planned", "design", "under_construction", "completed"],
    "store_type": ["DT", "DI", "standard", "kiosk"],
    "brand_category": ["cafe", "fastfood", "bakery", "convenience", "other"],
    "scenario": ["a", "b", "c"],
    "status": ["queued", "running", "completed", "failed"],
}

# Share of a road expansion done at each stage.
STAGE_PROGRESS = {"planned": 0.10, "design": 0.30, "under_construction": 0.60, "completed": 1.00}
