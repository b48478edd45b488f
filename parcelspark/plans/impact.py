"""Development projects: zone, roads, uplift samples, decay fit and forecast grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.functions.numbers import clip, round_even, saturating
from parcelspark.operators.skew import grouped_median, salted_join
from parcelspark.operators.covers import area_line_pairs, area_point_pairs
from parcelspark.plans.views import anchor_dates, project_nearby_sales
from parcelspark.session import cut_lineage

# Default surface, calibration bands and grids.
DEFAULT_A, DEFAULT_B = 0.20, 0.30
TIME_KNOTS = [-12, 0, 24, 60]
DEFAULT_MULTIPLIERS = [0.20, 0.55, 1.00, 1.10]
BANDS = [(-24, -3), (-3, 12), (12, 36), (36, 84)]
DISTANCES_M = [0, 250, 500, 1000, 2000, 3000]
HORIZONS_MONTHS = [-12, 0, 12, 24, 36, 60]
ROUTE_WEIGHTS = [("고속", 1.0), ("국도", 0.8), ("지방도", 0.6), ("시도", 0.4)]
OTHER_ROUTE_WEIGHT = 0.5
MODEL_VERSION = "scenario_a_v1.0.0"
SMALL_SET_NOTE = "Reference set too small (<2 projects) — using calibrated defaults."
RMSE_NOTE = "Training RMSE: %.4f"
# Own text, for types whose projects have too few samples for a fit.
FEW_SAMPLES_NOTE = "Too few samples (<6) — using calibrated defaults."


def impact_zone(projects: DataFrame, admin_areas: DataFrame, radius_m: float = 5000.0) -> DataFrame:
    """Admin centroids in reach of each project, nearest first by ``zone_rank``."""
    from pyspark.sql import Window

    areas = projects.select(F.col("id").alias("project_id"), "polygon")
    centroids = admin_areas.select(F.col("code").alias("admin_code"), F.col("name").alias("admin_name"), "lon", "lat")
    order = Window.partitionBy("project_id").orderBy("distance_m", "admin_code")
    return (
        area_point_pairs(areas, centroids, radius_m, "admin_code")
        .withColumn("zone_rank", F.row_number().over(order)))


def route_weight(route_no: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(0.0))
    for word, weight in ROUTE_WEIGHTS:
        expr = expr.when(route_no.contains(word), F.lit(weight))
    return expr.otherwise(F.lit(OTHER_ROUTE_WEIGHT))


def road_score(route_no: Column, distance_m: Column, length_m: Column) -> Column:
    near = F.greatest(F.lit(0.0), F.lit(1.0) - distance_m / F.lit(3000.0))
    length = F.least(F.coalesce(length_m.cast("double"), F.lit(0.0)) / F.lit(5000.0), F.lit(1.0))
    return round_even(route_weight(route_no) * (F.lit(0.5) * near + F.lit(0.5) * length), 3)


def road_impact(projects: DataFrame, roads: DataFrame, radius_m: float = 3000.0) -> DataFrame:
    areas = projects.select(F.col("id").alias("project_id"), "polygon")
    lines = roads.select(F.col("id").alias("road_id"), "name", "route_no", "length_m", "line")
    pairs = area_line_pairs(areas, lines, radius_m, "project_id", "road_id").drop("polygon", "line")
    return pairs.withColumn("weight", road_score(F.col("route_no"), F.col("distance_m"), F.col("length_m")))


def uplift_samples(projects: DataFrame, stages: DataFrame, sales: DataFrame, window_days: int = 365, with_ids: bool = True) -> DataFrame:
    """Post-anchor sales against the median unit price of the year before.

    A project's anchor travels with its shape, so it needs no join with the sales; the sales in reach are found once
    and stored. Sales before the window of the earliest anchor are left out at once. The median comes from bucket counts, and is
    looked up by salted parts of a project with many sales; it is stored, a row per project, so a small table of them goes to the sales. Without ``with_ids`` samples have no ``source_id``,
    which is most of a stored row.
    """
    anchors = cut_lineage(anchor_dates(projects, stages).filter(F.col("anchor_date").isNotNull()).select(F.col("project_id").alias("id"), "anchor_date"))
    date, anchor = F.col("contract_date"), F.col("anchor_date")
    ids = ["source_id"] if with_ids else []
    recent = sales.filter(date >= F.date_sub(anchors.agg(F.min("anchor_date")).scalar(), window_days))
    near = cut_lineage(
        project_nearby_sales(projects.join(anchors, "id"), recent, carry=("anchor_date",))
        .filter(date >= F.date_sub(anchor, window_days))
        .select("project_id", "project_type", *ids, "contract_date", "anchor_date", "distance_m",
                (F.col("deal_amount_krw").cast("double") / F.nullif(F.col("area_m2").cast("double"), F.lit(0.0))).alias("unit_price")))
    base = cut_lineage(grouped_median(near.filter(date < anchor), ["project_id"], "unit_price", "base").filter(F.col("base") > 0))
    later = near.filter((date >= anchor) & F.col("unit_price").isNotNull())
    counts = cut_lineage(later.groupBy("project_id").agg(F.count("*").alias("_n")))
    months = (F.year(date) - F.year(anchor)) * 12 + F.month(date) - F.month(anchor)
    return (
        salted_join(later, base, ["project_id"], ["contract_date", "distance_m", "unit_price"], counts=counts)
        .select(
            "project_id", "project_type", *ids, "distance_m", "base", months.alias("months_since_anchor"),
            ((F.col("unit_price") - F.col("base")) / F.col("base")).alias("uplift_pct"), F.lit(1.0).alias("weight")))


# Sums that stand for the samples of a distance bin, exact to a term of order 5 in decay x half a bin width.
BIN_M, TERMS = 5.0, 5


def sufficient_sums(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted moments of the samples of each key in bins of distance: all that the decay search needs.

    A bin at c km holds Y_k = sum w^2 uplift (km - c)^k and W_k = sum w^2 (km - c)^k for k below TERMS. Samples are
    read once and folded before the shuffle; the number of bins depends on the radius, not on the samples.
    """
    w2 = F.pow(F.greatest("weight", F.lit(1e-3)), F.lit(2.0))
    binned = samples.withColumn("_bin", F.floor(F.col("distance_m") / F.lit(BIN_M))).withColumn("_w2", w2)
    offset = F.col("distance_m") / F.lit(1000.0) - (F.col("_bin") + F.lit(0.5)) * F.lit(BIN_M / 1000.0)
    binned = binned.withColumn("_o", offset)
    powers = [F.lit(1.0)]
    for _ in range(TERMS - 1):
        powers.append(powers[-1] * F.col("_o"))
    return binned.groupBy(*keys, "_bin").agg(
        *[F.sum(F.col("_w2") * F.col("uplift_pct") * p).alias(f"_y{k}") for k, p in enumerate(powers)],
        *[F.sum(F.col("_w2") * p).alias(f"_w{k}") for k, p in enumerate(powers)])


def _grid_sums(sums: DataFrame, keys: list[str], b: Column) -> DataFrame:
    """Weighted sums ye and ee per candidate decay, from the moments of the bins."""
    centre = (F.col("_bin") + F.lit(0.5)) * F.lit(BIN_M / 1000.0)

    def series(name: str, rate: Column) -> Column:
        """sum of (-rate)^k / k! times the k-th moment, from the innermost term outwards."""
        total = F.col(f"{name}{TERMS - 1}")
        for k in range(TERMS - 1, 0, -1):
            total = F.col(f"{name}{k - 1}") - total * rate / F.lit(float(k))
        return F.exp(-rate * centre) * total

    return sums.withColumn("b", b).groupBy(*keys, "b").agg(
        F.sum(series("_y", F.col("b"))).alias("ye"), F.sum(series("_w", F.col("b") * 2.0)).alias("ee"))


def _best(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Decay with the smallest squared error, i.e. the largest explained part ye^2/ee."""
    gain = F.col("ye") * F.col("ye") / F.col("ee")
    return sums.groupBy(*keys).agg(F.max_by("b", F.struct(gain.alias("g"), (-F.col("b")).alias("nb"))).alias("centre"))


def _steps(centre: Column, half: int, step: float) -> Column:
    return F.explode(F.transform(F.sequence(F.lit(-half), F.lit(half)), lambda i: centre + i.cast("double") * F.lit(step)))


def fit_decay(samples: DataFrame, key: str) -> DataFrame:
    """Per ``key``: a and b of ``uplift = a * exp(-b * km)`` by weighted least squares.

    ``a`` is linear once ``b`` is given, so each pass sums the moments of the distance
    bins over a grid of ``b`` and the next pass zooms in twentyfold; a parabola through
    the last three values ends the search. The samples themselves are read once. Fewer than two projects or six samples keep the
    default pair, fewer than four samples in months 0..24 too.
    """
    sizes = samples.groupBy(key).agg(
        F.count("*").alias("n_samples"),
        F.sum(F.col("months_since_anchor").between(0, 24).cast("int")).alias("n_mid"))
    projects = samples.select(key, "project_id").distinct().groupBy(key).agg(F.count("*").alias("n_projects"))
    mid = cut_lineage(sufficient_sums(samples.filter(F.col("months_since_anchor").between(0, 24)), [key]))
    coarse = F.explode(F.transform(F.sequence(F.lit(0), F.lit(60)), lambda i: F.lit(-2.0) + i.cast("double") * F.lit(0.2)))
    centre = _best(_grid_sums(mid, [key], coarse), [key])
    for step in (0.01, 0.0005):
        sums = _grid_sums(mid.join(centre, key), [key, "centre"], _steps(F.col("centre"), 20, step))
        if step == 0.01:
            centre = _best(sums.drop("centre"), [key])
    last = sums.withColumn("g", F.col("ye") * F.col("ye") / F.col("ee")).groupBy(key).agg(
        F.max_by(F.struct("b", "g", "ye", "ee"), F.struct(F.col("g"), (-F.col("b")).alias("nb"))).alias("top"),
        F.array_sort(F.collect_list(F.struct("b", "g"))).alias("curve"))
    at = F.array_position(F.transform("curve", lambda c: c["b"]), F.col("top.b")).cast("int")
    g0 = F.col("top.g")
    gm, gp = F.try_element_at("curve", at - 1)["g"], F.try_element_at("curve", at + 1)["g"]
    inner = (at > 1) & (at < F.size("curve"))
    bend = gm - F.lit(2.0) * g0 + gp
    shift = F.when(inner, F.lit(0.0005 / 2.0) * (gm - gp) / F.nullif(bend, F.lit(0.0)))
    free = last.select(
        key, (F.col("top.b") + F.coalesce(shift, F.lit(0.0))).alias("b_raw"),
        (F.col("top.ye") / F.col("top.ee")).alias("a_raw"))
    enough = (F.col("n_projects") >= 2) & (F.col("n_samples") >= 6) & (F.col("n_mid") >= 4)
    return sizes.join(projects, key).join(free, key, "left").select(
        key, "n_samples", "n_projects", "n_mid",
        F.when(enough, clip("a_raw", 0.01, 1.0)).otherwise(F.lit(DEFAULT_A)).alias("a"),
        F.when(enough, clip("b_raw", 0.01, 5.0)).otherwise(F.lit(DEFAULT_B)).alias("b"))


def spatial_kernel(distance_m: Column) -> Column:
    return F.col("a") * F.exp(-F.col("b") * distance_m / F.lit(1000.0))


def band_of(months: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(0))
    for i, (low, high) in enumerate(BANDS):
        expr = expr.when((months >= low) & (months < high), F.lit(i))
    return expr


def fit_multipliers(samples: DataFrame, decay: DataFrame, key: str) -> DataFrame:
    """Median observed-to-spatial ratio per time band; an empty band gives 0.5."""
    scored = samples.join(decay.select(key, "a", "b"), key).withColumn("spatial", spatial_kernel(F.col("distance_m")))
    ratio = F.when(F.col("spatial") > 1e-6, F.col("uplift_pct") / F.col("spatial"))
    banded = scored.select(key, band_of(F.col("months_since_anchor")).alias("band"), ratio.alias("ratio"))
    medians = grouped_median(banded.filter(F.col("band").isNotNull()), [key, "band"], "ratio")
    enough = (F.col("n_projects") >= 2) & (F.col("n_samples") >= 6)
    wide = decay.join(medians.groupBy(key).agg(*[
        F.max(F.when(F.col("band") == i, F.col("median"))).alias(f"r{i}") for i in range(len(BANDS))]), key, "left")
    return wide.select(
        key, "n_samples", "n_projects", "n_mid", "a", "b", *[
            F.when(enough, clip(F.coalesce(f"r{i}", F.lit(0.5)), 0.0, 2.0)).otherwise(F.lit(default)).alias(f"m{i}")
            for i, default in enumerate(DEFAULT_MULTIPLIERS)])


def time_factor(months: Column) -> Column:
    """Straight lines between the four knots, flat outside."""
    m = months.cast("double")
    expr = F.when(m <= TIME_KNOTS[0], F.col("m0"))
    for i in range(1, len(TIME_KNOTS)):
        lo, hi = float(TIME_KNOTS[i - 1]), float(TIME_KNOTS[i])
        slope = (F.col(f"m{i}") - F.col(f"m{i-1}")) / F.lit(hi - lo)
        expr = expr.when(m <= hi, slope * (m - F.lit(lo)) + F.col(f"m{i-1}"))
    return expr.otherwise(F.col(f"m{len(TIME_KNOTS) - 1}"))


def fit_surface(samples: DataFrame, key: str) -> DataFrame:
    """Decay, time multipliers, in-sample error and confidence per ``key``.

    Runs the search when called: the samples and the few fitted rows are
    checkpointed, so that no pass repeats the spatial join.
    """
    used = dict.fromkeys([key, "project_id", "months_since_anchor", "distance_m", "uplift_pct", "weight"])
    samples = cut_lineage(samples.select(*used))  # read by every search pass
    params = cut_lineage(fit_multipliers(samples, cut_lineage(fit_decay(samples, key)), key))
    error = spatial_kernel(F.col("distance_m")) * time_factor(F.col("months_since_anchor")) - F.col("uplift_pct")
    rmse = samples.join(params, key).groupBy(key).agg(F.sqrt(F.avg(error * error)).alias("rmse"))
    fitted = (F.col("n_projects") >= 2) & (F.col("n_samples") >= 6)
    return (
        params.join(rmse, key, "left").withColumn("rmse", F.when(fitted, F.col("rmse")))
        .withColumn("confidence", saturating(F.col("n_samples"), 60, 0.40, 0.85)))


def default_surface(entities: DataFrame) -> DataFrame:
    """The unfitted surface on every row, as used before any reference exists."""
    return entities.select(
        "*", F.lit(DEFAULT_A).alias("a"), F.lit(DEFAULT_B).alias("b"),
        *[F.lit(v).alias(f"m{i}") for i, v in enumerate(DEFAULT_MULTIPLIERS)],
        F.lit(0).cast("bigint").alias("n_samples"), F.lit(0).cast("bigint").alias("n_projects"),
        F.lit(0.40).alias("confidence"))


def uplift_grid(
    surfaces: DataFrame, distances_m: list[float] = DISTANCES_M, horizons: list[int] = HORIZONS_MONTHS
) -> DataFrame:
    """Expected uplift for every project row at all distances and months."""
    spread = surfaces.withColumn("distance_m", F.explode(F.array(*[F.lit(float(d)) for d in distances_m]))).withColumn(
        "months_after_anchor", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    value = spatial_kernel(F.col("distance_m")) * time_factor(F.col("months_after_anchor"))
    return spread.withColumn("expected_uplift_pct", round_even(value, 4))


def leave_one_out_error(samples: DataFrame) -> DataFrame:
    """Hold-out error per project of the decay fitted on all other projects.

    Moments of the distance bins are additive, so every fold's sums are total minus
    own; the samples are read for the moments and for the error, never copied per fold or decay.
    """
    mid = cut_lineage(samples.filter(F.col("months_since_anchor").between(0, 24)).select("project_id", "distance_m", "uplift_pct", "weight"))
    moments = cut_lineage(sufficient_sums(mid, ["project_id"]))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(240)), lambda i: F.lit(-2.0) + i.cast("double") * F.lit(0.05)))
    own = _grid_sums(moments, ["project_id"], grid)
    total = own.groupBy("b").agg(F.sum("ye").alias("tye"), F.sum("ee").alias("tee"))
    rest = own.join(total, "b").select(
        "project_id", "b", (F.col("tye") - F.col("ye")).alias("ye"), (F.col("tee") - F.col("ee")).alias("ee"))
    fitted = rest.groupBy("project_id").agg(F.max_by(
        F.struct("b", (F.col("ye") / F.col("ee")).alias("a")),
        F.struct((F.col("ye") * F.col("ye") / F.col("ee")).alias("g"), (-F.col("b")).alias("nb"))).alias("p"))
    params = cut_lineage(fitted.select(
        "project_id", clip("p.a", 0.01, 1.0).alias("a"), clip("p.b", 0.01, 5.0).alias("b")))
    error = spatial_kernel(F.col("distance_m")) - F.col("uplift_pct")
    return mid.join(params, "project_id").groupBy("project_id", "a", "b").agg(
        F.count("*").alias("n_held_out"), F.sqrt(F.avg(error * error)).alias("rmse"))


def impact_report(projects: DataFrame, stages: DataFrame, sales: DataFrame, admin_areas: DataFrame, roads: DataFrame) -> DataFrame:
    """One row per project and grid cell, with the zone and road summaries.

    The surface is fitted per project type on all projects of the type.
    """
    samples = uplift_samples(projects, stages, sales, with_ids=False)
    params = fit_surface(samples, "project_type")
    anchors = anchor_dates(projects, stages)
    fitted = anchors.join(params, "project_type", "left").select(
        "project_id", "project_type", "anchor_date",
        F.coalesce("a", F.lit(DEFAULT_A)).alias("a"), F.coalesce("b", F.lit(DEFAULT_B)).alias("b"),
        *[F.coalesce(f"m{i}", F.lit(v)).alias(f"m{i}") for i, v in enumerate(DEFAULT_MULTIPLIERS)],
        F.coalesce("confidence", F.lit(0.40)).alias("confidence"),
        F.when(F.coalesce("n_projects", F.lit(0)) < 2, SMALL_SET_NOTE).when(F.col("rmse").isNull(), FEW_SAMPLES_NOTE)
        .otherwise(F.format_string(RMSE_NOTE, round_even("rmse", 4))).alias("note"))
    zone = impact_zone(projects, admin_areas).groupBy("project_id").agg(
        F.count("*").alias("zone_areas"), F.min("distance_m").alias("zone_nearest_m"))
    road = road_impact(projects, roads).groupBy("project_id").agg(
        F.count("*").alias("roads_near"), F.max("weight").alias("best_road_weight"))
    grid = uplift_grid(fitted).drop("m0", "m1", "m2", "m3")
    return grid.join(zone, "project_id", "left").join(road, "project_id", "left")


def top_factors(surfaces: DataFrame) -> DataFrame:
    """The three factors shown beside a forecast, as rows."""
    rows = F.array(
        F.struct(F.lit("spatial_decay_b").alias("factor"), round_even("b", 3).alias("value"), F.lit("negative").alias("impact")),
        F.struct(F.lit("peak_uplift_a").alias("factor"), round_even("a", 3).alias("value"), F.lit("positive").alias("impact")),
        F.struct(F.lit("anchor_date").alias("factor"), F.lit(None).cast("double").alias("value"), F.lit("neutral").alias("impact")))
    return surfaces.select("project_id", "anchor_date", F.explode(rows).alias("f")).select(
        "project_id", "anchor_date", "f.factor", "f.value", "f.impact")
