"""Window operators over (entity, date) series.

Series are keyed by entity and date, so a window partition is bounded by the
number of observation dates, however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelspark.functions.numbers import change, clip, round_even
from parcelspark.schemas import STAGE_PROGRESS

FLAT = 1e-12


def _all(keys: list[str]):
    return Window.partitionBy(*keys)


def minmax_scale(value: str, keys: list[str]) -> Column:
    low, high = F.min(value).over(_all(keys)), F.max(value).over(_all(keys))
    return F.when(high - low < FLAT, F.lit(0.0)).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def standardize(value: str, keys: list[str]) -> Column:
    spread = F.stddev_pop(value).over(_all(keys))
    mean = F.avg(value).over(_all(keys))
    return F.when(spread < FLAT, F.lit(0.0)).otherwise((F.col(value) - mean) / F.nullif(spread, F.lit(0.0)))


def zscore_clip(value: str, keys: list[str], limit: float = 3.0) -> Column:
    return clip(standardize(value, keys), -limit, limit)


def fill_gaps(df: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """Linear between known rows (by row position), held at the edges, 0 if all missing."""
    window = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_i", F.row_number().over(window))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(value).cast("double").alias("v")))
    back = F.last(known, ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(window.rowsBetween(0, Window.unboundedFollowing))
    df = df.withColumn("_p", back).withColumn("_n", ahead)
    p, n = F.col("_p"), F.col("_n")
    share = (F.col("_i") - p["i"]) / F.nullif(n["i"] - p["i"], F.lit(0)).cast("double")
    filled = (
        F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
        .when(p.isNull() & n.isNull(), F.lit(0.0))
        .when(p.isNull(), n["v"]).when(n.isNull(), p["v"])
        .otherwise(p["v"] + share * (n["v"] - p["v"])))
    return df.withColumn(out, filled).drop("_i", "_p", "_n")


def asof_progress(months: DataFrame, stages: DataFrame, key: str, date: str = "month_first") -> DataFrame:
    """Latest known stage progress at or before each date; 0 before any stage.

    Events and probes are unioned and swept once per entity, so no range join
    is needed. Unknown stages keep the previous value.
    """
    progress = F.when(F.lit(False), F.lit(0.0))
    for stage, share in STAGE_PROGRESS.items():
        progress = progress.when(F.col("stage") == stage, F.lit(share))
    events = stages.select(key, F.col("occurred_at").alias(date), progress.alias("_progress"), F.lit(0).alias("_probe"))
    probes = months.withColumn("_probe", F.lit(1))
    sweep = Window.partitionBy(key).orderBy(date, "_probe", "_progress").rowsBetween(Window.unboundedPreceding, 0)
    swept = probes.unionByName(events, allowMissingColumns=True).withColumn(
        "road_progress", F.coalesce(F.last("_progress", ignorenulls=True).over(sweep), F.lit(0.0)))
    return swept.filter(F.col("_probe") == 1).drop("_probe", "_progress")


def _pearson(x: Column, y: Column) -> Column:
    """Correlation by centred sums, within -1 and 1; no spread counts as 0."""
    spread = F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))
    r = F.coalesce(F.nanvl(F.covar_pop(x, y) / spread, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))


def pearson_pairs(df: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Correlation matrix in long form (key, a, b, r) from one aggregate.

    Fewer than three rows give the identity; a flat series gives 0 throughout,
    as NaN does in the matrix this replaces.
    """
    sums = [F.count("*").alias("n")]
    for x in names:
        sums.append((F.max(x) - F.min(x) < FLAT).alias(f"flat_{x}"))
    for i, x in enumerate(names):
        sums += [_pearson(F.col(x), F.col(y)).alias(f"p_{x}_{y}") for y in names[i + 1 :]]
    total = df.groupBy(key).agg(*sums)

    def cell(x: str, y: str) -> Column:
        a, b = (x, y) if names.index(x) <= names.index(y) else (y, x)
        flat = F.col(f"flat_{x}") | F.col(f"flat_{y}")
        if x == y:
            r = F.when((F.col("n") >= 3) & flat, F.lit(0.0)).otherwise(F.lit(1.0))
        else:
            r = F.when((F.col("n") < 3) | flat, F.lit(0.0)).otherwise(round_even(F.col(f"p_{a}_{b}"), 4))
        return F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), r.alias("r"))

    matrix = F.array(*[cell(x, y) for x in names for y in names])
    return total.select(key, F.explode(matrix).alias("m")).select(key, "m.a", "m.b", "m.r")


def cross_correlation(df: DataFrame, key: str, order: str, a: str, b: str, max_lag: int = 24) -> DataFrame:
    """``corr(a[t], b[t + lag])`` over the overlap for every lag: (key, lag, r).

    One sort per entity: the shifted values come from a single window as an
    array, are exploded narrow and aggregated in place, with no self-join and no
    second shuffle. Lags beyond n-1 are absent; overlaps below three rows or
    with a flat side give 0.
    """
    window = Window.partitionBy(key).orderBy(order)
    frame = window.rowsBetween(-max_lag, max_lag)
    near = F.collect_list(F.struct(F.col("_i").alias("i"), F.col(b).alias("y"))).over(frame)
    rows = df.select(key, order, a, b).withColumn("_i", F.row_number().over(window)).withColumn("_near", near)
    pairs = rows.select(key, F.col("_i"), F.col(a).alias("x"), F.explode("_near").alias("s")).select(
        key, (F.col("s.i") - F.col("_i")).alias("lag"), "x", F.col("s.y").alias("y"))
    x, y = F.col("x"), F.col("y")
    stats = pairs.groupBy(key, "lag").agg(
        F.count("*").alias("n"), _pearson(x, y).alias("raw"),
        ((F.max(x) - F.min(x) < FLAT) | (F.max(y) - F.min(y) < FLAT)).alias("flat"))
    return stats.select(key, "lag", F.when((F.col("n") < 3) | F.col("flat"), F.lit(0.0)).otherwise(F.col("raw")).alias("r"))


def lead_lag(
    correlations: DataFrame, key: str, coincident: int = 3, signal: float = 0.35
) -> DataFrame:
    """Strongest lag per entity with its class; negative output means a leads b.

    Ranked on r at ten digits so that float noise cannot flip ties; the smallest
    internal lag wins, and all-zero correlations report lag 0.
    """
    strength = F.abs(round_even("r", 10))
    best = correlations.groupBy(key).agg(F.max_by(
        F.struct("lag", "r"), F.struct(strength.alias("s"), (-F.col("lag")).alias("l"))).alias("best"))
    found = F.abs(round_even("best.r", 10)) > 0
    reported = F.when(found, -F.col("best.lag")).otherwise(F.lit(0))
    r = F.when(found, F.col("best.r")).otherwise(F.lit(0.0))
    label = (
        F.when(F.abs(r) < signal, "uncertain").when(reported < -coincident, "leading")
        .when(reported > coincident, "lagging").otherwise("coincident"))
    return best.select(
        key, reported.alias("best_lag_months"), round_even(r, 4).alias("best_correlation"), label.alias("classification"))


def previous_year_change(prices: DataFrame, key: str = "pnu") -> DataFrame:
    """Price one calendar year earlier (null on a gap) and the change in percent."""
    window = Window.partitionBy(key).orderBy("year").rangeBetween(-1, -1)
    rate = F.when(
        F.col("previous_price") != 0,
        round_even((F.col("price_per_m2") - F.col("previous_price")) / F.col("previous_price").cast("double") * 100, 4))
    return prices.withColumn("previous_price", F.first("price_per_m2").over(window)).withColumn("change_rate", rate)


def price_change(prices: DataFrame, key: str = "pnu") -> DataFrame:
    """Latest price, change against the row before and against the first row."""
    ordered = Window.partitionBy(key).orderBy("year")
    lagged = prices.withColumn("_before", F.lag("price_per_m2").over(ordered))
    return lagged.groupBy(key).agg(
        F.max_by("price_per_m2", "year").alias("latest"), F.max_by("_before", "year").alias("before"),
        F.min_by("price_per_m2", "year").alias("earliest"), F.count("*").alias("n_years"),
    ).select(
        key, F.col("latest").cast("double").alias("land_price_per_m2"),
        F.coalesce(round_even(change("latest", "before"), 4), F.lit(0.0)).alias("land_price_yoy"),
        F.coalesce(round_even(change("latest", "earliest"), 4), F.lit(0.0)).alias("land_price_5y_growth"), "n_years")


def change_from_stored(new: DataFrame, stored: DataFrame, key: str = "pnu") -> DataFrame:
    """Change in percent of incoming prices against the stored previous year."""
    before = stored.select(key, (F.col("year") + 1).alias("year"), F.col("price_per_m2").alias("_before"))
    rate = round_even((F.col("price_per_m2") - F.col("_before")) / F.nullif(F.col("_before"), F.lit(0)).cast("double") * 100, 4)
    return new.join(before, [key, "year"], "left").withColumn("change_rate", rate).drop("_before")
