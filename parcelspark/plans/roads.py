"""Road progress, population and traffic moving together."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window, functions as F

from parcelspark.functions.numbers import round_even, round_up, saturating
from parcelspark.operators import timeseries as ts
from parcelspark.plans.views import optional_filters, with_prefixes

VARIABLES = ["road_progress", "population", "aadt"]


def region_population(population: DataFrame, roads: DataFrame, region_match: str = "prefix") -> DataFrame:
    """Average population per road region code and date.

    Computed once per region and fanned out to its roads afterwards.
    """
    codes = roads.select("region_code").distinct()
    stats = with_prefixes(population, roads) if region_match == "prefix" else population.join(
        codes, "region_code", "left_semi")
    return stats.groupBy("region_code", "observed_at").agg(
        round_up(F.avg("total_population")).alias("total_population"))


def aligned_months(
    traffic: DataFrame, roads: DataFrame, population: DataFrame, stages: DataFrame,
    start: dt.date | None = None, end: dt.date | None = None, region_match: str = "prefix",
) -> DataFrame:
    """One row per traffic observation: population of the month (the last one
    wins), traffic and stage progress as of the first of the month."""
    traffic = optional_filters(traffic, None, start, end)
    people = region_population(optional_filters(population, None, start, end), roads, region_match)
    monthly = people.groupBy("region_code", F.date_format("observed_at", "yyyy-MM").alias("year_month")).agg(
        F.max_by("total_population", "observed_at").cast("double").alias("population"))
    rows = (
        traffic.select("road_id", "observed_at", F.col("aadt").cast("double").alias("aadt"))
        .join(roads.select(F.col("id").alias("road_id"), "region_code"), "road_id")
        .withColumn("year_month", F.date_format("observed_at", "yyyy-MM"))
        .withColumn("month_first", F.trunc("observed_at", "month"))
        .join(monthly, ["region_code", "year_month"], "left"))
    return ts.asof_progress(rows, stages, "road_id").select(
        "road_id", "observed_at", "year_month", "population", "aadt", "road_progress")


def scaled_series(aligned: DataFrame) -> DataFrame:
    """Gap-filled and min-max scaled series, all windows on one partitioning."""
    filled = ts.fill_gaps(aligned, ["road_id"], "observed_at", "population", "population_filled")
    return filled.select(
        "road_id", "observed_at", "year_month",
        ts.minmax_scale("road_progress", ["road_id"]).alias("road_progress"),
        ts.minmax_scale("population_filled", ["road_id"]).alias("population"),
        ts.minmax_scale("aadt", ["road_id"]).alias("aadt"))


def correlations(scaled: DataFrame) -> DataFrame:
    return ts.pearson_pairs(scaled, "road_id", VARIABLES)


def lags(scaled: DataFrame, max_lag: int = 24) -> DataFrame:
    return ts.cross_correlation(scaled, "road_id", "observed_at", "population", "aadt", max_lag)


def cumulative_change(aligned: DataFrame) -> DataFrame:
    """First and last traffic value, growth and month-count confidence per road."""
    edge = aligned.groupBy("road_id").agg(
        F.min("year_month").alias("first_month"), F.max("year_month").alias("last_month"),
        F.min_by("aadt", "observed_at").alias("first_aadt"), F.max_by("aadt", "observed_at").alias("last_aadt"),
        F.count("*").alias("n_months"))
    growth = F.when(
        (F.col("first_aadt") > 0) & (F.col("last_aadt") != 0),
        (F.col("last_aadt") - F.col("first_aadt")) / F.nullif(F.col("first_aadt"), F.lit(0.0)))
    return edge.withColumn("growth", growth).withColumn(
        "confidence", saturating(F.col("n_months"), 60, 0.30, 0.90))


def _three(corr: DataFrame) -> DataFrame:
    def pick(a: str, b: str):
        return F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.col("r")))

    return corr.groupBy("road_id").agg(
        pick("road_progress", "population").alias("r_progress_population"),
        pick("road_progress", "aadt").alias("r_progress_aadt"),
        pick("population", "aadt").alias("r_population_aadt"))


def road_report(aligned: DataFrame) -> DataFrame:
    """One row per road: correlations, lead or lag, growth and confidence."""
    scaled = scaled_series(aligned)
    return (
        cumulative_change(aligned).join(_three(correlations(scaled)), "road_id")
        .join(ts.lead_lag(lags(scaled), "road_id"), "road_id"))


# Insight wording.
LINKED_TITLE = "도로 진행률 ↔ 통행량 연동"
LINKED = "도로 단계 진행과 통행량 사이에 %s 강한 상관 (r=%+.2f)이 관찰됩니다."
LEADS_TITLE, LEADS = "인구가 통행량을 선행", "인구 변화가 통행량 변화를 약 %d개월 선행하는 패턴 (corr=%+.2f)."
LAGS_TITLE, LAGS = "인구가 통행량을 후행", "통행량 증가가 인구 유입보다 %d개월 먼저 발생 (corr=%+.2f)."
GROWTH_TITLE, GROWTH = "통행량 누적 변화 %+.1f%%", "%s → %s: %s → %s 대/일"
NO_DATA_TITLE = "데이터 부족"
NO_DATA = "선택된 도로에 대한 통행량 시계열이 없습니다. ETL을 먼저 실행한 후 다시 시도하세요."


def insights(report: DataFrame, roads: DataFrame) -> DataFrame:
    """Sentences per road in rule order; a road without traffic gets one notice."""
    r, lag, c = F.col("r_progress_aadt"), F.col("best_lag_months"), F.col("best_correlation")
    percent = round_even(F.col("growth") * 100, 1)

    def row(no: int, title, detail, score):
        return F.struct(F.lit(no).alias("rule_no"), title.alias("title"), detail.alias("detail"), score.alias("score"))

    two = lambda x: round_even(x, 2)
    whole = lambda x: F.format_number(F.rint(x), 0)
    rules = F.array(
        F.when(F.abs(r) >= 0.5, row(
            1, F.lit(LINKED_TITLE), F.format_string(LINKED, F.when(r > 0, "양의").otherwise("음의"), two(r)),
            F.abs(r))),
        F.when(F.col("classification") == "leading", row(
            2, F.lit(LEADS_TITLE), F.format_string(LEADS, F.abs(lag), two(c)), F.abs(c))),
        F.when(F.col("classification") == "lagging", row(
            3, F.lit(LAGS_TITLE), F.format_string(LAGS, lag, two(c)), F.abs(c))),
        F.when(F.col("growth").isNotNull(), row(
            4, F.format_string(GROWTH_TITLE, percent),
            F.format_string(GROWTH, "first_month", "last_month", whole("first_aadt"), whole("last_aadt")),
            round_even(F.least(F.abs("growth"), F.lit(1.0)), 4))))
    notice = F.array(row(0, F.lit(NO_DATA_TITLE), F.lit(NO_DATA), F.lit(0.0)))
    every = roads.select(F.col("id").alias("road_id")).join(report, "road_id", "left")
    kept = F.filter(rules, lambda x: x.isNotNull())
    return every.select(
        "road_id", F.explode(F.when(F.col("n_months").isNull(), notice).otherwise(kept)).alias("i"),
    ).select("road_id", "i.rule_no", "i.title", "i.detail", "i.score")


def top_factors(report: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` largest magnitudes among three correlations and the lag."""
    def factor(no: int, name: str, value, impact):
        return F.struct(
            (-F.abs(value.cast("double"))).alias("sort"), F.lit(no).alias("no"), F.lit(name).alias("factor"),
            value.cast("double").alias("value"), impact.alias("impact"))

    sign = lambda v: F.when(v > 0, "positive").otherwise("negative")
    cols = [("corr(road_progress,population)", "r_progress_population"),
            ("corr(road_progress,aadt)", "r_progress_aadt"), ("corr(population,aadt)", "r_population_aadt")]
    lag = factor(4, "lead_lag(population,aadt)", F.col("best_lag_months"),
                 F.when(F.col("classification") == "coincident", "neutral").otherwise("positive"))
    rows = F.array(*[factor(i + 1, n, F.col(c), sign(F.col(c))) for i, (n, c) in enumerate(cols)], lag)
    return report.select("road_id", F.posexplode(F.slice(F.array_sort(rows), 1, k)).alias("pos", "f")).select(
        "road_id", (F.col("pos") + 1).alias("factor_rank"), "f.factor", "f.value", "f.impact")
