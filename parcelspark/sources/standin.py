"""Domain tables derived from the star-schema test tables.

Integer and double arithmetic only, so a SQL oracle evaluates the same mapping
bit for bit. Every method returns an unevaluated DataFrame.
"""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

AS_OF = dt.date(2001, 6, 30)
PROJECT_TYPES = ["public_housing", "urban_development", "industrial_complex", "logistics", "new_town", "other"]
ROUTES = ["고속도로", "국도", "지방도", "시도"]
#: Rings of a split project: shift of the middle to the east and size, both in half sides. The second is a hole.
RINGS = [(0.0, 1.0), (0.0, 0.5), (4.0, 0.25)]
BRAND_CATEGORIES = ["cafe", "fastfood", "bakery", "convenience", "other"]


def point(k: Column) -> tuple[Column, Column]:
    """Scatter an integer over a 0.6 by 0.4 degree box."""
    k = k.cast("bigint")
    lon = F.lit(126.60) + F.lit(0.60) * ((k * 7919) % 10007).cast("double") / F.lit(10007.0)
    lat = F.lit(37.30) + F.lit(0.40) * ((k * 104729) % 10009).cast("double") / F.lit(10009.0)
    return lon, lat


def _located(k: Column) -> list[Column]:
    lon, lat = point(k)
    return [lon.alias("lon"), lat.alias("lat")]


class StandIn:
    """Lazy domain tables over one directory of test parquet files."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = spark, directory.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    def fact(self, name: str, key: str) -> DataFrame:
        """A large table; a lone file with one row group would be read by one
        task only, so it is spread over the cores. Real layouts skip this, and
        so does a lone file that is cut into a part for each core when it is read."""
        df = self.raw(name)
        cores = self.spark.sparkContext.defaultParallelism
        lone = len(df.inputFiles()) < min(cores, 2) and df.rdd.getNumPartitions() < cores
        return df.repartition(cores, key) if lone else df

    @cached_property
    def _nations(self) -> DataFrame:
        n = self.raw("nation")
        code = F.concat(F.lit("1"), F.col("n_regionkey"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0"))
        return n.select(F.col("n_nationkey").cast("bigint").alias("n"), "n_name", "n_regionkey", code.alias("sigungu"))

    @cached_property
    def admin_areas(self) -> DataFrame:
        region = self.raw("region")
        sido = region.select(
            F.concat(F.lit("1"), F.col("r_regionkey")).alias("code"), F.col("r_name").alias("name"),
            F.lit("sido").alias("level"), F.lit(None).cast("string").alias("parent_code"),
            *_located(F.col("r_regionkey") + 100))
        n = self._nations
        sigungu = n.select(
            F.col("sigungu").alias("code"), F.col("n_name").alias("name"), F.lit("sigungu").alias("level"),
            F.concat(F.lit("1"), F.col("n_regionkey")).alias("parent_code"), *_located(F.col("n") + 500))
        slots = self.raw("customer").select(
            F.col("c_nationkey").cast("bigint").alias("n"), (F.col("c_custkey") % 8).alias("slot")).distinct()
        dong = slots.join(n, "n").select(
            F.concat("sigungu", F.lpad(F.col("slot").cast("string"), 5, "0")).alias("code"),
            F.concat_ws("-", "n_name", F.col("slot").cast("string")).alias("name"),
            F.lit("eupmyeondong").alias("level"), F.col("sigungu").alias("parent_code"),
            *_located(F.col("n") * 8 + F.col("slot") + 3000))
        return sido.unionByName(sigungu).unionByName(dong)

    @cached_property
    def projects(self) -> DataFrame:
        n = F.col("n")
        half = F.lit(0.008) + F.lit(0.001) * (n % 5).cast("double")
        lon, lat = point(n + 500)
        corners = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]
        ring = F.array(*[
            F.struct((F.col("lon") + half * sx).alias("lon"), (F.col("lat") + half * sy).alias("lat"))
            for sx, sy in corners])
        announced = F.add_months(F.lit(dt.date(1995, 6, 1)), n.cast("int"))
        return self._nations.withColumn("lon", lon).withColumn("lat", lat).select(
            n.alias("id"), F.concat(F.lit("Project "), "n_name").alias("name"),
            F.element_at(F.array(*map(F.lit, PROJECT_TYPES)), (n % 6 + 1).cast("int")).alias("project_type"),
            F.col("sigungu").alias("region_code"), F.array(ring).alias("polygon"), "lon", "lat",
            ((n % 5 + 8) * 40).cast("decimal(10,2)").alias("area_ha"),
            ((n + 1) * 10).cast("decimal(12,2)").alias("expected_compensation_billion_krw"),
            announced.alias("planned_announcement_date"),
            F.add_months(announced, 72).alias("planned_completion_date"))

    @cached_property
    def split_projects(self) -> DataFrame:
        """The projects as shapes of two parts, the larger one with a hole: three rings each."""
        n = F.col("n")
        half = F.lit(0.008) + F.lit(0.001) * (n % 5).cast("double")
        corners = [(-1.0, -1.0), (1.0, -1.0), (1.0, 1.0), (-1.0, 1.0)]

        def ring(east: float, scale: float) -> Column:
            middle = F.col("lon") + half * east
            return F.array(*[F.struct((middle + half * (sx * scale)).alias("lon"), (F.col("lat") + half * (sy * scale)).alias("lat")) for sx, sy in corners])

        shapes = self.projects.withColumn("n", F.col("id")).withColumn("polygon", F.array(*[ring(*r) for r in RINGS]))
        return shapes.drop("n")

    @cached_property
    def project_stages(self) -> DataFrame:
        steps = [("announced", 0, 1), ("designated", 6, 2), ("compensation_started", 18, 3)]
        rows = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(m).alias("m"), F.lit(q).alias("sequence_no")) for s, m, q in steps])
        return (
            self._nations.select("n", F.explode(rows).alias("s"))
            .filter(~((F.col("s.stage") == "compensation_started") & (F.col("n") % 6 == 5)))
            .select(
                F.col("n").alias("project_id"), "s.stage",
                F.add_months(F.lit(dt.date(1995, 6, 1)), (F.col("n") + F.col("s.m")).cast("int")).alias("occurred_at"),
                "s.sequence_no"))

    @cached_property
    def _suppliers(self) -> DataFrame:
        return self.raw("supplier").select(
            F.col("s_suppkey").alias("s"), "s_name", F.col("s_nationkey").cast("bigint").alias("n"),
        ).join(self._nations.select("n", "sigungu"), "n")

    @cached_property
    def land_transactions(self) -> DataFrame:
        li = self.fact("lineitem", "l_orderkey").withColumn("d", F.col("l_shipdate").cast("date"))
        # supplier and nation are joined one after the other: as plain tables their size is known, and small ones go to the sales
        s = self.raw("supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("bigint").alias("n"))
        districts = self._nations.select("n", F.col("sigungu").alias("region_code"))
        natural = F.concat_ws(
            ":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "d")])
        return li.join(s, "l_suppkey").join(districts, "n").select(
            F.sha1(natural).alias("source_id"), "region_code",
            *_located(F.col("l_orderkey") * 7 + F.col("l_linenumber") + F.col("l_partkey") * 13),
            F.lit("land").alias("transaction_type"), F.col("d").alias("contract_date"),
            F.floor(F.col("l_extendedprice") * 1000 + F.lit(0.5)).cast("bigint").alias("deal_amount_krw"),
            (F.col("l_quantity") * 10).cast("double").alias("area_m2"))

    @cached_property
    def road_segments(self) -> DataFrame:
        s = F.col("s")
        lon, lat = point(s + 1)
        bends = [(0.0, 0.0), (0.010, 0.004), (0.018, -0.003)]
        line = F.array(*[F.struct((F.col("lon") + x).alias("lon"), (F.col("lat") + y).alias("lat")) for x, y in bends])
        route = F.when(s % 5 < 4, F.concat(
            F.element_at(F.array(*map(F.lit, ROUTES)), (s % 5 + 1).cast("int")), s.cast("string")))
        return self._suppliers.withColumn("lon", lon).withColumn("lat", lat).select(
            s.alias("id"), F.col("s_name").alias("name"), route.alias("route_no"),
            F.col("sigungu").alias("region_code"), line.alias("line"),
            (F.lit(1500) + 100 * ((s * 37) % 50)).cast("decimal(10,2)").alias("length_m"))

    @cached_property
    def road_expansion_stages(self) -> DataFrame:
        steps = [("planned", 0), ("design", 14), ("under_construction", 32), ("completed", 56)]
        rows = F.array(*[F.struct(F.lit(n).alias("stage"), F.lit(m).alias("m")) for n, m in steps])
        s = F.col("s_suppkey")
        return (
            self.raw("supplier").select(s, F.explode(rows).alias("r"))
            .filter(~((F.col("r.stage") == "completed") & (s % 5 == 0)))
            .select(
                s.alias("road_id"), "r.stage",
                F.add_months(F.lit(dt.date(1994, 6, 1)), (s % 12 + F.col("r.m")).cast("int")).alias("occurred_at"),
                F.lit(2).alias("lanes_before"), F.lit(4).alias("lanes_after")))

    @cached_property
    def traffic_volumes(self) -> DataFrame:
        month = F.trunc(F.col("l_shipdate").cast("date"), "month")
        aadt = (F.lit(5000) + 40 * F.sum("l_quantity")).cast("bigint")
        return (
            self.fact("lineitem", "l_orderkey").groupBy(F.col("l_suppkey").alias("road_id"), month.alias("observed_at"))
            .agg(aadt.alias("aadt"))
            .withColumn("peak_hour_volume", F.expr("aadt div 10")))

    @cached_property
    def population_stats(self) -> DataFrame:
        month_end = F.last_day(F.col("o_orderdate").cast("date"))
        c = self.raw("customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("n"))
        counts = (
            self.fact("orders", "o_orderkey").join(c, F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("n", (F.col("c_custkey") % 8).alias("slot"), month_end.alias("observed_at"))
            .agg((F.lit(8000) + 40 * F.count("*")).alias("total_population")))
        total = F.col("total_population")
        return counts.join(self._nations.select("n", "sigungu"), "n").select(
            F.concat("sigungu", F.lpad(F.col("slot").cast("string"), 5, "0")).alias("region_code"),
            "observed_at", "total_population", F.expr("total_population * 2 div 5").alias("household_count"),
            F.expr("total_population div 2").alias("male_population"),
            (total - F.expr("total_population div 2")).alias("female_population"))

    @cached_property
    def _parcels(self) -> DataFrame:
        p = F.col("p_partkey")
        text = lambda c, width: F.lpad(c.cast("string"), width, "0")
        return (
            self.raw("part").withColumn("n", p % 25).join(self._nations.select("n", "sigungu"), "n")
            .withColumn("pnu", F.concat(
                "sigungu", text(p % 8, 5), F.lit("1"), text(p % 10000, 4), text(F.expr("p_partkey div 10000"), 4))))

    @cached_property
    def buildings(self) -> DataFrame:
        p, size = F.col("p_partkey"), F.col("p_size").cast("bigint")
        use = (F.when(F.col("p_type") == "ECONOMY", "일반상업시설")
               .when(F.col("p_type") == "STANDARD", "제1종근린생활시설").otherwise("단독주택"))
        return self._parcels.select(
            "pnu", F.col("sigungu").alias("region_code"), (size * 50).cast("double").alias("parcel_area_m2"),
            ((size * 50 * (F.lit(2) + p % 7)).cast("double") / 10.0).alias("building_area_m2"),
            ((size * 50 * (F.lit(2) + p % 7)).cast("double") / 5.0).alias("total_floor_area_m2"),
            use.alias("use_type"),
            F.date_add(F.lit(dt.date(1985, 1, 1)), (p % 3000).cast("int")).alias("approval_date"),
            *_located(p + 20000))

    @cached_property
    def official_land_prices(self) -> DataFrame:
        year = F.year(F.col("l_shipdate").cast("date"))
        cents = F.sum(F.floor(F.col("l_extendedprice") * 100 + F.lit(0.5)).cast("bigint"))
        units = F.sum(F.col("l_quantity").cast("bigint"))
        sums = (
            self.fact("lineitem", "l_orderkey").groupBy(F.col("l_partkey").alias("p_partkey"), year.alias("year"))
            .agg(cents.alias("cents"), units.alias("units")))
        trend = F.lit(100) + (F.col("p_partkey") % 9) * (F.col("year") - 1995)
        price = F.floor((F.col("cents") * trend).cast("double") / (F.col("units") * 10000).cast("double") + F.lit(0.5))
        return sums.join(self._parcels.select("p_partkey", "pnu"), "p_partkey").select(
            "pnu", "year", price.cast("bigint").alias("price_per_m2"))

    @cached_property
    def store_brands(self) -> DataFrame:
        name = F.col("c_mktsegment")
        return self.raw("customer").select(name).distinct().select(
            name.alias("name"), F.element_at(
                F.array(*map(F.lit, BRAND_CATEGORIES)), (F.length(name) % 5 + 1).cast("int")).alias("category"))

    @cached_property
    def stores(self) -> DataFrame:
        c = F.col("c_custkey")
        base = self.raw("customer").withColumn("n", F.col("c_nationkey").cast("bigint"))
        parcels = self._parcels.select(
            F.col("p_partkey").alias("c_custkey"), "pnu", F.col("p_size").cast("bigint").alias("size"))
        opened = F.date_add(F.lit(dt.date(1997, 1, 1)), ((c * 13) % 1000).cast("int"))
        kind = F.element_at(F.array(F.lit("DT"), F.lit("DI"), F.lit("standard")), (F.expr("c_custkey div 10") % 3 + 1).cast("int"))
        return (
            base.join(self._nations.select("n", "sigungu"), "n").join(parcels, "c_custkey")
            .select(
                c.alias("id"), F.col("c_mktsegment").alias("brand"), F.col("c_name").alias("name"),
                F.concat_ws(" ", F.lit("KR"), "sigungu", F.concat(F.lit("Dong"), (c % 8).cast("string"))).alias("address"),
                F.col("sigungu").alias("region_code"), *_located(c + 20000), "pnu", kind.alias("store_type"),
                opened.alias("opened_at"), F.when(c % 70 == 0, F.date_add(opened, 900)).alias("closed_at"),
                (F.col("size") * 50).cast("double").alias("land_area_m2"),
                ((F.col("size") * 50 * (F.lit(2) + c % 7)).cast("double") / 10.0).alias("building_area_m2")))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.raw("embeddings")
