"""Similar regions and similar stores."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelspark.functions.numbers import change, round_even
from parcelspark.operators import timeseries as ts
from parcelspark.operators.nearest import topk_cosine
from parcelspark.operators.skew import top_rows
from parcelspark.plans.features import FEATURE_NAMES
from parcelspark.schemas import STAGE_PROGRESS
from parcelspark.session import cut_lineage

# Region features and their weights, which sum to one.
REGION_WEIGHTS = {
    "road_progress": 0.30, "population_avg": 0.20, "population_growth_3y": 0.20,
    "aadt_avg": 0.15, "aadt_growth_3y": 0.15,
}
FIRST_PEERS = 100  # default of the list of first peers, no bound of the ranking
BLOCK = 2048  # areas in one side of a matrix product
DIGITS = 10


def normalised_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {k: (v / total if total > 0 else 0.0) for k, v in weights.items()}


def region_population_summary(population: DataFrame, snapshot: dt.date) -> DataFrame:
    snap, date = F.lit(snapshot), F.col("observed_at")
    now = F.max(F.when(date >= F.add_months(snap, -6), F.col("total_population")))
    old = F.min(F.when(date.between(F.add_months(snap, -36), F.add_months(snap, -30)), F.col("total_population")))
    return population.filter(date <= snap).groupBy("region_code").agg(
        F.avg("total_population").alias("population_avg"), now.alias("now"), old.alias("old"),
    ).select("region_code", "population_avg", change("now", "old").alias("population_growth_3y"))


def region_road_summary(roads: DataFrame, traffic: DataFrame, stages: DataFrame, snapshot: dt.date) -> DataFrame:
    """Averages over road x traffic x stage rows, without forming those rows.

    The two left joins this replaces repeat every traffic row once per stage and
    every stage once per traffic row; as weights that is just a product of two
    counts per road.
    """
    snap, date = F.lit(snapshot), F.col("observed_at")
    flow = traffic.groupBy("road_id").agg(
        F.count("aadt").alias("t"), F.sum("aadt").alias("aadt_sum"),
        F.max(F.when(date >= F.add_months(snap, -12), F.col("aadt"))).alias("now"),
        F.max(F.when(date.between(F.add_months(snap, -36), F.add_months(snap, -24)), F.col("aadt"))).alias("old"))
    share: Column = F.when(F.lit(False), F.lit(0.0))
    for stage, value in STAGE_PROGRESS.items():
        share = share.when(F.col("stage") == stage, F.lit(value))
    done = stages.filter(F.col("occurred_at") <= snap).groupBy("road_id").agg(
        F.count("*").alias("s"), F.sum(share.otherwise(F.lit(0.0))).alias("progress_sum"))
    joined = (
        roads.select(F.col("id").alias("road_id"), "region_code")
        .join(flow, "road_id", "left").join(done, "road_id", "left").na.fill(0, ["t", "s", "progress_sum"]))
    wt, ws = F.greatest("t", F.lit(1)), F.greatest("s", F.lit(1))
    return joined.groupBy("region_code").agg(
        (F.sum(F.col("aadt_sum") * ws) / F.nullif(F.sum(F.col("t") * ws).cast("double"), F.lit(0.0))).alias("aadt_avg"),
        (F.sum(F.col("progress_sum") * wt) / F.sum(wt * ws).cast("double")).alias("road_progress"),
        F.max("now").alias("now"), F.max("old").alias("old"),
    ).select("region_code", "aadt_avg", "road_progress", change("now", "old").alias("aadt_growth_3y"))


def region_features(
    admin_areas: DataFrame, population: DataFrame, roads: DataFrame, traffic: DataFrame, stages: DataFrame,
    snapshot: dt.date, scale: str | None = None,
) -> DataFrame:
    """Five-value summary of every admin area; missing parts are 0.

    ``scale='zscore'`` standardises each feature within its level first, so that
    head counts do not drown the rates.
    """
    pop = region_population_summary(population, snapshot).withColumnRenamed("region_code", "code")
    road = region_road_summary(roads, traffic, stages, snapshot).withColumnRenamed("region_code", "code")
    rows = admin_areas.select("code", "name", "level").join(pop, "code", "left").join(road, "code", "left")
    filled = rows.select("code", "name", "level", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in REGION_WEIGHTS])
    if scale == "zscore":
        stats = filled.groupBy("level").agg(*[
            x for c in REGION_WEIGHTS for x in (F.avg(c).alias(f"{c}_m"), F.stddev_pop(c).alias(f"{c}_s"))])
        filled = filled.join(stats, "level").select("code", "name", "level", *[
            F.coalesce(F.when(F.col(f"{c}_s") >= ts.FLAT, (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")), F.lit(0.0)).alias(c)
            for c in REGION_WEIGHTS])
    return filled


def weighted_cosine(a: str, b: str, weights: dict[str, float]) -> Column:
    """Cosine of two prefixed column sets, both scaled by the weights."""
    w = normalised_weights(weights)

    def dot(x: str, y: str) -> Column:
        total = F.lit(0.0)
        for name, weight in w.items():
            total = total + (F.col(x + name) * F.lit(weight)) * (F.col(y + name) * F.lit(weight))
        return total

    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size < 1e-12, F.lit(0.0)).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def region_peers(admin_areas: DataFrame, cap: int = FIRST_PEERS) -> DataFrame:
    """For every area the first ``cap`` other areas of its level by code.

    Only the first cap+1 codes of a level can ever be peers, a table whose size
    does not depend on the number of areas; an area among them skips itself.
    """
    first = top_rows(admin_areas.select("code", "level"), ["level"], [F.col("code").asc()], cap + 1, "pos")
    own = admin_areas.select("code", "level").join(
        F.broadcast(first.select("code", F.col("pos").alias("own"))), "code", "left")
    peer = F.broadcast(first.select("level", F.col("code").alias("peer_code"), "pos"))
    limit = F.lit(cap) + F.when(F.coalesce("own", F.lit(cap + 1)) <= cap, F.lit(1)).otherwise(F.lit(0))
    return own.join(peer, "level").filter((F.col("peer_code") != F.col("code")) & (F.col("pos") <= limit)).select(
        "code", "peer_code")


def best_peers(features: DataFrame, weights: dict[str, float], top_n: int) -> DataFrame:
    """(code, peer_code): per area the best ``top_n`` of each block of its level.

    Hashed parts of the areas meet hashed blocks of their level as matrix products;
    only the best of each block leave a task. Missing levels have no peers.
    """
    biggest = features.groupBy("level").count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-biggest // BLOCK))
    own = F.pmod(F.xxhash64("code"), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    scaled = F.array(*[F.col(c) * F.lit(w) for c, w in normalised_weights(weights).items()])
    rows = features.filter("level is not null and code is not null").select("level", "code", scaled.alias("v"), own.alias("own"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"code": [], "peer_code": []}, dtype=object)
        right = right.sort_values("peer_code")
        a, b = np.vstack(left["v"].to_list()), np.vstack(right["peer_v"].to_list())
        size = np.linalg.norm(a, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
        scores = np.round(np.divide(a @ b.T, size, out=np.zeros_like(size), where=size >= 1e-12), DIGITS)
        # stable, so ties keep the order of codes; one more for the area itself
        first = np.argsort(-scores, axis=1, kind="stable")[:, : top_n + 1]
        found = pd.DataFrame({
            "code": np.repeat(left["code"].to_numpy(), first.shape[1]), "peer_code": right["peer_code"].to_numpy()[first.ravel()]})
        return found[found["code"] != found["peer_code"]]

    asked = rows.select("level", F.col("own").alias("part"), every.alias("block"), "code", "v")
    held = rows.select(
        F.col("level").alias("peer_level"), every.alias("peer_part"), F.col("own").alias("peer_block"),
        F.col("code").alias("peer_code"), F.col("v").alias("peer_v"))
    return asked.groupBy("level", "part", "block").cogroup(
        held.groupBy("peer_level", "peer_part", "peer_block")).applyInPandas(best, "code string, peer_code string")


def similar_regions(
    features: DataFrame, top_n: int = 10, weights: dict[str, float] = REGION_WEIGHTS, first_peers: int | None = None
) -> DataFrame:
    """Best ``top_n`` peers per area by weighted cosine; ties go to the code.

    Ranked over all areas of the level, or over its ``first_peers`` first codes, on
    ten digits, so that equal directions tie whatever the noise.
    """
    features = cut_lineage(features)
    pairs = region_peers(features, first_peers) if first_peers else best_peers(features, weights, top_n)
    left = features.select(F.col("code"), *[F.col(c).alias("a_" + c) for c in weights])
    right = features.select(
        F.col("code").alias("peer_code"), F.col("name").alias("peer_name"), *[F.col(c).alias("b_" + c) for c in weights])
    scored = (
        pairs.join(left, "code").join(right, "peer_code")
        .withColumn("raw", weighted_cosine("a_", "b_", weights)))
    ranked = top_rows(scored, ["code"], [round_even("raw", DIGITS).desc(), F.col("peer_code").asc()], top_n)
    n = F.count("*").over(Window.partitionBy("code"))
    return ranked.select(
        "code", "peer_code", "peer_name", round_even("raw", 4).alias("score"), "rank",
        *[F.col("b_" + c).alias(c) for c in weights],
        round_even(F.least(F.lit(0.40) + F.lit(0.05) * n, F.lit(0.85)), 3).alias("confidence"))


def active_stores(stores: DataFrame) -> DataFrame:
    return stores.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull() & F.col("closed_at").isNull())


def feature_vectors(features: DataFrame) -> DataFrame:
    return features.withColumn("vector", F.array(*FEATURE_NAMES))


def similar_stores(features: DataFrame, stores: DataFrame, top_n: int = 5) -> DataFrame:
    """Nearest active stores by feature direction, never the store itself."""
    open_ids = active_stores(stores).select(F.col("id").alias("store_id"))
    vectors = cut_lineage(feature_vectors(features.filter(F.col("owner_store_id").isNotNull())).select(
        F.col("owner_store_id").alias("store_id"), "vector"))
    index = vectors.join(open_ids, "store_id", "left_semi").withColumnRenamed("store_id", "similar_store_id")
    hits = topk_cosine(vectors, index, "store_id", "similar_store_id", "vector", top_n, exclude_self=True)
    labels = stores.select(F.col("id").alias("similar_store_id"), F.col("name").alias("label"))
    return hits.join(labels, "similar_store_id", "left").withColumn("confidence", F.lit(0.75))


def recommendation_rows(hits: DataFrame, kind: str, source: str, target: str, version: str) -> DataFrame:
    """Hits in the shape of the recommendations table."""
    return hits.select(
        F.lit(kind).alias("source_entity_type"), F.col(source).cast("string").alias("source_entity_id"),
        F.lit(kind).alias("target_entity_type"), F.col(target).cast("string").alias("target_entity_id"),
        "score", F.col("rank").cast("int").alias("rank"), F.lit(version).alias("model_version"))
