"""Radius and nearest-neighbour joins as grid-cell equi-joins; for shapes see ``covers``."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from parcelspark.functions import geo
from parcelspark.operators.skew import HOT_ROWS, salted_join
from parcelspark.session import cut_lineage

CELL = ["cx", "cy"]


def with_cell(df: DataFrame, size: tuple[float, float], lon: str = "lon", lat: str = "lat") -> DataFrame:
    cx, cy = geo.cell_of(F.col(lon), F.col(lat), size)
    return df.withColumn("cx", cx).withColumn("cy", cy)


def _within(df: DataFrame, distance: Column, radius_m: float) -> DataFrame:
    """Add ``distance_m`` and keep rows in reach.

    Passing the value through a one-element explode keeps the optimiser from
    copying the expensive expression into both the filter and the projection.
    """
    return df.withColumn("distance_m", F.explode(F.array(distance))).filter(F.col("distance_m") <= radius_m)


def _around(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


# Root cells are 2**DEPTH times as wide as the finest ones, whose neighbours cover the radius.
DEPTH = 3
# Candidate pairs up to which a cell stays whole.
DENSE_PAIRS = 100_000


def point_pairs(
    queries: DataFrame, points: DataFrame, radius_m: float, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """All (query, point) pairs within ``radius_m`` with ``distance_m``.

    ``queries`` carries q_lon/q_lat and ``points`` lon/lat; other column names
    must differ. Rows without coordinates are in no pair.
    """
    placed, visits = routed_sides(queries, points, radius_m, hot_rows)
    # The box test is cheap and drops most candidates before any trigonometry.
    near = (F.abs(F.col("lon") - F.col("q_lon")) <= F.col("_reach")) & (
        F.abs(F.col("lat") - F.col("q_lat")) <= geo.cell_size(radius_m)[1])
    met = placed.join(visits, PIECE).filter(near)
    distance = geo.distance_m(F.col("q_lon"), F.col("q_lat"), F.col("lon"), F.col("lat"))
    return _within(met, distance, radius_m).drop("_reach", *PIECE)


LEAF = ["_level", "_x", "_y"]
PIECE = [*LEAF, "_point_part", "_query_part"]


def routed_sides(queries: DataFrame, points: DataFrame, radius_m: float, hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Points and queries with the piece (``PIECE``) of an adaptive quadtree in which they meet.

    Rows of both sides are counted per finest cell, and queries with the same window of cells are counted as one.
    From root cells down, a cell is split while its candidate pairs exceed ``DENSE_PAIRS`` or a side ``hot_rows``.
    A query goes only to those leaves that hold points in its window, most often one or two; a point goes to its leaf,
    or nowhere if no query asks for it. A leaf that is as small as the radius and still holds more than ``hot_rows`` of
    a side is cut into hashed parts of that side, each of which meets all parts of the other. All but the last step works on
    tables of cells.
    """
    size = geo.cell_size(radius_m)
    cy = F.floor(F.col("q_lat") / F.lit(size[1])).cast("int")
    asked = (
        queries.filter(F.col("q_lon").isNotNull() & F.col("q_lat").isNotNull())
        .withColumn("_reach", geo.lon_reach(F.abs("q_lat"), radius_m, size)))
    west, east = _columns(F.col("q_lon"), F.col("q_lon"), F.col("_reach"), size)
    asked = asked.withColumns({"_west": west, "_east": east, "_row": cy})
    placed = with_cell(points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()), size)
    window = ["_west", "_east", "_row"]
    spots = cut_lineage(placed.groupBy(*CELL).agg(F.count("*").alias("_n")))
    windows = cut_lineage(asked.groupBy(*window).agg(F.count("*").alias("_n")))

    up = lambda name: F.expr(f"shiftright({name}, {DEPTH} - _level)")
    level = F.explode(F.sequence(F.lit(0), F.lit(DEPTH))).alias("_level")
    both = spots.select(*CELL, F.col("_n").alias("_p"), F.lit(0).cast("bigint").alias("_q")).unionByName(
        windows.select(F.expr("shiftright(_west + _east, 1)").alias("cx"), F.col("_row").alias("cy"), F.lit(0).cast("bigint").alias("_p"), F.col("_n").alias("_q")))
    cells = both.select("*", level).withColumns({"_x": up("cx"), "_y": up("cy")}).groupBy(*LEAF).agg(F.sum("_p").alias("_p"), F.sum("_q").alias("_q"))
    light = (F.col("_p").cast("double") * F.col("_q") <= DENSE_PAIRS) & (F.greatest("_p", "_q") <= hot_rows)
    whole = cells.filter(light | (F.col("_level") == DEPTH)).select(*LEAF)
    leaves = (
        spots.select("*", level).withColumns({"_x": up("cx"), "_y": up("cy")}).join(whole, LEAF)
        .groupBy(*CELL, "_n").agg(F.min("_level").alias("_level")).withColumns({"_x": up("cx"), "_y": up("cy")}))

    met = (
        windows.withColumn("cx", _around(F.col("_west"), F.col("_east"))).withColumn("cy", _around(F.col("_row") - 1, F.col("_row") + 1))
        .join(leaves.drop("_n"), CELL).select(*window, "_n", *LEAF).distinct())
    parts = lambda rows: F.ceil(F.sum(rows) / F.lit(hot_rows)).cast("int")
    loads = leaves.groupBy(*LEAF).agg(parts("_n").alias("_point_parts")).join(met.groupBy(*LEAF).agg(parts("_n").alias("_query_parts")), LEAF)
    routes = met.drop("_n").join(loads, LEAF).groupBy(*window).agg(F.collect_list(F.struct(*LEAF, "_point_parts", "_query_parts")).alias("_leaves"))
    homes = leaves.join(loads, LEAF).select(*CELL, *LEAF, "_point_parts", "_query_parts")

    each = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    part = lambda columns, count: F.pmod(F.xxhash64(*columns), F.col(count)).cast("int")
    held = (
        salted_join(placed, homes, CELL, points.columns, hot_rows, spots)
        .withColumn("_point_part", part(points.columns, "_point_parts")).withColumn("_query_part", each("_query_parts")))
    sent = (
        salted_join(asked, routes, window, queries.columns, hot_rows, windows)
        .withColumn("_leaf", F.explode("_leaves")).select(*queries.columns, "_reach", "_leaf.*")
        .withColumn("_query_part", part(queries.columns, "_query_parts")).withColumn("_point_part", each("_point_parts")))
    return held.select(*points.columns, *PIECE), sent.select(*queries.columns, "_reach", *PIECE)


def _columns(west: Column, east: Column, reach: Column, size: tuple[float, float]) -> tuple[Column, Column]:
    """First and last grid column within ``reach`` of a span of longitudes."""
    return tuple(F.floor(x / F.lit(size[0])).cast("int") for x in (west - reach, east + reach))


# Nested square grids for nearest-neighbour search, in degrees: each level is
# four times coarser. On the last but one, neighbours span any pair of valid
# coordinates (0.005 * 4**8 = 327 degrees), so every point finds a line. Levels
# below 0 are added where lines lie denser than that, see ``_finest_level``.
LEVELS = 10
FINEST_DEGREES = 0.005
# Cells of the finest level along a line piece of mean length, at most.
PIECE_CELLS = 64


def _cell_degrees(level: Column) -> Column:
    return F.lit(FINEST_DEGREES) * F.pow(F.lit(4.0), level)


def _level_cell(value: Column, level: Column) -> Column:
    return F.floor(value / _cell_degrees(level)).cast("int")


def _finest_level(edges: DataFrame) -> int:
    """0, or the negative level whose cells are about as wide as ends of ``edges`` lie apart."""
    e, low, high = F.col("edge"), F.least, F.greatest
    width = F.max(high(e["x1"], e["x2"])) - F.min(low(e["x1"], e["x2"]))
    height = F.max(high(e["y1"], e["y2"])) - F.min(low(e["y1"], e["y2"]))
    length = F.avg(high(F.abs(e["x2"] - e["x1"]), F.abs(e["y2"] - e["y1"])))
    row = edges.agg(F.count("*").alias("n"), width.alias("w"), height.alias("h"), length.alias("l")).first()
    if not row["n"] or not row["l"] or not row["w"] or not row["h"]:
        return 0
    apart = (row["w"] * row["h"] / row["n"]) ** 0.5
    finer = min(math.ceil(math.log(FINEST_DEGREES / apart, 4)) + 1, math.floor(math.log(FINEST_DEGREES * PIECE_CELLS / row["l"], 4)))
    return -max(0, finer)


def _edge_cells(edges: DataFrame) -> DataFrame:
    """``edges`` (edge, level) repeated over the cells of their level that they pass through and the neighbours of these.

    Rows are taken per column, from the part of the edge over the column and its neighbours, so a slanting
    edge does not fill its bounding box; a thousandth of a cell more on each side covers rounding.
    """
    e, size = F.col("edge"), _cell_degrees(F.col("level"))
    x1, y1, x2, y2 = (e[n] for n in ("x1", "y1", "x2", "y2"))
    west, east = F.least(x1, x2), F.greatest(x1, x2)
    low, high = F.least(y1, y2), F.greatest(y1, y2)
    columns = edges.withColumn("cx", _around(_level_cell(west, F.col("level")) - 1, _level_cell(east, F.col("level")) + 1))
    at = lambda x: y1 + (x - x1) * F.try_divide(y2 - y1, x2 - x1)
    columns = columns.withColumns({
        "_a": at(F.greatest(west, (F.col("cx") - 1) * size)), "_b": at(F.least(east, (F.col("cx") + 2) * size)), "_size": size})
    steep = east - west <= F.col("_size")
    first = F.when(steep, low).otherwise(F.least("_a", "_b")) - F.col("_size") * 0.001
    last = F.when(steep, high).otherwise(F.greatest("_a", "_b")) + F.col("_size") * 0.001
    rows = columns.withColumns({
        "_first": F.floor(first / F.col("_size")).cast("int") - 1, "_last": F.floor(last / F.col("_size")).cast("int") + 1})
    return rows.withColumn("cy", _around(F.col("_first"), F.col("_last"))).drop("_a", "_b", "_size", "_first", "_last")


def nearest_line(
    points: DataFrame, lines: DataFrame, point_id: str, line_id: str, line: str = "line", metric: str = "degree"
) -> DataFrame:
    """Closest line per point: ``point_id``, ``line_id``, ``distance_m``.

    1. Every end of a line piece marks its cell and the neighbours on each level.
       The finest level follows the density of the lines.
    2. A point takes the finest marked level of its own cell: a line is then at
       most two cells away in each direction.
    3. That bound fits into one cell of the next coarser level, so the point
       meets all possible winners in the nine cells there. Lines are repeated
       over these cells, points are not.
    4. The smallest value per point is a hash aggregate; a second meeting finds the line that has it, so
       the candidates are neither sorted nor written.
    ``metric='degree'`` ranks by raw coordinates and reports metres;
    ``metric='metre'`` ranks by metres. Ties go to the smaller id. Points are
    absent only where there is no line at all.
    """
    located = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    drawn = lines.filter(F.col(line).isNotNull()).select(line_id, line)
    e = F.col("edge")
    edges = cut_lineage(
        drawn.select(line_id, F.explode(geo.edges_of(F.col(line), closed=False)).alias("edge"))
        .filter(e["x1"].isNotNull() & e["y1"].isNotNull() & e["x2"].isNotNull() & e["y2"].isNotNull()))
    finest = _finest_level(edges)
    level, levels = F.col("level"), F.explode(F.sequence(F.lit(finest), F.lit(LEVELS - 2)))
    ends = F.array(F.struct(e["x1"].alias("lon"), e["y1"].alias("lat")), F.struct(e["x2"].alias("lon"), e["y2"].alias("lat")))
    marks = (
        edges.select(F.explode(ends).alias("v")).distinct()
        .select("v", levels.alias("level"))
        .select("level", _level_cell(F.col("v.lon"), level).alias("mx"), _level_cell(F.col("v.lat"), level).alias("my"))
        .distinct()
        .withColumn("cx", _around(F.col("mx") - 1, F.col("mx") + 1))
        .withColumn("cy", _around(F.col("my") - 1, F.col("my") + 1))
        .select("level", *CELL).distinct())
    keyed = located.select(point_id, F.col("lon").alias("p_lon"), F.col("lat").alias("p_lat"))
    marked = (
        keyed.withColumn("level", levels)
        .withColumn("cx", _level_cell(F.col("p_lon"), level)).withColumn("cy", _level_cell(F.col("p_lat"), level))
        .join(marks, ["level", *CELL]))
    leveled = cut_lineage(
        marked.groupBy(point_id).agg(
            (F.min("level") + 1).alias("level"), F.first("p_lon").alias("p_lon"), F.first("p_lat").alias("p_lat"))
        .withColumn("cx", _level_cell(F.col("p_lon"), level)).withColumn("cy", _level_cell(F.col("p_lat"), level)))
    counts = cut_lineage(leveled.groupBy("level", *CELL).agg(F.count("*").alias("_n")))
    used = sorted(r["level"] for r in counts.select("level").distinct().collect())  # a number per level at most
    at_levels = F.explode(F.array(*map(F.lit, used)).cast("array<int>"))
    # cells without a point meet nobody
    pieces = cut_lineage(_edge_cells(edges.withColumn("level", at_levels)).join(counts.drop("_n"), ["level", *CELL], "left_semi"))
    by = "metres" if metric == "metre" else "degrees"

    def met(asked: DataFrame) -> DataFrame:
        return geo.with_edge_distance(
            salted_join(asked, pieces, ["level", *CELL], [point_id], counts=counts), "p_lon", "p_lat", "edge", "metres", "degrees")

    least = met(leveled).groupBy(*leveled.columns).agg(F.min(by).alias("least"))
    # through a one-element explode, see ``_within``
    hits = met(least).withColumn("_by", F.explode(F.array(by))).filter(F.col("_by").eqNullSafe(F.col("least")))
    return (
        hits.groupBy(point_id, line_id).agg(F.min("metres").alias("metres"))
        .groupBy(point_id).agg(F.min(F.struct(F.col(line_id).alias("line"), F.col("metres"))).alias("hit"))
        .select(point_id, F.col("hit.line").alias(line_id), F.col("hit.metres").alias("distance_m")))
