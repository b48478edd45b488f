"""Shapes of any number of rings as covers of classified grid cells, and distance joins on them.

A shape is one ring (array of points) or several (array of rings: the outer ones and the holes of all its
parts); a point is inside where a ray crosses the rings an odd number of times. The cover of a shape holds
the cells that reach within the radius of it, each of one kind:

* inside: no edge touches the cell and it lies in the shape, so every point there has distance 0;
* crossed: edges touch it; it carries whether its corner is inside, and a point's own side follows from the
  edges between it and the corner;
* outside: no edge touches it and it lies outside.

Crossed and outside cells carry only edges that can be the nearest for some point of the cell: those no farther
from its middle than the nearest one, give or take the cell's size. So a pair of shape and point meets in
one cell, once, and is tested against a few edges however long the rings are.

All work is per edge and per cell; a shape is never gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from parcelspark.functions import geo
from parcelspark.operators.skew import HOT_ROWS, salted_join

CELL = ["cx", "cy"]
#: Cells along the radius.
PER_RADIUS = 4
#: Grid lines stand off round coordinates by this, where vertices like to lie.
ORIGIN = (0.00031415926535, 0.00027182818284)
#: Bounds of metres per degree of latitude and per degree of longitude at the equator.
_LAT_M, _LON_M = (110_574.0, 111_694.0), 111_695.0
EDGE = ("x1", "y1", "x2", "y2")


def column_of(lon: Column, size: tuple[float, float]) -> Column:
    return F.floor((lon - F.lit(ORIGIN[0])) / F.lit(size[0])).cast("int")


def row_of(lat: Column, size: tuple[float, float]) -> Column:
    return F.floor((lat - F.lit(ORIGIN[1])) / F.lit(size[1])).cast("int")


def line_at(index: Column, axis: int, size: tuple[float, float]) -> Column:
    """Coordinate of the west (axis 0) or south (axis 1) border of a column or row."""
    return index.cast("double") * F.lit(size[axis]) + F.lit(ORIGIN[axis])


def _span(low: Column, high: Column) -> Column:
    return F.explode(F.sequence(low, high))


def shape_edges(areas: DataFrame, area_id: str, shape: str) -> DataFrame:
    """One row per edge of all rings of every shape; points without coordinates are left out, rings close themselves."""
    single = isinstance(areas.schema[shape].dataType.elementType, T.StructType)
    rings = areas.select(area_id, F.col(shape).alias("_ring")) if single else areas.select(area_id, F.explode(shape).alias("_ring"))
    filled = F.filter("_ring", lambda v: v["lon"].isNotNull() & v["lat"].isNotNull())
    rings = rings.select(area_id, filled.alias("_ring")).filter(F.size("_ring") > 0)
    return rings.select(area_id, F.explode(geo.edges_of(F.col("_ring"), closed=True)).alias("e")).select(area_id, "e")


def _near_cells(edges: DataFrame, area_id: str, radius_m: float, size: tuple[float, float]) -> DataFrame:
    """(area, cell, crossed, edges) of the cells within the radius of an edge, with the edges that can be nearest there."""
    e = F.col("e")
    south, north = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    up = radius_m * 1.000001 / _LAT_M[0]
    across = geo.lon_reach(F.greatest(F.abs(south), F.abs(north)), radius_m, geo.cell_size(radius_m))
    spread = (
        edges.withColumn("cx", _span(column_of(F.least(e["x1"], e["x2"]) - across, size), column_of(F.greatest(e["x1"], e["x2"]) + across, size)))
        .withColumn("cy", _span(row_of(south - up, size), row_of(north + up, size)))
        .withColumn("_clon", line_at(F.col("cx"), 0, size) + F.lit(size[0] / 2)).withColumn("_clat", line_at(F.col("cy"), 1, size) + F.lit(size[1] / 2)))
    # flat distances around the cell's middle are good to a hundredth within reach; each value is a column
    # of its own behind an explode, as the optimiser would repeat it wherever it is used
    c = F.col
    flat = spread.withColumn("_k", F.explode(F.array(F.cos(c("_clat") * F.lit(geo.RADIAN)) * F.lit(_LON_M))))
    flat = flat.withColumns({
        "_ax": (c("e.x1") - c("_clon")) * c("_k"), "_ay": (c("e.y1") - c("_clat")) * F.lit(_LAT_M[0]),
        "_bx": (c("e.x2") - c("e.x1")) * c("_k"), "_by": (c("e.y2") - c("e.y1")) * F.lit(_LAT_M[0])})
    along = F.try_divide(-(c("_ax") * c("_bx") + c("_ay") * c("_by")), c("_bx") * c("_bx") + c("_by") * c("_by"))
    flat = flat.withColumn("_t", F.explode(F.array(F.least(F.greatest(F.coalesce(along, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))))
    measured = flat.withColumn("_d", F.explode(F.array(F.hypot(c("_ax") + c("_t") * c("_bx"), c("_ay") + c("_t") * c("_by")))))
    half = F.hypot(c("_k") * F.lit(size[0] * 0.51), F.lit(size[1] * _LAT_M[1] / 2))
    measured = measured.withColumn("_low", c("_d") * 0.98 - half - 1.0).withColumn("_high", c("_d") * 1.02 + half + 1.0)
    cell = Window.partitionBy(area_id, *CELL)
    kept = (
        measured.filter(F.col("_low") <= radius_m).withColumn("_best", F.min("_high").over(cell)).filter(F.col("_low") <= F.col("_best")))
    return kept.groupBy(area_id, *CELL).agg(F.max(F.col("_low") <= 0).alias("crossed"), F.collect_list("e").alias("edges"))


def _odd_corners(edges: DataFrame, area_id: str, size: tuple[float, float]) -> DataFrame:
    """(area, cell) of the cells whose south-east corner is inside.

    Every edge crosses some of the rows' border lines; between two crossings of a line all corners are alike.
    """
    e = F.col("e")
    low, high = F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])
    at = line_at(F.col("cy"), 1, size)
    crossings = (
        edges.withColumn("cy", _span(row_of(low, size), row_of(high, size) + 1))
        .filter((e["y1"] > at) != (e["y2"] > at))
        .withColumn("_x", (e["x2"] - e["x1"]) * (at - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
        .groupBy(area_id, "cy", column_of(F.col("_x"), size).alias("_k")).agg(F.count("*").alias("_n")))
    eastward = Window.partitionBy(area_id, "cy").orderBy(F.desc("_k"))
    runs = crossings.withColumn("_sum", F.sum("_n").over(eastward)).withColumn("_next", F.lead("_k").over(eastward))
    return runs.filter((F.col("_sum") % 2 == 1) & (F.col("_next") < F.col("_k"))).select(
        area_id, _span(F.col("_next"), F.col("_k") - 1).alias("cx"), "cy")


def cover(areas: DataFrame, area_id: str, shape: str, radius_m: float) -> DataFrame:
    """(area_id, cx, cy, _kind, _corner, _edges) of every cell within ``radius_m`` of a shape; see the module's text."""
    size = geo.cell_size(radius_m / PER_RADIUS)
    edges = shape_edges(areas, area_id, shape)
    keys = [area_id, *CELL]
    odd = _odd_corners(edges, area_id, size).withColumn("corner", F.lit(True))
    cells = _near_cells(edges, area_id, radius_m, size).join(odd, keys, "full")
    corner = F.coalesce("corner", F.lit(False))
    kind = F.when(F.coalesce("crossed", F.lit(False)), "crossed").when(corner, "inside").otherwise("outside")
    return cells.withColumn("kind", kind).select(*keys, F.col("kind").alias("_kind"), corner.alias("_corner"), F.when(F.col("kind") != "inside", F.col("edges")).alias("_edges"))


def _other_side(lon: Column, lat: Column, east: Column, south: Column, e: Column) -> Column:
    """Whether an edge stands once between a point and its cell's south-east corner, going east and then south.

    At ties the point counts as a trifle higher, and the border as a trifle farther east, in all tests alike.
    """
    rise, run = F.signum(e["y2"] - e["y1"]), F.signum(e["x2"] - e["x1"])
    side = lambda y: F.signum((e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (east - e["x1"]))
    bend, corner = side(lat), side(south)
    before_border = (bend * rise < 0) | ((bend == 0) & (run * rise <= 0))
    eastward = geo.straddles_east(lon, lat, e) & before_border
    above = lambda s: (s * run > 0) | (s == 0)
    southward = ((e["x1"] > east) != (e["x2"] > east)) & above(bend) & ~above(corner)
    return eastward != southward


def _distances(met: DataFrame, keys: list[str], size: tuple[float, float]) -> DataFrame:
    """(keys, distance_m) of points (lon, lat) that met their cover cell, one row per pair; ``keys`` tell the pairs apart.

    A pair is opened into its few edges, which keeps the arithmetic in generated code; its rows sit in one task and
    are folded there, without a shuffle if ``keys`` hold the columns that dealt the points.
    """
    lon, lat, e = F.col("lon"), F.col("lat"), F.col("_e")
    east, south = line_at(F.col("cx") + 1, 0, size), line_at(F.col("cy"), 1, size)
    opened = met.withColumn("_e", F.explode_outer("_edges")).drop("_edges").withColumn("_east", east).withColumn("_south", south)
    flag = F.when(F.col("_kind") == "crossed", _other_side(lon, lat, F.col("_east"), F.col("_south"), e).cast("int")).otherwise(F.lit(0))
    measured = geo.with_edge_distance(opened, "lon", "lat", "_e", "_d").withColumn("_flag", flag)
    odd = F.sum("_flag") % 2 == 1
    # the greatest of a text would make it a sort aggregate
    kind = lambda name: F.max(F.col("_kind") == name)
    inside = F.when(kind("crossed"), odd != F.max("_corner")).otherwise(kind("inside"))
    return measured.groupBy(*keys).agg(F.when(inside, F.lit(0.0)).otherwise(F.min("_d")).alias("distance_m"))


def area_point_pairs(
    areas: DataFrame, points: DataFrame, radius_m: float, point_id: str,
    polygon: str = "polygon", hot_rows: int = HOT_ROWS, area_id: str | None = None,
) -> DataFrame:
    """(area, point) pairs within ``radius_m`` of the shape; inside gives 0.

    Returns all area and point columns but the geometry, plus ``distance_m``. ``area_id``, by default the first
    column, tells areas apart. Points stay in their own cell and crowded cells are salted. Attributes ride along as
    grouping columns, so that the closing aggregate stays a hash aggregate; cell and salt are among them, so the points are
    shuffled once and the pairs not at all. ``point_id`` and the other columns of a point tell its place.
    """
    area_id = area_id or areas.columns[0]
    size = geo.cell_size(radius_m / PER_RADIUS)
    cells = cover(areas.filter(F.col(polygon).isNotNull()), area_id, polygon, radius_m)
    others = areas.drop(polygon)
    if len(others.columns) > 1:
        cells = cells.join(others, area_id)
    placed = points.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn(
        "cx", column_of(F.col("lon"), size)).withColumn("cy", row_of(F.col("lat"), size))
    met = salted_join(placed, cells, CELL, [point_id], hot_rows, keep_salt=True)
    keys = [*others.columns, *[c for c in points.columns if c not in ("lon", "lat")]]
    return _distances(met, [*CELL, "_salt", *keys], size).filter(F.col("distance_m") <= radius_m).select(*keys, "distance_m")


def area_line_pairs(
    areas: DataFrame, lines: DataFrame, radius_m: float, area_id: str, line_id: str,
    polygon: str = "polygon", line: str = "line",
) -> DataFrame:
    """(area, line) pairs within ``radius_m`` with all columns of both and ``distance_m``; crossing or containment gives 0.

    A line's points are tested like any point. Its pieces meet the edges of the cells that they pass: where
    the two come closest, the nearest edge is listed in the cell of that point of the line.
    """
    size = geo.cell_size(radius_m / PER_RADIUS)
    shapes = areas.filter(F.col(polygon).isNotNull())
    cells = cover(shapes, area_id, polygon, radius_m)
    drawn = lines.filter(F.size(line) > 0).select(line_id, F.filter(line, lambda v: v["lon"].isNotNull() & v["lat"].isNotNull()).alias("_line"))
    # a point of the line is a piece without length: both kinds meet the cells in one join
    dot = lambda v: F.struct(v["lon"].alias("x1"), v["lat"].alias("y1"), v["lon"].alias("x2"), v["lat"].alias("y2"))
    kinds = F.array(F.struct(F.lit(True).alias("dot"), F.transform("_line", dot).alias("gs")), F.struct(F.lit(False).alias("dot"), geo.edges_of(F.col("_line"), closed=False).alias("gs")))
    visits = drawn.select(line_id, F.explode(kinds).alias("_kinds")).select(line_id, F.col("_kinds.dot").alias("_dot"), F.explode("_kinds.gs").alias("g"))
    g, e = F.col("g"), F.col("e")
    visits = visits.withColumn("cx", _span(column_of(F.least(g["x1"], g["x2"]), size), column_of(F.greatest(g["x1"], g["x2"]), size))).withColumn(
        "cy", _span(row_of(F.least(g["y1"], g["y2"]), size), row_of(F.greatest(g["y1"], g["y2"]), size)))
    met = salted_join(visits, cells, CELL, [line_id, "g"]).filter(F.col("_dot") | (F.col("_kind") != "inside"))
    met = met.withColumn("e", F.explode_outer("_edges")).drop("_edges")
    # a dot is measured to the edge, the ends of the edge to a piece
    task = lambda x, y, piece: F.struct(x.alias("x"), y.alias("y"), piece.alias("piece"))
    tasks = F.when(F.col("_dot"), F.array(task(g["x1"], g["y1"], e))).otherwise(F.array(task(e["x1"], e["y1"], g), task(e["x2"], e["y2"], g)))
    opened = met.withColumn("_task", F.explode(tasks)).withColumn("_x", F.col("_task.x")).withColumn("_y", F.col("_task.y")).withColumn("_p", F.col("_task.piece"))
    opened = opened.withColumn("_east", line_at(F.col("cx") + 1, 0, size)).withColumn("_south", line_at(F.col("cy"), 1, size))
    side = _other_side(F.col("_x"), F.col("_y"), F.col("_east"), F.col("_south"), e).cast("int")
    measured = geo.with_edge_distance(opened, "_x", "_y", "_p", "_d").withColumn("_flag", F.when(F.col("_dot") & (F.col("_kind") == "crossed"), side).otherwise(F.lit(0)))
    measured = measured.withColumn("_d", F.when(~F.col("_dot") & geo.crosses(e, g), F.lit(0.0)).otherwise(F.col("_d")))
    folded = measured.groupBy(area_id, line_id, "_dot", F.when(F.col("_dot"), g).alias("g")).agg(
        F.min("_d").alias("_d"), (F.sum("_flag") % 2 == 1).alias("_odd"), F.max("_kind").alias("_kind"), F.max("_corner").alias("_corner"))
    inside = F.col("_dot") & F.when(F.col("_kind") == "crossed", F.col("_odd") != F.col("_corner")).otherwise(F.col("_kind") == "inside")
    nearest = folded.groupBy(area_id, line_id).agg(F.min(F.when(inside, F.lit(0.0)).otherwise(F.col("_d"))).alias("distance_m")).filter(F.col("distance_m") <= radius_m)
    return nearest.join(shapes, area_id).join(lines, line_id).select(*[c for c in lines.columns], *[c for c in areas.columns], "distance_m")
