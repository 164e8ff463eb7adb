"""Queries of the geometry kernels over the proxy city, with SQL where the shapes' measures are known in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import geometry as G
from ..operators import metrics as M
from . import proxy as P
from .proxy import PROXY_SQL, rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def upright(df: DataFrame) -> DataFrame:
    return df.withColumn("geometry", G.rectangle_wkb("x0", "y0", "x1", "y1", F.lit(0.0)))


def road_lines(spark, d) -> DataFrame:
    s = P.segments(spark, d)
    ends = F.array(F.struct(F.col("ax").alias("x"), F.col("ay").alias("y")), F.struct(F.col("bx").alias("x"), F.col("by").alias("y")))
    return G.with_box(s.select("city", "road_id", G.line_wkb(ends).alias("geometry")))


@query(PROXY_SQL + "SELECT city, building_id, round((label * 17 + building_id % 80 + 0.25::DOUBLE) % 90, 6) AS azimuth FROM building")
def mbr_azimuth(spark, d):
    b = P.buildings(spark, d)
    angle = (F.col("label") * 17 + F.col("building_id") % 80 + 0.25).cast("double")
    shape = G.rectangle_wkb(F.col("x0"), F.col("y0"), F.col("x1") + 1.0, F.col("y1"), angle)
    return rounded(b.select("city", "building_id", G.rectangle_azimuth(shape).alias("azimuth")))


@query(PROXY_SQL + "SELECT city, building_id, round(least(hw, hh), 6) AS max_radius FROM building")
def inscribed_circle(spark, d):
    out = G.with_inscribed_circles(upright(P.buildings(spark, d)))
    return rounded(out.select("city", "building_id", "max_radius"))


@query(PROXY_SQL + "SELECT city, block_id, building_id, round((px1 - px0) * (py1 - py0), 4) AS area FROM footprint WHERE (px1 - px0) * (py1 - py0) > 0.001")
def polygon_overlay_area(spark, d):
    out = G.clipped_footprints(upright(P.buildings(spark, d)), upright(P.blocks(spark, d)))
    return rounded(out.where("area > 0.001"), 4)


@query(PROXY_SQL + "SELECT city, block_id, round(built_area, 3) AS built_area, n_buildings FROM built")
def polygon_built_area(spark, d):
    """The union of footprints of any shape, over the upright ones."""
    return rounded(G.built_polygons(upright(P.buildings(spark, d)), upright(P.blocks(spark, d))), 3)


@query(PROXY_SQL + ", grid AS (SELECT DISTINCT city, CAST(floor(x / 70) AS BIGINT) AS gx, CAST(floor(y / 70) AS BIGINT) AS gy FROM building), lap AS (SELECT k.city, k.block_id, (gx + 1000) * 10000 + gy + 1000 AS grid_id, (least(k.x1, gx * 70.0::DOUBLE + 70) - greatest(k.x0, gx * 70.0::DOUBLE)) * (least(k.y1, gy * 70.0::DOUBLE + 70) - greatest(k.y0, gy * 70.0::DOUBLE)) AS a FROM block k JOIN grid g ON g.city = k.city AND k.x0 < gx * 70 + 70 AND k.x1 > gx * 70 AND k.y0 < gy * 70 + 70 AND k.y1 > gy * 70) "
       "SELECT city, block_id, grid_id, round(a, 3) AS overlap_area, 4900.0::DOUBLE AS grid_area FROM lap")
def polygon_areal_overlaps(spark, d):
    """Blocks laid over a grid of 70 m."""
    at = lambda c: F.floor(F.col(c) / 70.0)
    g = P.buildings(spark, d).select("city", at("x").alias("gx"), at("y").alias("gy")).distinct()
    box = {"x0": F.col("gx") * 70.0, "y0": F.col("gy") * 70.0, "x1": (F.col("gx") + 1) * 70.0, "y1": (F.col("gy") + 1) * 70.0}
    grid = g.withColumns({**box, "grid_id": (F.col("gx") + 1000) * 10000 + F.col("gy") + 1000}).drop("gx", "gy")
    return rounded(G.areal_overlaps(upright(P.blocks(spark, d)), upright(grid)), 3)


@query(PROXY_SQL + "SELECT city, building_id, round(4 * hw * hh + 4 * (hw + hh) * 5 + 32 * 25 * sin(pi() / 32), 3) AS outer_area, round(greatest(2 * hw - 1, 0) * greatest(2 * hh - 1, 0), 3) AS inner_area FROM building")
def polygon_buffer(spark, d):
    """Footprints with 5 m around, their corners round, and without half a metre at the edge."""
    b = G.spread(upright(P.buildings(spark, d)), "building_id")
    area = lambda c: F.coalesce(G.measures(c)["area"], F.lit(0.0))
    return rounded(b.select("city", "building_id", area(G.buffered(F.col("geometry"), 5.0)).alias("outer_area"), area(G.buffered(F.col("geometry"), -0.5)).alias("inner_area")), 3)


@query(PROXY_SQL + "SELECT city, block_id, road_id, round(length, 3) AS length FROM piece WHERE length > 0.01")
def clipped_road_length(spark, d):
    out = G.clipped_roads(road_lines(spark, d), upright(P.blocks(spark, d)))
    return rounded(out.where("length > 0.01").select("city", "block_id", "road_id", "length"), 3)


@query(PROXY_SQL + ", span AS (SELECT city, min(cx) AS a, max(cx) + 1 AS b, min(cy) AS c, max(cy) + 1 AS d FROM cell GROUP BY city) SELECT city, CAST((b - a) * (d - c) AS BIGINT) AS n_blocks, round((b - a) * (d - c) * 10000.0::DOUBLE, 3) AS total_area, 50.0::DOUBLE AS least_radius FROM span")
def polygonize_blocks(spark, d):
    b = P.blocks(spark, d).groupBy("city").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    steps = lambda a, z: F.sequence(F.lit(0), F.round((F.col(z) - F.col(a)) / P.SIDE).cast("int"))
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    x, y = F.col("x0") + F.col("i") * P.SIDE, F.col("y0") + F.col("i") * P.SIDE
    up = b.withColumn("i", F.explode(steps("x0", "x1"))).select("city", F.array(point(x, F.col("y0") - 10.0), point(x, F.col("y1") + 10.0)).alias("p"))
    across = b.withColumn("i", F.explode(steps("y0", "y1"))).select("city", F.array(point(F.col("x0") - 10.0, y), point(F.col("x1") + 10.0, y)).alias("p"))
    lines = G.with_box(up.union(across).select("city", G.line_wkb(F.col("p")).alias("geometry")))
    out = G.with_inscribed_circles(G.polygonize(lines)).withColumn("area", G.measures("geometry")["area"])
    return rounded(out.groupBy("city").agg(F.count("*").alias("n_blocks"), F.sum("area").alias("total_area"), F.min("max_radius").alias("least_radius")), 3)


@query(PROXY_SQL + ", gone AS (SELECT b.city, b.building_id, sqrt(greatest(b.x0 - (b.x0 + 50 * b.label), 0) ** 2) AS z FROM building b) SELECT b.city, b.building_id, round(CAST(50 * (b.label + 1) AS DOUBLE) - 2 * b.hw, 6) AS gap FROM building b WHERE 50 * (b.label + 1) > 2 * b.hw")
def polygon_distance(spark, d):
    b = P.buildings(spark, d)
    shift = (F.col("label") + 1) * 50.0
    there = G.rectangle_wkb(F.col("x0") + shift, F.col("y0"), F.col("x1") + shift, F.col("y1"), F.lit(0.0))
    here = G.rectangle_wkb("x0", "y0", "x1", "y1", F.lit(0.0))
    return rounded(b.where(shift > F.col("hw") * 2.0).select("city", "building_id", G.shape_distance(here, there).alias("gap")))


@query()
def k_layers(spark, d):
    out = G.parcel_layers(upright(P.blocks(spark, d)), P.buildings(spark, d).select("city", "x", "y"), road_lines(spark, d))
    return rounded(out, 3)


@query()
def city_blocks(spark, d):
    """Blocks out of the roads of the proxy city, with a lake and fill up to the city's box."""
    lines = road_lines(spark, d).select("city", "geometry")
    box = M.segment_box(P.segments(spark, d)).groupBy("city").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    shape = lambda a, b, c, e: G.rectangle_wkb(a, b, c, e, F.lit(0.0)).alias("geometry")
    extent = box.select("city", shape(F.col("x0") - 50.0, F.col("y0") - 50.0, F.col("x1") + 50.0, F.col("y1") + 50.0))
    lake = box.select("city", shape(F.col("x0"), F.col("y0"), F.col("x0") + 60.0, F.col("y0") + 60.0))
    out = G.produce_blocks(lines, extent, water=lake)
    return rounded(out.select("city", "block_id", "is_fill_block", "fill_method", "block_area", "max_radius"), 2)
