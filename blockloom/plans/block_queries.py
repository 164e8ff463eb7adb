"""Queries of block metrics over the proxy city, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import histogram_divergence
from ..operators import metrics as M
from ..operators import tables as R
from ..sources.staging import staged
from . import proxy as P
from .proxy import PROXY_SQL, rounded, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(*names: str) -> str:
    """SQL that rounds columns to 6 digits, without a negative zero."""
    return ", ".join(f"round({n}, 6) + 0.0 AS {n.split('.')[-1]}" for n in names)


def near_road(spark: SparkSession, d: str) -> DataFrame:
    return M.distances(P.buildings(spark, d).select("city", "building_id", "x", "y", "label"), P.segments(spark, d))


@query(PROXY_SQL + f"SELECT city, building_id, round(d, 6) AS distance_to_nearest_road FROM distance")
def nearest_road_distance(spark, d):
    return rounded(near_road(spark, d).select("city", "building_id", "distance_to_nearest_road"))


ACCESS = """, access AS (
    SELECT k.city, k.block_id, count(d.d) AS n_buildings, coalesce(sum(d.d), 0) AS sum_distance, count(*) FILTER (WHERE d.d <= 20) AS n_closer_20m
    FROM block k LEFT JOIN held h ON h.city = k.city AND h.block_id = k.block_id LEFT JOIN distance d ON d.city = h.city AND d.building_id = h.building_id GROUP BY k.city, k.block_id
), raw1 AS (SELECT *, n_buildings > 0 AS has_buildings, n_closer_20m / nullif(CAST(n_buildings AS DOUBLE), 0) AS m1, coalesce(sum_distance / nullif(CAST(n_buildings AS DOUBLE), 0), 0) AS m2_raw FROM access
), m12 AS (SELECT *, coalesce(m1, median(m1) OVER (PARTITION BY city), 0) AS m1_raw FROM raw1)
"""


@query(PROXY_SQL + ACCESS + f"SELECT city, block_id, n_buildings, {r('sum_distance')}, n_closer_20m, has_buildings, {r('m1_raw', 'm2_raw')}, round(m1_raw, 6) + 0.0 AS m1_std, round(1 - least(m2_raw, 100) / 100, 6) + 0.0 AS m2_std FROM m12")
def m1_m2_road_access(spark, d):
    blocks = P.blocks(spark, d)
    pairs = M.buildings_in_blocks(near_road(spark, d).select("city", "building_id", "x", "y", "distance_to_nearest_road"), blocks)
    return rounded(M.road_access(pairs, blocks))


def base(spark, d) -> DataFrame:
    blocks = P.blocks(spark, d)
    return M.block_base(blocks, M.built_rectangles(M.rectangle_pieces(P.buildings(spark, d), blocks)), M.road_pieces(P.segments(spark, d), blocks), M.nodes_in_blocks(P.nodes(spark, d), blocks, 0.75))


BASE = """, raw AS (
    SELECT k.city, k.block_id, k.block_area, coalesce(f.built_area, 0) AS built_area, coalesce(f.n_buildings, 0) AS n_buildings, coalesce(p.total_len_m, 0) AS total_len_m,
        coalesce(n.n2, 0) AS n_intersections, coalesce(n.n3, 0) AS intersections_3plus, coalesce(n.n4, 0) AS intersections_4way
    FROM block k LEFT JOIN built f USING (city, block_id)
    LEFT JOIN (SELECT city, block_id, sum(length) AS total_len_m FROM piece GROUP BY city, block_id) p USING (city, block_id)
    LEFT JOIN (SELECT city, block_id, count(*) FILTER (WHERE street_count >= 2) AS n2, count(*) FILTER (WHERE street_count >= 3) AS n3, count(*) FILTER (WHERE street_count = 4) AS n4
        FROM node_block WHERE gap <= 0.75 GROUP BY city, block_id) n USING (city, block_id)
), base AS (
    SELECT *, total_len_m / 1000 / (block_area / 1e6) AS m3_raw, intersections_4way / nullif(CAST(intersections_3plus AS DOUBLE), 0) AS m4, n_intersections * 1e6 / block_area AS m5_raw,
        n_buildings * 1e6 / block_area AS m10_raw, built_area / block_area AS m11_raw, coalesce(built_area / nullif(CAST(n_buildings AS DOUBLE), 0), 0) AS m12_raw FROM raw
), based AS (SELECT *, coalesce(m4, median(m4) OVER (PARTITION BY city), 0) AS m4_raw FROM base)
"""


@query(PROXY_SQL + BASE + f"SELECT city, block_id, total_len_m > 0 AS has_roads, {r('road_length', 'm3_raw')}, round(least(m3_raw, 80) / 80, 6) AS m3_std FROM (SELECT *, total_len_m / 1000 AS road_length FROM based)")
def m3_road_density(spark, d):
    return rounded(base(spark, d).select("city", "block_id", "has_roads", "road_length", "m3_raw", "m3_std"))


@query(PROXY_SQL + BASE + f"SELECT city, block_id, intersections_3plus, intersections_4way, n_intersections > 0 AS has_intersections, {r('m4_raw')}, round(m4_raw, 6) AS m4_std FROM based")
def m4_fourway_share(spark, d):
    return rounded(base(spark, d).select("city", "block_id", "intersections_3plus", "intersections_4way", "has_intersections", "m4_raw", "m4_std"))


@query(PROXY_SQL + BASE + f"SELECT city, block_id, n_intersections, {r('m5_raw')}, round(least(m5_raw, 324) / 324, 6) AS m5_std FROM based")
def m5_intersection_density(spark, d):
    return rounded(base(spark, d).select("city", "block_id", "n_intersections", "m5_raw", "m5_std"))


@query(PROXY_SQL + BASE + f"SELECT city, block_id, block_area, round(built_area, 3) AS built_area, n_buildings, {r('m10_raw', 'm11_raw')}, round(m12_raw, 3) AS m12_raw, round(1 - least(m10_raw, 4000) / 4000, 6) + 0.0 AS m10_std, round(1 - m11_raw, 6) + 0.0 AS m11_std, round(least(m12_raw, 200) / 200, 6) AS m12_std FROM based")
def m10_m11_m12_saturation(spark, d):
    out = base(spark, d).select("city", "block_id", "block_area", "built_area", "n_buildings", "m10_raw", "m11_raw", "m12_raw", "m10_std", "m11_std", "m12_std")
    return rounded(out.withColumns({c: F.round(c, 3) for c in ("built_area", "m12_raw")}))  # of products of eight digits


KL = """, turned AS (SELECT city, block_id, least(17, CAST(floor(((label * 37 + building_id * 11) % 180) / {width}) AS INT)) AS bin FROM held WHERE (label * 37 + building_id * 11) % 180 <= {period}
), counted AS (SELECT city, block_id, bin, CAST(count(*) AS DOUBLE) AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY city, block_id) AS total FROM turned GROUP BY city, block_id, bin
), kl AS (SELECT city, block_id, sum(n / total * ln(n / total * 18)) / ln(18) AS kl FROM counted GROUP BY city, block_id)
"""


def turned(spark, d) -> DataFrame:
    pairs = M.buildings_in_blocks(P.buildings(spark, d).select("city", "building_id", "x", "y", "label"), P.blocks(spark, d))
    return pairs.withColumn("azimuth", ((F.col("label") * 37 + F.col("building_id") * 11) % 180).cast("double"))


@query(PROXY_SQL + KL.format(width=10.0, period=180) + ", joined AS (SELECT k.city, k.block_id, max_radius * 2 AS m7, kl FROM block k LEFT JOIN kl USING (city, block_id)), filled AS (SELECT city, block_id, coalesce(kl, median(kl) OVER w, 0) AS m6_raw, coalesce(m7, median(m7) OVER w, 200) AS m7_raw FROM joined WINDOW w AS (PARTITION BY city)) "
       + f"SELECT city, block_id, {r('m6_raw', 'm7_raw')}, round(m6_raw, 6) + 0.0 AS m6_std, round(1 - (least(greatest(m7_raw, 30), 200) - 30) / 170, 6) + 0.0 AS m7_std FROM filled")
def m6_m7_orientation_and_width(spark, d):
    return rounded(M.orientation_and_width(turned(spark, d), P.blocks(spark, d)))


@query("WITH a AS (SELECT user_id, least(17, CAST(floor((value * 7 - 180 * floor(value * 7 / 180)) / 10) AS INT)) AS bin FROM events), c AS (SELECT user_id, bin, CAST(count(*) AS DOUBLE) AS n, sum(CAST(count(*) AS DOUBLE)) OVER (PARTITION BY user_id) AS total FROM a GROUP BY user_id, bin) SELECT user_id, round(sum(n / total * ln(n / total * 18)) / ln(18), 6) + 0.0 AS m6_raw FROM c GROUP BY user_id")
def m6_orientation_kl(spark, d):
    rows = table(spark, d, "events").withColumn("azimuth", F.col("value") * 7.0 - 180.0 * F.floor(F.col("value") * 7.0 / 180.0))
    return rounded(histogram_divergence(rows, ["user_id"], "azimuth", 0.0, 180.0, 18, "m6_raw"))


@query(PROXY_SQL + KL.format(width=5.0, period=90) + "SELECT b.city, b.block_id, count(*) AS n_buildings, round(coalesce(max(kl), 0), 6) + 0.0 AS standardized_kl FROM held b LEFT JOIN kl USING (city, block_id) GROUP BY b.city, b.block_id")
def m6_kl_90(spark, d):
    rows = turned(spark, d)
    kl = histogram_divergence(rows, M.BLOCK, "azimuth", 0.0, 90.0, 18, "standardized_kl")
    out = rows.groupBy(*M.BLOCK).agg(F.count("*").alias("n_buildings")).join(kl, M.BLOCK, "left")
    return rounded(out.withColumn("standardized_kl", F.coalesce("standardized_kl", F.lit(0.0))))


STRAIGHT = "SELECT city, block_id, sum(least(1, sqrt((px1 - px0) ** 2 + (py1 - py0) ** 2) / length) * length) / sum(length) AS m8 FROM piece GROUP BY city, block_id"


def bent(spark, d) -> DataFrame:
    """Roads of two segments: from each node to its parent, and on to the parent's own."""
    s = P.segments(spark, d)
    second = s.select(F.col("u").alias("v"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    on = s.select("city", "road_id", "u", "v").join(second, "v").select("city", "road_id", "u", "v", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.col("dx").alias("bx"), F.col("dy").alias("by"))
    return s.select("city", "road_id", "u", "v", "ax", "ay", "bx", "by").union(on)


BENT = PROXY_SQL.replace(" segment AS (", " straight AS (", 1).replace("), cell AS (", "), segment AS (SELECT city, road_id, u, v, ax, ay, ex, ey FROM straight UNION ALL SELECT a.city, a.road_id, a.u, a.v, b.ax, b.ay, b.ex, b.ey FROM straight a JOIN straight b ON a.v = b.u\n), cell AS (", 1)


@query(BENT + f", s AS ({STRAIGHT}) SELECT city, block_id, round(coalesce(m8, 0), 6) AS m8_raw, round(greatest(coalesce(m8, 0), 0.9), 6) AS m8_std FROM block LEFT JOIN s USING (city, block_id)")
def m8_tortuosity(spark, d):
    blocks = P.blocks(spark, d)
    out = blocks.select(*M.BLOCK).join(M.straightness(M.road_pieces(bent(spark, d), blocks)), M.BLOCK, "left").na.fill(0.0, ["m8_raw"])
    return rounded(out.withColumn("m8_std", M.STANDARD["m8"](F.col("m8_raw"))))


@query(BENT + ", len AS (SELECT city, road_id, u, min(sqrt((ex - ax) ** 2 + (ey - ay) ** 2)) AS first, sum(sqrt((ex - ax) ** 2 + (ey - ay) ** 2)) AS length FROM segment GROUP BY city, road_id, u), far AS (SELECT a.city, a.road_id, a.u, b.v FROM straight a JOIN straight b ON a.v = b.u) "
       "SELECT f.city, f.road_id, round(l.length, 6) AS length, round(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), 6) AS straight_distance, round(CASE WHEN sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) > 0 THEN sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) / nullif(l.length, 0) END, 6) AS straightness "
       "FROM far f JOIN len l ON f.road_id = l.road_id LEFT JOIN node p ON p.osmid = f.u AND p.city = f.city LEFT JOIN node q ON q.osmid = f.v AND q.city = f.city")
def m8_straightness_endpoints(spark, d):
    s = P.segments(spark, d)
    far = s.select("city", "road_id", "u", "v").join(s.select(F.col("u").alias("v"), F.col("v").alias("end")), "v").select("city", "road_id", "u", F.col("end").alias("v"))
    length = bent(spark, d).groupBy("road_id").agg(F.sum(F.sqrt(F.pow(F.col("bx") - F.col("ax"), 2) + F.pow(F.col("by") - F.col("ay"), 2))).alias("length"))
    out = M.end_to_end_straightness(far.join(length, "road_id"), P.nodes(spark, d))
    return rounded(out.select("city", "road_id", "length", "straight_distance", "straightness"))


def angles(spark, d) -> tuple[DataFrame, DataFrame]:
    n = P.nodes(spark, d)
    roads = P.segments(spark, d).select("city", "u", "v", F.col("bx").alias("ux2"), F.col("by").alias("uy2"), F.col("ax").alias("vx2"), F.col("ay").alias("vy2"))
    return n, M.node_bearings(roads, n)


@query(PROXY_SQL + "SELECT n.city, n.osmid, round((degrees(atan2(s.ey - n.y, s.ex - n.x)) % 360 + 360) % 360, 6) + 0.0 AS bearing FROM segment s JOIN node n ON s.u = n.osmid AND s.city = n.city UNION ALL SELECT n.city, n.osmid, round((degrees(atan2(s.ay - n.y, s.ax - n.x)) % 360 + 360) % 360, 6) + 0.0 FROM segment s JOIN node n ON s.v = n.osmid AND s.city = n.city")
def node_bearings(spark, d):
    return rounded(angles(spark, d)[1])


@query(PROXY_SQL + "SELECT city, osmid, round(average_angle, 6) AS average_angle FROM angle")
def m9_intersection_angle(spark, d):
    n, b = angles(spark, d)
    return rounded(M.right_angle_deviation(b, n))


@query(PROXY_SQL + f", s AS ({STRAIGHT}), nine AS (SELECT city, block_id, avg(average_angle) AS m9, count(average_angle) AS n FROM (SELECT DISTINCT city, block_id, osmid FROM node_block WHERE gap < 0.5) JOIN angle USING (city, osmid) GROUP BY city, block_id), "
       "joined AS (SELECT city, block_id, coalesce(m8, 0) AS m8_raw, coalesce(m9, median(m9) OVER (PARTITION BY city), 0) AS m9_raw, coalesce(n, 0) AS m9_n_intersections FROM block LEFT JOIN s USING (city, block_id) LEFT JOIN nine USING (city, block_id)) "
       + f"SELECT city, block_id, {r('m8_raw', 'm9_raw')}, m9_n_intersections, round(greatest(m8_raw, 0.9), 6) AS m8_std, round(1 - m9_raw / 90, 6) + 0.0 AS m9_std FROM joined")
def m8_m9_straightness_and_angles(spark, d):
    blocks, (n, b) = P.blocks(spark, d), angles(spark, d)
    return rounded(M.straightness_and_angles(blocks, M.road_pieces(P.segments(spark, d), blocks), M.nodes_in_blocks(n, blocks, 0.5, strict=True), M.right_angle_deviation(b, n)))


@query(PROXY_SQL + "SELECT city, block_id, osmid, 'both' AS side FROM node_block WHERE gap < 0.5 UNION ALL SELECT city, block_id, osmid, 'closed' FROM node_block WHERE gap <= 0.75")
def point_in_block_tolerance(spark, d):
    n, blocks = P.nodes(spark, d), P.blocks(spark, d)
    one = lambda gap, strict, name: M.nodes_in_blocks(n, blocks, gap, strict).select("city", "block_id", "osmid", F.lit(name).alias("side"))
    return one(0.5, True, "both").union(one(0.75, False, "closed"))


@query(PROXY_SQL + ", corner AS (SELECT *, unnest([x0, x0, x1, x1]) AS qx, unnest([y0, y1, y0, y1]) AS qy FROM inside JOIN block USING (city, block_id)), "
       "apart AS (SELECT city, block_id, road_id, min(CASE WHEN lo <= hi THEN 0 ELSE least(sqrt((qx - (ax + greatest(0, least(1, ((qx - ax) * (ex - ax) + (qy - ay) * (ey - ay)) / nullif((ex - ax) ** 2 + (ey - ay) ** 2, 0))) * (ex - ax))) ** 2 "
       "+ (qy - (ay + greatest(0, least(1, ((qx - ax) * (ex - ax) + (qy - ay) * (ey - ay)) / nullif((ex - ax) ** 2 + (ey - ay) ** 2, 0))) * (ey - ay))) ** 2), "
       "sqrt(greatest(x0 - ax, ax - x1, 0) ** 2 + greatest(y0 - ay, ay - y1, 0) ** 2), sqrt(greatest(x0 - ex, ex - x1, 0) ** 2 + greatest(y0 - ey, ey - y1, 0) ** 2)) END) AS d FROM corner GROUP BY city, block_id, road_id) "
       "SELECT city, block_id, count(*) AS n_roads FROM apart WHERE d <= 100 GROUP BY city, block_id")
def road_within_buffer(spark, d):
    near = M.roads_near_blocks(P.segments(spark, d), P.blocks(spark, d))
    return near.groupBy("city", "block_id").agg(F.count("*").alias("n_roads"))


KINDS = ["src1", "src2", "src3", "src5", "src7", "src11"]


@query("SELECT doc_id, coalesce(list_has_any(list_transform(string_split(source || ', ' || lang, ','), lambda t: trim(t)), ['src1', 'src2', 'src3', 'src5', 'src7', 'src11']), false) AS wanted FROM documents")
def highway_filter(spark, d):
    return table(spark, d, "documents").select("doc_id", M.road_class(F.concat("source", F.lit(", "), "lang"), KINDS).alias("wanted"))


@query(PROXY_SQL + ", kept AS (SELECT * FROM segment WHERE road_id % 4 <> 0), deg AS (SELECT osmid, count(*) AS degree FROM (SELECT u AS osmid FROM kept UNION ALL SELECT v FROM kept) GROUP BY osmid) SELECT n.city, n.osmid, n.street_count FROM node n JOIN deg USING (osmid) WHERE n.street_count = degree")
def degree_filter(spark, d):
    roads = P.segments(spark, d).withColumn("highway", F.when(F.col("road_id") % 4 != 0, "residential, service").otherwise("footway"))
    return M.network_nodes(roads, P.nodes(spark, d), ["residential", "primary"])[1].select("city", "osmid", "street_count")


OVERLAPS = """, share AS (SELECT l_partkey AS block_id, l_suppkey AS grid_id, sum(l_quantity) AS overlap_area, 10000.0::DOUBLE AS grid_area FROM lineitem GROUP BY l_partkey, l_suppkey
), weight AS (SELECT *, overlap_area / grid_area / sum(overlap_area / grid_area) OVER (PARTITION BY grid_id) AS area_weight FROM share)
"""


def overlaps(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("block_id"), F.col("l_suppkey").alias("grid_id")).agg(F.sum("l_quantity").alias("overlap_area")).withColumn("grid_area", F.lit(10_000.0))


@query("WITH x AS (SELECT 1)" + OVERLAPS + "SELECT block_id, grid_id, overlap_area, round(area_weight, 6) AS area_weight FROM weight")
def areal_weights(spark, d):
    return rounded(M.areal_weights(overlaps(spark, d)).select("block_id", "grid_id", "overlap_area", "area_weight"))


@query("WITH x AS (SELECT 1)" + OVERLAPS + "SELECT grid_id, round(sum(p_retailprice / 2000 * area_weight * p_size) / nullif(sum(area_weight * p_size), 0), 6) AS m6 FROM weight JOIN part ON p_partkey = block_id WHERE p_size % 7 <> 0 GROUP BY grid_id")
def aggregate_m6(spark, d):
    kl = table(spark, d, "part").select(F.col("p_partkey").alias("block_id"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice") / 2000.0).alias("standardized_kl"), F.col("p_size").alias("n_buildings"))
    return rounded(M.weighted_divergence(M.areal_weights(overlaps(spark, d)), kl))


@query(PROXY_SQL + "SELECT city, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(count(*) AS BIGINT) AS n FROM block GROUP BY city")
def total_bounds(spark, d):
    b = P.blocks(spark, d)
    return b.groupBy("city").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


@query(PROXY_SQL + ACCESS + BASE + KL.format(width=10.0, period=180) + ", six AS (SELECT k.city, k.block_id, max_radius * 2 AS m7, kl FROM block k LEFT JOIN kl USING (city, block_id)), m67 AS (SELECT city, block_id, coalesce(kl, median(kl) OVER w, 0) AS m6_raw, coalesce(m7, median(m7) OVER w, 200) AS m7_raw FROM six WINDOW w AS (PARTITION BY city)) "
       "SELECT b.city, b.block_id, b.n_buildings, round(m1_raw, 6) AS m1_raw, round(1 - least(m2_raw, 100) / 100, 6) + 0.0 AS m2_std, round(b.m3_raw, 6) AS m3_raw, round(b.m12_raw, 3) AS m12_raw, round(m6_raw, 6) + 0.0 AS m6_std, round(1 - (least(greatest(m7_raw, 30), 200) - 30) / 170, 6) + 0.0 AS m7_std "
       "FROM based b JOIN m12 a USING (city, block_id) JOIN m67 USING (city, block_id)")
def consolidate_metrics(spark, d):
    """Every group's raw rows are written once, as are the tables that several groups read."""
    buildings, blocks = staged(P.buildings(spark, d).drop("hw", "hh")), staged(P.blocks(spark, d))
    segments = staged(P.segments(spark, d))
    near = M.distances(buildings.select("city", "building_id", "x", "y", "label"), segments)
    pairs = staged(M.buildings_in_blocks(near, blocks).withColumn("azimuth", ((F.col("label") * 37 + F.col("building_id") * 11) % 180).cast("double")))
    nodes = M.nodes_in_blocks(P.nodes(spark, d), blocks, 0.75)
    built = M.built_rectangles(staged(M.rectangle_pieces(buildings, blocks)))
    groups = [
        M.block_base(blocks, built, M.road_pieces(segments, blocks), nodes, stage=staged),
        M.road_access(pairs, blocks, stage=staged),
        M.orientation_and_width(pairs, blocks, stage=staged),
    ]
    out = R.consolidate(groups, M.BLOCK)
    return rounded(out.select("city", "block_id", "n_buildings", "m1_raw", "m2_std", "m3_raw", F.round("m12_raw", 3).alias("m12_raw"), "m6_std", "m7_std"))
