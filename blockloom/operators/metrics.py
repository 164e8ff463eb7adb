"""The thirteen block metrics as lazy plans over all cities at once, keyed by city and block.

Blocks are rows (city, block_id, box columns, block_area); buildings (city, building_id, x, y, ...); road segments
(city, road_id, ax, ay, bx, by); nodes (city, osmid, x, y, street_count). Pieces of roads and footprints inside blocks
come from the rectangle forms below, or from the polygon kernels of ``blockloom.geom``, with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import at_most, azimuth, fill_median, histogram_divergence, ratio
from ..functions.standard import STANDARD
from .spatial import box_join, clip_to_box, nearest_segment, segment_box, split_segments, within_distance

BLOCK = ["city", "block_id"]
CLOSE = 20.0


#: What a step does with a group's raw rows before medians of them fill what is missing: nothing, or write them, so that
#: they are made once and not again for the medians.
Stage = Callable[[DataFrame], DataFrame]


def lazily(rows: DataFrame) -> DataFrame:
    return rows


def _std(rows: DataFrame, *metrics: str) -> DataFrame:
    return rows.withColumns({f"{m}_std": STANDARD[m](F.col(f"{m}_raw")) for m in metrics})


def buildings_in_blocks(buildings: DataFrame, blocks: DataFrame, cell: float = 100.0) -> DataFrame:
    """Pairs of building points and blocks that hold them; a point on a border is in both."""
    return within_distance(buildings, blocks.select(*BLOCK, "x0", "y0", "x1", "y1"), ["city"], 0.0, cell=cell)


def road_access(pairs: DataFrame, blocks: DataFrame, stage: Stage = lazily) -> DataFrame:
    """M1, the share of a block's buildings within 20 m of a road (missing: the city's median), and M2, their mean
    distance (0 without buildings), from pairs of building and block with distance_to_nearest_road."""
    d = F.col("distance_to_nearest_road")
    sums = pairs.groupBy(*BLOCK).agg(
        F.count("*").alias("n_buildings"), F.sum(d).alias("sum_distance"), F.count_if(d <= CLOSE).alias("n_closer_20m")
    )
    out = blocks.select(*BLOCK).join(sums, BLOCK, "left").na.fill(0, ["n_buildings", "sum_distance", "n_closer_20m"])
    out = out.withColumns({
        "has_buildings": F.col("n_buildings") > 0,
        "m1_raw": ratio(F.col("n_closer_20m"), F.col("n_buildings")),
        "m2_raw": F.coalesce(ratio(F.col("sum_distance"), F.col("n_buildings")), F.lit(0.0)),
    })
    return _std(fill_median(stage(out), ["city"], {"m1_raw": 0.0}), "m1", "m2")


def road_pieces(segments: DataFrame, blocks: DataFrame, cell: float = 100.0) -> DataFrame:
    """The part of each road in each rectangular block: its length and its box. Rows city, block_id, road_id, length,
    px0, py0, px1, py1; pieces of one road in one block are one row, as a multi-part line is."""
    pairs = box_join(segment_box(split_segments(segments, 4 * cell)), blocks.select(*BLOCK, "x0", "y0", "x1", "y1"), ["city"], cell)
    lo, hi = clip_to_box("r_x0", "r_y0", "r_x1", "r_y1")
    inner = pairs.withColumns({"lo": lo, "hi": hi}).where("hi > lo")
    at = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    ends = {"qx": at("ax", "bx", "lo"), "qy": at("ay", "by", "lo"), "sx": at("ax", "bx", "hi"), "sy": at("ay", "by", "hi")}
    return inner.withColumns({**ends, "part": (F.col("hi") - F.col("lo")) * F.sqrt(dx * dx + dy * dy)}).groupBy(*BLOCK, "road_id").agg(
        F.sum("part").alias("length"), F.min(F.least("qx", "sx")).alias("px0"), F.min(F.least("qy", "sy")).alias("py0"),
        F.max(F.greatest("qx", "sx")).alias("px1"), F.max(F.greatest("qy", "sy")).alias("py1"),
    )


def rectangle_pieces(buildings: DataFrame, blocks: DataFrame, cell: float = 100.0) -> DataFrame:
    """The part of each rectangular footprint (box columns) in each rectangular block: city, block_id, building_id and
    its box px0, py0, px1, py1; footprints that only touch a block have no piece."""
    pairs = box_join(buildings, blocks.select(*BLOCK, "x0", "y0", "x1", "y1"), ["city"], cell)
    box = {f"p{a}0": F.greatest(f"{a}0", f"r_{a}0") for a in "xy"} | {f"p{a}1": F.least(f"{a}1", f"r_{a}1") for a in "xy"}
    return pairs.withColumns(box).where("px1 > px0 and py1 > py0").select(*BLOCK, "building_id", "px0", "py0", "px1", "py1")


def covered_area(rectangles: DataFrame, keys: list[str], out: str, cell: float = 100.0) -> DataFrame:
    """(keys, ``out``): the area that each group's upright rectangles (px0, py0, px1, py1) cover together.

    Rectangles are cut at the lines of a grid, so that a group is as many tasks as it has cells. In a cell the lines of
    the rectangles' sides part it into slabs; in each the covered length is that of the union of intervals."""
    at = lambda c: F.floor(F.col(c) / cell)
    # A rectangle that ends on a line of the grid has no area beyond it.
    dealt = rectangles.withColumn("cx", F.explode(F.sequence(at("px0"), at("px1")))).withColumn("cy", F.explode(F.sequence(at("py0"), at("py1"))))
    side = lambda a, pick, n, edge: pick(F.col(f"p{a}{n}"), (F.col(f"c{a}") + edge) * cell).alias(f"{a}{n}")
    cut = dealt.select(*keys, "cx", "cy", side("x", F.greatest, 0, 0), side("y", F.greatest, 0, 0), side("x", F.least, 1, 1), side("y", F.least, 1, 1)).where("x1 > x0 and y1 > y0")
    cells = cut.groupBy(*keys, "cx", "cy").agg(F.collect_set(F.struct("y0", "y1", "x0", "x1")).alias("r"))
    lines = F.array_sort(F.array_distinct(F.concat(F.col("r.x0"), F.col("r.x1"))))

    def length(low, high):
        over = F.array_sort(F.filter("r", lambda t: (t["x0"] <= low) & (t["x1"] >= high)))  # by y0
        step = lambda s, t: F.struct(
            (s["sum"] + F.greatest(F.lit(0.0), t["y1"] - F.greatest(t["y0"], s["top"]))).alias("sum"), F.greatest(s["top"], t["y1"]).alias("top")
        )
        return F.aggregate(over, F.struct(F.lit(0.0).alias("sum"), F.lit(float("-inf")).alias("top")), step, lambda s: s["sum"])

    slabs = F.arrays_zip(F.slice("lines", 1, F.size("lines") - 1).alias("low"), F.slice("lines", 2, F.size("lines") - 1).alias("high"))
    area = F.aggregate(slabs, F.lit(0.0), lambda a, s: a + (s["high"] - s["low"]) * length(s["low"], s["high"]))
    return cells.withColumn("lines", lines).groupBy(*keys).agg(F.sum(area).alias(out))


def built_rectangles(pieces: DataFrame) -> DataFrame:
    """(city, block_id, built_area, n_buildings): the ground that the footprints of a block cover together, places of
    several of them once, and their number, from rows as of ``rectangle_pieces``."""
    n = pieces.groupBy(*BLOCK).agg(F.count_distinct("building_id").alias("n_buildings"))
    return covered_area(pieces, BLOCK, "built_area").join(n, BLOCK)


def block_base(blocks: DataFrame, built: DataFrame, pieces: DataFrame, node_pairs: DataFrame, stage: Stage = lazily) -> DataFrame:
    """M3 road density, M4 share of four-way nodes, M5 node density, M10 building density, M11 coverage, M12 mean
    footprint, from built area and number of buildings (``built_rectangles``, or ``geometry.built_polygons``), road
    pieces and pairs of node and block. Counts are of distinct buildings and nodes; M4 is the city's median, or 0,
    where a block has no node of three streets."""
    length = pieces.groupBy(*BLOCK).agg(F.sum("length").alias("total_len_m"))
    degree = F.col("street_count")
    nodes = node_pairs.select(*BLOCK, "osmid", "street_count").dropDuplicates([*BLOCK, "osmid"]).groupBy(*BLOCK).agg(
        F.count_if(degree >= 2).alias("n_intersections"), F.count_if(degree >= 3).alias("intersections_3plus"), F.count_if(degree == 4).alias("intersections_4way")
    )
    out = blocks.select(*BLOCK, "block_area")
    for part in (built, length, nodes):
        out = out.join(part, BLOCK, "left")
    out = out.na.fill(0, ["built_area", "n_buildings", "total_len_m", "n_intersections", "intersections_3plus", "intersections_4way"])
    km2 = F.col("block_area") / 1e6
    per_km2 = lambda c: ratio(F.col(c) * 1e6, F.col("block_area"))
    out = out.withColumns({
        "block_area_km2": km2, "road_length": F.col("total_len_m") / 1000.0,
        "has_roads": F.col("total_len_m") > 0, "has_intersections": F.col("n_intersections") > 0,
        "m3_raw": ratio(F.col("total_len_m") / 1000.0, km2),
        "m4_raw": ratio(F.col("intersections_4way"), F.col("intersections_3plus")),
        "m5_raw": per_km2("n_intersections"), "m10_raw": per_km2("n_buildings"),
        "m11_raw": ratio(F.col("built_area"), F.col("block_area")),
        "m12_raw": F.coalesce(ratio(F.col("built_area"), F.col("n_buildings")), F.lit(0.0)),
    })
    return _std(fill_median(stage(out), ["city"], {"m4_raw": 0.0}), "m3", "m4", "m5", "m10", "m11", "m12")


def orientation_and_width(pairs: DataFrame, blocks: DataFrame, period: float = 180.0, bins: int = 18, stage: Stage = lazily) -> DataFrame:
    """M6, the divergence of building azimuths from an even spread over ``period`` degrees, and M7, twice the radius
    of the largest inscribed circle (max_radius of ``blocks``); missing: the city's median, else 0 and 200. Azimuths
    are of rectangles, so in [0, 90); a period of 90 bins them over their own range."""
    turned = pairs.withColumn("azimuth", F.pmod(F.col("azimuth"), F.lit(180.0)))
    kl = histogram_divergence(turned, BLOCK, "azimuth", 0.0, period, bins, "m6_raw")
    out = blocks.select(*BLOCK, (F.col("max_radius") * 2.0).alias("m7_raw")).join(kl, BLOCK, "left")
    return _std(fill_median(stage(out), ["city"], {"m6_raw": 0.0, "m7_raw": 200.0}), "m6", "m7")


def straightness(pieces: DataFrame) -> DataFrame:
    """M8 of each block: over its road pieces, the diagonal of a piece's box by its length (at most 1), weighted by
    length."""
    diagonal = F.sqrt(F.pow(F.col("px1") - F.col("px0"), 2) + F.pow(F.col("py1") - F.col("py0"), 2))
    straight = at_most(ratio(diagonal, F.col("length")), 1.0)
    return pieces.groupBy(*BLOCK).agg(ratio(F.sum(straight * F.col("length")), F.sum("length")).alias("m8_raw"))


def end_to_end_straightness(roads: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per road the distance of its end nodes by its length, NULL where they coincide. Roads: city, road_id, u, v,
    length; a missing node leaves NULL."""
    at = lambda n: nodes.select(F.col("city"), F.col("osmid").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    both = roads.join(at("u"), ["city", "u"], "left").join(at("v"), ["city", "v"], "left")
    d = F.sqrt(F.pow(F.col("ux") - F.col("vx"), 2) + F.pow(F.col("uy") - F.col("vy"), 2))
    return both.withColumn("straight_distance", d).withColumn("straightness", F.when(d > 0, ratio(d, F.col("length"))))


def node_bearings(roads: DataFrame, nodes: DataFrame) -> DataFrame:
    """(city, osmid, bearing): for both ends of each road the direction from its node to the next vertex. Roads: city,
    u, v, and the second vertex (ux2, uy2) and the last but one (vx2, vy2)."""
    place = nodes.select("city", "osmid", "x", "y")

    def end(node: str) -> DataFrame:
        half = roads.select("city", F.col(node).alias("osmid"), F.col(f"{node}x2").alias("px"), F.col(f"{node}y2").alias("py"))
        return half.join(place, ["city", "osmid"]).select("city", "osmid", azimuth(F.col("px") - F.col("x"), F.col("py") - F.col("y")).alias("bearing"))

    return end("u").unionByName(end("v"))


def right_angle_deviation(bearings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(city, osmid, average_angle) of nodes of three or four streets that have as many distinct bearings: how far the
    least gap between neighbouring bearings, or the mean of the two least, is from 90 degrees."""
    one = bearings.join(nodes.where(F.col("street_count").isin(3, 4)).select("city", "osmid", "street_count"), ["city", "osmid"]).dropDuplicates(["city", "osmid", "bearing"])
    node = Window.partitionBy("city", "osmid")
    after = F.lead("bearing").over(node.orderBy("bearing"))
    gaps = one.withColumns({
        "seen": F.count("*").over(node),
        "gap": F.coalesce(after, F.min("bearing").over(node) + 360.0) - F.col("bearing"),
    }).where("seen = street_count")
    ranked = gaps.withColumn("place", F.row_number().over(node.orderBy("gap"))).where(F.col("place") <= F.col("street_count") - 2)
    return ranked.groupBy("city", "osmid").agg(F.avg(F.abs(90.0 - F.col("gap"))).alias("average_angle"))


def straightness_and_angles(blocks: DataFrame, pieces: DataFrame, node_pairs: DataFrame, angles: DataFrame, stage: Stage = lazily) -> DataFrame:
    """M8 (0 without roads) and M9, the mean deviation over a block's nodes that have one (missing: the city's median,
    else 0)."""
    near = node_pairs.select(*BLOCK, "osmid").dropDuplicates().join(angles, ["city", "osmid"])
    m9 = near.groupBy(*BLOCK).agg(F.avg("average_angle").alias("m9_raw"), F.count("average_angle").alias("m9_n_intersections"))
    out = blocks.select(*BLOCK).join(straightness(pieces), BLOCK, "left").join(m9, BLOCK, "left").na.fill(0, ["m9_n_intersections", "m8_raw"])
    return _std(fill_median(stage(out), ["city"], {"m9_raw": 0.0}), "m8", "m9")


def node_degrees(edges: DataFrame) -> DataFrame:
    """(osmid, degree): ends of edges (u, v) at each node; a loop counts twice."""
    return edges.select(F.explode(F.array("u", "v")).alias("osmid")).groupBy("osmid").agg(F.count("*").alias("degree"))


def road_class(highway: Column, kinds: list[str]) -> Column:
    """Whether any of a comma-separated list of road kinds is wanted; false for NULL."""
    return F.coalesce(F.exists(F.split(highway, ","), lambda t: F.trim(t).isin(*kinds)), F.lit(False))


def network_nodes(roads: DataFrame, nodes: DataFrame, kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Roads of the wanted kinds, and the nodes all of whose streets are among them."""
    kept = roads.where(road_class(F.col("highway"), kinds))
    whole = nodes.join(node_degrees(kept), "osmid").where("street_count = degree")
    return kept, whole.drop("degree")


def areal_weights(overlaps: DataFrame) -> DataFrame:
    """Overlaps (block_id, grid_id, overlap_area, grid_area) with area_weight: the share of the cell's area, divided
    by the sum of such shares over the cell."""
    share = ratio(F.col("overlap_area"), F.col("grid_area"))
    totals = overlaps.groupBy("grid_id").agg(F.sum(share).alias("total"))
    return overlaps.join(totals, "grid_id").withColumn("area_weight", ratio(share, F.col("total"))).drop("total")


def weighted_divergence(overlaps: DataFrame, kl: DataFrame) -> DataFrame:
    """m6 of grid cells: block values (block_id, standardized_kl, n_buildings) weighted by area and buildings."""
    rows = overlaps.join(kl, "block_id").where("standardized_kl is not null").withColumn("w", F.col("area_weight") * F.col("n_buildings"))
    return rows.groupBy("grid_id").agg(ratio(F.sum(F.col("standardized_kl") * F.col("w")), F.sum("w")).alias("m6"))


def distances(buildings: DataFrame, segments: DataFrame) -> DataFrame:
    """Buildings (city, building_id, x, y, ...) with distance_to_nearest_road: 200 m windows, 500 without a road."""
    return nearest_segment(buildings, segments, ["city"], "building_id")


def nodes_in_blocks(nodes: DataFrame, blocks: DataFrame, distance: float, strict: bool = False) -> DataFrame:
    """Pairs of nodes and blocks within a tolerance of each other."""
    return within_distance(nodes, blocks.select(*BLOCK, "x0", "y0", "x1", "y1"), ["city"], distance, strict)


def roads_near_blocks(segments: DataFrame, blocks: DataFrame, distance: float = 100.0, cell: float = 100.0) -> DataFrame:
    """(city, block_id, road_id) of road segments not further than ``distance`` from a rectangular block."""
    b = blocks.select(*BLOCK, "x0", "y0", "x1", "y1")
    pairs = box_join(segment_box(split_segments(segments, 4 * cell)), b, ["city"], cell, distance)
    for c in ("x0", "y0", "x1", "y1"):
        pairs = pairs.drop(c).withColumnRenamed(f"r_{c}", c)
    from .spatial import point_box_distance, point_segment_distance

    lo, hi = clip_to_box("x0", "y0", "x1", "y1")
    corners = [point_segment_distance(F.col(x), F.col(y)) for x in ("x0", "x1") for y in ("y0", "y1")]
    ends = [point_box_distance(F.col(x), F.col(y)) for x, y in (("ax", "ay"), ("bx", "by"))]
    d = F.when(lo <= hi, F.lit(0.0)).otherwise(F.least(*corners, *ends))
    return pairs.where(d <= distance).select(*BLOCK, "road_id").distinct()
