"""Geometry kernels as Arrow and pandas functions over columns of well-known binary, and the block steps built on them.

Work is dealt in pairs of neighbours, in tiles of a city or in blocks, so that no task holds a city.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, IntegerType, LongType, StringType, StructType

from ..geom import arrangement as R
from ..geom import parcels as K
from ..geom import planar as L
from ..geom import shapes as S
from ..sources.staging import staged
from .metrics import BLOCK
from .spatial import box_join

def _doubles(schema: StructType, *names: str) -> StructType:
    for n in names:
        schema = schema.add(n, DoubleType())
    return schema


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as shuffles have: small tables of much work are not drawn together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


# Types are built here without a session, as workers import this module.
MEASURES = _doubles(StructType().add("kind", StringType()), "x0", "y0", "x1", "y1", "cx", "cy", "area", "length")


@F.pandas_udf(MEASURES)
def measures(s: pd.Series) -> pd.DataFrame:
    """Kind, box, centroid, area and length of each shape; NULL for an empty one."""
    rows = []
    for data in s:
        shape = S.from_wkb(data)
        if shape is None or shape.empty:
            rows.append((None,) * 9)
            continue
        c = S.centroid(shape)
        rows.append((shape.kind, *S.bounds(shape), c[0], c[1], S.area(shape), float(sum(map(S.line_length, shape.lines)))))
    return pd.DataFrame(rows, columns=MEASURES.names)


@F.pandas_udf(DoubleType())
def rectangle_azimuth(s: pd.Series) -> pd.Series:
    """Direction of the smallest rectangle around each shape, in [0, 90)."""
    return pd.Series([None if (g := S.from_wkb(d)) is None else S.rectangle_azimuth(g) for d in s], dtype="float64")


@F.pandas_udf(DoubleType())
def shape_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Distance between the shapes of each row."""
    return pd.Series([None if x is None or y is None else S.distance(S.from_wkb(x), S.from_wkb(y)) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def overlap_area(a: pd.Series, b: pd.Series) -> pd.Series:
    """Area that the polygons of each row share."""
    of = lambda d: S.from_wkb(d).polygons if d is not None else []
    return pd.Series([sum(map(S.polygon_area, L.intersection(of(x), of(y)))) for x, y in zip(a, b)], dtype="float64")


CIRCLE = _doubles(StructType().add("optimal_point", StringType()), "max_radius")


def _circle(tolerance: float):
    @F.pandas_udf(CIRCLE)
    def circle(s: pd.Series) -> pd.DataFrame:
        rows = []
        for data in s:
            shape = S.from_wkb(data)
            found = K.inscribed_circle([q for p in shape.polygons for q in L.repaired(p)], tolerance) if shape else None
            rows.append((S.point_wkt(*found[:2]), found[2]) if found else (None, None))
        return pd.DataFrame(rows, columns=CIRCLE.names)

    return circle


def with_inscribed_circles(rows: DataFrame, geometry: str = "geometry", tolerance: float = 1.0) -> DataFrame:
    """optimal_point (text form) and max_radius of the largest circle in each polygon; the shapes are in metres."""
    c = _circle(tolerance)(F.col(geometry))
    return rows.withColumn("circle__", c).withColumns({"optimal_point": F.col("circle__.optimal_point"), "max_radius": F.col("circle__.max_radius")}).drop("circle__")


def with_box(rows: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Box columns and kind of each shape, computed once, at ingest."""
    m = rows.withColumn("measures__", measures(F.col(geometry)))
    return m.withColumns({c: F.col(f"measures__.{c}") for c in ("kind", "x0", "y0", "x1", "y1")}).drop("measures__")


def line_wkb(points: Column) -> Column:
    """The binary form of a line from an array of (x, y) structs."""

    @F.pandas_udf(BinaryType())
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda p: S.to_wkb(S.Shape("line", [np.array([(q["x"], q["y"]) for q in p], float)])))

    return encode(points)


@F.pandas_udf(BinaryType())
def rectangle_wkb(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series, degrees: pd.Series) -> pd.Series:
    """The binary form of rectangles turned about their centres."""
    out = []
    for a, b, c, d, t in zip(x0, y0, x1, y1, np.radians(degrees)):
        m = np.array([(a + c) / 2, (b + d) / 2])
        r = np.array([(a, b), (c, b), (c, d), (a, d)]) - m
        out.append(S.to_wkb(S.Shape("polygon", [[r @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]]) + m]])))
    return pd.Series(out)


def reproject(geometry: Column, own: int, to: int) -> Column:
    """Shapes of one EPSG system in another (``projection.convert``)."""

    @F.pandas_udf(BinaryType())
    def turn(s: pd.Series) -> pd.Series:
        from ..functions.projection import convert

        f = lambda p: np.column_stack(convert(p[:, 0], p[:, 1], own, to))
        return s.map(lambda d: S.to_wkb(S.mapped(S.from_wkb(d), f)), na_action="ignore")

    return turn(geometry)


def _polygons(change) -> Callable[[Column], Column]:
    """A column function from one on lists of polygons; NULL for nothing."""

    @F.pandas_udf(BinaryType())
    def each(s: pd.Series) -> pd.Series:
        def one(d: bytes | None) -> bytes | None:
            found = change(S.from_wkb(d).polygons) if d is not None else []
            return S.polygon_wkb(found) if found else None

        return s.map(one)

    return each


def polygons_only(rows: DataFrame) -> DataFrame:
    """Rows whose shape has polygons, without its points and lines, and with rings that cross made valid."""
    whole = _polygons(lambda p: [q for x in p for q in L.repaired(x)])
    return rows.withColumn("geometry", whole(F.col("geometry"))).where("geometry is not null")


def areal_overlaps(blocks: DataFrame, grid: DataFrame, cell: float = 200.0) -> DataFrame:
    """(city, block_id, grid_id, overlap_area, grid_area) of blocks and grid cells that share area, both with geometry
    and box columns: what ``metrics.areal_weights`` takes."""
    cells = grid.select("city", "grid_id", "x0", "y0", "x1", "y1", F.col("geometry").alias("cell_shape"), measures("geometry")["area"].alias("grid_area"))
    pairs = box_join(cells, blocks.select(*BLOCK, "x0", "y0", "x1", "y1", F.col("geometry").alias("block_shape")), ["city"], cell)
    return pairs.select(*BLOCK, "grid_id", overlap_area("cell_shape", "block_shape").alias("overlap_area"), "grid_area").where("overlap_area > 0")


def buffered(geometry: Column, d: float) -> Column:
    """The places within ``d`` of each polygon, or further in than ``-d`` (``planar.buffer``)."""
    return _polygons(lambda p: L.buffer(p, d))(geometry)


def shrunk_to_area(geometry: Column, target: float) -> Column:
    """Each polygon shrunk to an area (``planar.inner_buffer_of_area``)."""
    return _polygons(lambda p: L.inner_buffer_of_area(p, target))(geometry)


@F.pandas_udf(_doubles(StructType(), "x", "y"))
def representative_point(s: pd.Series) -> pd.DataFrame:
    """A point within the largest polygon of each shape; else its first vertex; NULL for an empty one."""
    rows = []
    for d in s:
        shape = S.from_wkb(d)
        if shape is not None and shape.polygons:
            rows.append(tuple(S.interior_point(max(shape.polygons, key=S.polygon_area))))
        elif shape is not None and not shape.empty:
            rows.append(tuple((shape.lines[0] if shape.lines else shape.points)[0]))
        else:
            rows.append((None, None))
    return pd.DataFrame(rows, columns=["x", "y"], dtype=float)


PIECE = _doubles(StructType(), "length", "px0", "py0", "px1", "py1").add("geometry", BinaryType())


def clipped_roads(roads: DataFrame, blocks: DataFrame, cell: float = 200.0) -> DataFrame:
    """The part of each road in each block, as ``road_pieces`` gives it for rectangles, with its shape. Both have
    geometry and box columns; roads city and road_id, blocks city and block_id. Roads along a border are in both."""
    pairs = box_join(roads.select("city", "road_id", "x0", "y0", "x1", "y1", F.col("geometry").alias("line")), blocks.select(*BLOCK, "x0", "y0", "x1", "y1", F.col("geometry").alias("area")), ["city"], cell)
    rows = pairs.select(*BLOCK, "road_id", "line", "area")
    schema = StructType(rows.select(*BLOCK, "road_id").schema.fields + PIECE.fields)

    def clip(batches):
        for b in batches:
            out = []
            for city, block, road, line, area in b.itertuples(index=False):
                parts = L.clip_lines(S.from_wkb(line).lines, S.from_wkb(area).polygons)
                if parts:
                    p = np.concatenate(parts)
                    shape = S.Shape("line", parts) if len(parts) == 1 else S.Shape("multiline", parts)
                    out.append((city, block, road, float(sum(map(S.line_length, parts))), *p.min(axis=0), *p.max(axis=0), S.to_wkb(shape)))
            yield pd.DataFrame(out, columns=schema.names)

    return rows.mapInPandas(clip, schema)


def clipped_footprints(buildings: DataFrame, blocks: DataFrame, cell: float = 200.0) -> DataFrame:
    """(city, block_id, building_id, area): the area of each footprint in each block."""
    pairs = box_join(buildings.select("city", "building_id", "x0", "y0", "x1", "y1", F.col("geometry").alias("footprint")), blocks.select(*BLOCK, "x0", "y0", "x1", "y1", F.col("geometry").alias("area_of")), ["city"], cell)
    return pairs.select(*BLOCK, "building_id", overlap_area("footprint", "area_of").alias("area")).where("area > 0")


def built_polygons(buildings: DataFrame, blocks: DataFrame, cell: float = 200.0) -> DataFrame:
    """(city, block_id, built_area, n_buildings) of footprints of any shape, as ``built_rectangles``: a block's pieces
    are cut by the cells of a grid, a task each, and united there, so that a block's size bounds no task."""
    pairs = box_join(buildings.select("city", "building_id", "x0", "y0", "x1", "y1", F.col("geometry").alias("footprint")), blocks.select(*BLOCK, "x0", "y0", "x1", "y1", F.col("geometry").alias("area_of")), ["city"], cell)
    n = pairs.select(*BLOCK, "building_id", overlap_area("footprint", "area_of").alias("area")).where("area > 0").groupBy(*BLOCK).agg(F.count_distinct("building_id").alias("n_buildings"))
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    low, high = {c: F.greatest(f"{c}0", f"r_{c}0") for c in "xy"}, {c: F.least(f"{c}1", f"r_{c}1") for c in "xy"}
    dealt = pairs.withColumns({f"b{c}0": low[c] for c in "xy"} | {f"b{c}1": high[c] for c in "xy"})
    dealt = dealt.withColumn("cx", F.explode(F.sequence(at("bx0"), at("bx1")))).withColumn("cy", F.explode(F.sequence(at("by0"), at("by1"))))
    schema = StructType([*(blocks.schema[k] for k in BLOCK), *_doubles(StructType(), "area").fields])

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["cx"].iloc[0] * cell, pdf["cy"].iloc[0] * cell
        tile = [[np.array([(x, y), (x + cell, y), (x + cell, y + cell), (x, y + cell)])]]
        own = L.intersection(S.from_wkb(pdf["area_of"].iloc[0]).polygons, tile)
        found = [p for d in pdf["footprint"].drop_duplicates() for p in S.from_wkb(d).polygons]
        area = sum(map(S.polygon_area, L.intersection(L.union(found), own))) if found and own else 0.0
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in BLOCK}, "area": [float(area)]})

    cells = spread(dealt.select(*BLOCK, "cx", "cy", "footprint", "area_of"), *BLOCK, "cx", "cy").groupBy(*BLOCK, "cx", "cy").applyInPandas(union, schema)
    return n.join(cells.groupBy(*BLOCK).agg(F.sum("area").alias("built_area")), BLOCK).select(*BLOCK, "built_area", "n_buildings")


def polygon_road_distance(buildings: DataFrame, roads: DataFrame, window: float = 200.0, default: float = 500.0) -> DataFrame:
    """distance_to_nearest_road of footprints: the least over roads whose box is within ``window``."""
    own = ["city", "building_id"]
    pairs = box_join(buildings.select(*own, "x0", "y0", "x1", "y1", F.col("geometry").alias("footprint")), roads.select("city", "x0", "y0", "x1", "y1", F.col("geometry").alias("line")), ["city"], window, window)
    least = pairs.groupBy(*own).agg(F.min(shape_distance("footprint", "line")).alias("distance_to_nearest_road"))
    return buildings.join(least, own, "left").withColumn("distance_to_nearest_road", F.coalesce("distance_to_nearest_road", F.lit(float(default))))


def polygonize(lines: DataFrame, tiles: tuple[float, ...] = (2_000.0,)) -> DataFrame:
    """(city, geometry): the faces that each city's linework bounds; ``lines`` has city, geometry and box columns."""
    return _faces_and_outlines(lines, tiles)[0]


SEGMENT = _doubles(StructType(), "x1", "y1", "x2", "y2")
SIDES = StructType().add("left", BooleanType()).add("right", BooleanType()).add("tx", LongType()).add("ty", LongType())


def _faces_and_outlines(lines: DataFrame, tiles: tuple[float, ...], least: float = 0.0, edges: float = 1e5, grow: int = 4) -> tuple[DataFrame, DataFrame]:
    """(city, geometry) twice: the faces of an area of ``least`` or more, and the rings around all faces.

    Squares of a grid, at most as wide as the least of ``tiles`` and for dense linework so narrow that about ``edges``
    edges are expected in one, settle the faces that they hold whole. With a ``least`` most lines are not cut in a square
    (``arrangement.settle_large``), so it may be as wide as about half as many lines allow. What goes on to squares ``grow`` times as wide is
    edges beside faces that reach a square's border, and in the end, by city, those beside the outside: a task holds
    what borders its squares, not what is in them."""
    city = lines.schema["city"]
    widest = 2.0 ** math.floor(math.log2(min(tiles)))
    split_schema = StructType([city, *SEGMENT.fields])

    def split(batches):
        for b in batches:
            found = [S.line_segments(S.linework(S.from_wkb(d))) for d in b["geometry"]]
            if len(found):
                yield pd.DataFrame({"city": b["city"].repeat(list(map(len, found))), **dict(zip(SEGMENT.names, np.vstack(found).T))})

    segments = staged(lines.select("city", "geometry").mapInPandas(split, split_schema))
    # Lines that lie at random cross (length / area) ** 2 / pi times a square metre: in the middle half of a city each way,
    # which is taken to hold a quarter of it.
    middle = {a: (F.col(f"{a}1") + F.col(f"{a}2")) / 2 for a in "xy"}
    quarter = [(F.percentile_approx(middle[a], 0.75) - F.percentile_approx(middle[a], 0.25)).alias(f"w{a}") for a in "xy"]
    span = F.greatest(*[F.max(F.greatest(f"{a}1", f"{a}2")) - F.min(F.least(f"{a}1", f"{a}2")) for a in "xy"]).alias("span")
    found = segments.groupBy("city").agg(F.sum(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("length"), F.count("*").alias("n"), span, *quarter)
    # Many lines may have their middles on one line, so a sixteenth of the city's reach is the least that counts.
    wide = lambda a: F.greatest(F.col(f"w{a}"), F.col("span") / 16, F.lit(1e-3))
    area = wide("x") * wide("y")
    density = F.greatest((F.col("length") / 4) ** 2 / math.pi / area / area, F.col("n") / 4 / area)
    side = F.sqrt(edges / 2 / density)
    if least > 0:  # Lines with their middles in a square, and those that come in over its sides.
        b, a = F.col("length") / 8 / area, F.col("n") / 4 / area
        side = F.greatest(side, F.when(F.col("n") <= edges / 2, F.lit(widest)).otherwise(edges / 2 / (b + F.sqrt(b * b + a * edges / 2))))
    power = F.floor(F.log2(F.least(F.lit(widest), F.greatest(F.lit(1.0 / 64), side))))
    sizes = staged(found.select(F.col("city").alias("city_"), F.pow(F.lit(2.0), power).alias("size"), "span"))
    ratio = sizes.agg(F.max(F.col("span") / F.col("size"))).first()[0] or 1.0
    levels = max(1, math.ceil(math.log(ratio, grow))) if ratio > 1 else 1

    row = StructType([city, *SEGMENT.fields, *SIDES.fields, *_doubles(StructType(), "size").fields])
    out = StructType([*row.fields, *StructType().add("geometry", BinaryType()).add("outline", BooleanType()).fields])

    def deal(batches):
        for b in batches:
            for size, rows in b.groupby("size"):
                e = rows[SEGMENT.names].to_numpy(float)
                for at in range(0, len(e), 1_000):
                    which, x, y, p = R.pieces_in_squares(e[at : at + 1_000], size)
                    yield pd.DataFrame({"city": rows["city"].to_numpy()[at + which], **dict(zip(SEGMENT.names, p.T)), "left": False, "right": False, "tx": x, "ty": y, "size": size}, columns=row.names)

    def settle(wide: int | None):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            unit = float(pdf["size"].iloc[0])
            x, y, w = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0]), unit * (wide or 1)
            box = None if wide is None else (x * w, y * w, (x + 1) * w, (y + 1) * w)
            e = pdf[SEGMENT.names].to_numpy(float)
            f = R.settle_large(e, box, least, unit) if wide == 1 and least > 0 else R.settle(e, pdf["left"].to_numpy(bool), pdf["right"].to_numpy(bool), box, least, unit)
            made = [pd.DataFrame({**dict(zip(SEGMENT.names, f.edges.T)), "left": f.left, "right": f.right, "geometry": None, "outline": False})]
            shapes = [S.polygon_wkb([p]) for p in [*f.faces, *f.outlines]]
            made.append(pd.DataFrame({**dict.fromkeys(SEGMENT.names, 0.0), "left": False, "right": False, "geometry": shapes, "outline": [False] * len(f.faces) + [True] * len(f.outlines)}))
            both = pd.concat([m for m in made if len(m)]) if any(map(len, made)) else made[0]
            return both.assign(city=pdf["city"].iloc[0], tx=x // grow, ty=y // grow, size=unit)[out.names]

        return one

    rows = segments.join(sizes, segments["city"].eqNullSafe(sizes["city_"])).select("city", *SEGMENT.names, "size").mapInPandas(deal, row)
    made = []
    for i in range(levels):
        made.append(staged(spread(rows, "city", "tx", "ty").groupBy("city", "tx", "ty").applyInPandas(settle(grow**i), out)))
        rows = made[-1].where("geometry is null").select(row.names)
    made.append(staged(rows.groupBy("city").applyInPandas(settle(None), out)))
    faces = functools.reduce(DataFrame.unionByName, [m.where("geometry is not null and not outline").select("city", "geometry") for m in made])
    return faces, made[-1].where("outline").select("city", "geometry")


def cut_by(rows: DataFrame, masks: DataFrame, keep_inside: bool, key: list[str], cell: float = 500.0) -> DataFrame:
    """Polygons (key, city, geometry, box columns) with the places in (or out of) the masks of their city, single
    polygons again. A polygon without a mask near is dropped, if ``keep_inside``, else left as it is."""
    own = [*key, "city"]
    pairs = box_join(rows.select(*own, "x0", "y0", "x1", "y1"), masks.select("city", F.col("geometry").alias("mask"), "x0", "y0", "x1", "y1"), ["city"], cell)
    near = pairs.select(*[F.col(c).alias(f"{c}_") for c in own], "mask")
    schema = StructType([*(rows.schema[c] for c in own), rows.schema["geometry"]])

    def cut(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        mask = [p for d in theirs["mask"] for p in S.from_wkb(d).polygons] if len(theirs) else []
        for r in mine.itertuples(index=False):
            if not mask:
                found = [] if keep_inside else [r.geometry]
            else:
                found = [S.polygon_wkb([p]) for p in (L.intersection if keep_inside else L.difference)(S.from_wkb(r.geometry).polygons, mask)]
            out += [(*r[:-1], d) for d in found]
        return pd.DataFrame(out, columns=schema.names)

    theirs = [f"{c}_" for c in own]
    return spread(rows.select(*own, "geometry"), *own).groupBy(*own).cogroup(spread(near, *theirs).groupBy(*theirs)).applyInPandas(cut, schema)


def dissolve(rows: DataFrame, keys: list[str], tile: float = 2_000.0) -> DataFrame:
    """(keys, geometry): the union of each group's polygons, first by tiles of their lower left corners, then of the
    tiles' few outlines."""
    schema = StructType([*(rows.schema[k] for k in keys), rows.schema["geometry"]])

    def union(pdf: pd.DataFrame) -> pd.DataFrame:
        found = L.union([p for d in pdf["geometry"] for p in S.from_wkb(d).polygons])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * bool(found) for k in keys}, "geometry": [S.polygon_wkb(found)] * bool(found)})

    m = with_box(rows.select(*keys, "geometry"))
    tiles = m.withColumns({"tx": F.floor(F.col("x0") / tile), "ty": F.floor(F.col("y0") / tile)}).where("kind is not null")
    return spread(tiles.select(*keys, "geometry", "tx", "ty"), *keys, "tx", "ty").groupBy(*keys, "tx", "ty").applyInPandas(union, schema).groupBy(*keys).applyInPandas(union, schema)


def by_tiles(rows: DataFrame, tile: float) -> DataFrame:
    """(city, geometry): the parts of polygons (city, geometry, box columns) in the squares of a grid."""
    cell = lambda a: F.explode(F.sequence(F.floor(F.col(f"{a}0") / tile), F.floor(F.col(f"{a}1") / tile)))
    schema = StructType([rows.schema["city"], rows.schema["geometry"]])

    def cut(batches):
        for b in batches:
            out = []
            for city, data, i, j in b.itertuples(index=False):
                x, y = i * tile, j * tile
                found = L.intersection(S.from_wkb(data).polygons, [[np.array([(x, y), (x + tile, y), (x + tile, y + tile), (x, y + tile)])]])
                out += [(city, S.polygon_wkb([p])) for p in found]
            yield pd.DataFrame(out, columns=schema.names)

    return rows.withColumn("tx", cell("x")).withColumn("ty", cell("y")).select("city", "geometry", "tx", "ty").mapInPandas(cut, schema)


def single_polygons(rows: DataFrame) -> DataFrame:
    """(city, geometry): each polygon of each shape as a row."""
    schema = StructType([rows.schema["city"], rows.schema["geometry"]])

    def split(batches):
        for b in batches:
            yield pd.DataFrame([(city, S.polygon_wkb([p])) for city, d in b.itertuples(index=False) for p in S.from_wkb(d).polygons], columns=schema.names)

    return rows.select("city", "geometry").mapInPandas(split, schema)


@F.pandas_udf(BinaryType())
def convex_hull(s: pd.Series) -> pd.Series:
    """The convex hull of each shape, as a polygon; NULL where it has no area."""
    def one(d: bytes | None) -> bytes | None:
        shape = S.from_wkb(d)
        found = [] if shape is None else [r for p in shape.polygons for r in p] + shape.lines + ([shape.points] if len(shape.points) else [])
        h = S.hull(np.concatenate(found)) if found else np.empty((0, 2))
        return S.to_wkb(S.Shape("polygon", [[h]])) if len(h) > 2 else None

    return s.map(one)


def fill(lines: DataFrame, holes: DataFrame, least: float = 1.0, cell: float = 500.0) -> DataFrame:
    """(city, geometry, fill_method): the places of ``holes`` (city, hole_id, geometry, box columns) cut by linework."""
    pairs = box_join(holes.select("city", "hole_id", "x0", "y0", "x1", "y1"), lines.select("city", "geometry", "x0", "y0", "x1", "y1"), ["city"], cell)
    near = pairs.select(F.col("city").alias("city_"), F.col("hole_id").alias("hole_id_"), "geometry")
    schema = StructType([holes.schema["city"], *StructType().add("geometry", BinaryType()).add("fill_method", StringType()).fields])

    def cut(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = []
        inner = [p for d in theirs["geometry"] for p in S.linework(S.from_wkb(d))] if len(theirs) else []
        for city, _, hole in mine.itertuples(index=False):
            faces, how = L.fill_blocks(inner, S.from_wkb(hole).polygons, least)
            out += [(city, S.polygon_wkb([p]), how) for p in faces]
        return pd.DataFrame(out, columns=schema.names)

    return spread(holes.select("city", "hole_id", "geometry"), "city", "hole_id").groupBy("city", "hole_id").cogroup(spread(near, "city_", "hole_id_").groupBy("city_", "hole_id_")).applyInPandas(cut, schema)


def produce_blocks(lines: DataFrame, extents: DataFrame, land: DataFrame | None = None, water: DataFrame | None = None, least: float = 700.0, tiles: tuple[float, ...] = (2_000.0,)) -> DataFrame:
    """Blocks of each city: faces of its linework, in land and out of water, and fill for the rest of its extent, with
    inscribed circles, areas and numbers; none below ``least`` square metres. Inputs have city and geometry."""
    boxed = lambda df: with_box(df.select("city", "geometry"))
    lines = staged(boxed(spread(lines.select("city", "geometry"), "geometry")).where("kind is not null"))
    numbered = lambda df: df.withColumn("face__", F.xxhash64("city", "geometry"))

    def dry(df: DataFrame) -> DataFrame:
        for mask, inside in ((land, True), (water, False)):
            if mask is not None:
                df = cut_by(numbered(boxed(df)), boxed(mask), inside, ["face__"]).select("city", "geometry")
        return df

    faces, outlines = _faces_and_outlines(lines, tiles, least)
    base = dry(faces)
    # The extent is cut by tiles, so that no task holds a city's; what is left grows together again. What no face takes
    # is what the rings around all of them leave; fill in water or off land goes below.
    rest = cut_by(numbered(boxed(by_tiles(boxed(extents), max(tiles)))), boxed(outlines), False, ["face__"]).select("city", "geometry")
    rest = staged(single_polygons(dissolve(rest, ["city"], max(tiles))))
    holes = boxed(dry(rest)).withColumn("hole_id", F.xxhash64("geometry"))
    both = base.withColumns({"is_fill_block": F.lit(False), "fill_method": F.lit(None).cast("string")}).unionByName(fill(lines, holes).withColumn("is_fill_block", F.lit(True)))
    m = both.withColumn("m", measures("geometry")).withColumns({"block_area": F.col("m.area"), "x0": F.col("m.x0"), "y0": F.col("m.y0"), "x1": F.col("m.x1"), "y1": F.col("m.y1")}).drop("m")
    from .tables import number_blocks

    kept = with_inscribed_circles(m.where(F.col("block_area") >= least))
    cells = {"fill": F.col("is_fill_block"), "x": F.floor(F.col("x0") / 5_000.0), "y": F.floor(F.col("y0") / 5_000.0)}
    return number_blocks(kept, ["x0", "y0", "x1", "y1", "block_area"], cells)


LAYERS = _doubles(StructType(), "on_network_street_length", "off_network_street_length", "nearest_external_street").add("building_count", IntegerType()).add("building_layers", StringType()).add("k_complexity", IntegerType())


def parcel_layers(blocks: DataFrame, buildings: DataFrame, roads: DataFrame, radius: float = 100.0, cell: float = 200.0) -> DataFrame:
    """K and street access of each block. Blocks and roads have geometry and box columns, buildings city and the
    centroid (x, y). A block's buildings are those in it, its roads those within ``radius``."""
    b = blocks.select(*BLOCK, "x0", "y0", "x1", "y1", F.col("geometry").alias("area"))
    points = buildings.select("city", "x", "y", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    held = box_join(points, b.select(*BLOCK, "x0", "y0", "x1", "y1"), ["city"], cell).select(*BLOCK, "x", "y", F.lit(None).cast("binary").alias("line"))
    near = box_join(roads.select("city", "x0", "y0", "x1", "y1", F.col("geometry").alias("line")), b.select(*BLOCK, "x0", "y0", "x1", "y1"), ["city"], cell, radius)
    near = near.select(*BLOCK, F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "line")
    schema = StructType(blocks.select(*BLOCK).schema.fields + LAYERS.fields)

    def layers(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame(columns=schema.names)
        area = S.from_wkb(mine["area"].iloc[0]).polygons
        xy = theirs.loc[theirs["x"].notna(), ["x", "y"]].to_numpy(float) if len(theirs) else np.empty((0, 2))
        if len(xy) and area:
            e = np.vstack([S.segments_of(p) for p in area])
            xy = xy[L.covered(area, xy) | (S.points_to_segments(xy, e) <= 1e-9)]
        lines = [p for d in theirs["line"].dropna() for p in S.from_wkb(d).lines] if len(theirs) else []
        if lines and area:
            edges = S.segments_of(area[0])
            first = np.array([p[0] for p in lines])
            lines = [lines[i] for i in np.flatnonzero(K.near_lines(lines, edges, radius) | S.inside(area[0], first[:, 0], first[:, 1]))]
        out = K.complexity(area, xy, lines, radius)
        out["building_layers"] = ",".join(map(str, out["building_layers"]))
        return pd.DataFrame([{**{k: mine[k].iloc[0] for k in BLOCK}, **out}])[schema.names]

    # Renamed, so that both sides of the cogroup have columns of their own.
    around = held.unionByName(near).select(F.col("city").alias("city_"), F.col("block_id").alias("block_id_"), "x", "y", "line")
    return spread(b.select(*BLOCK, "area"), *BLOCK).groupBy(*BLOCK).cogroup(spread(around, "city_", "block_id_").groupBy("city_", "block_id_")).applyInPandas(layers, schema)


def geojson(geometry: Column, tolerance: float = 0.0001) -> Column:
    """Each shape as GeoJSON text, lines and rings simplified."""

    @F.pandas_udf(StringType())
    def encode(s: pd.Series) -> pd.Series:
        import json

        def one(d: bytes) -> str:
            shape = S.from_wkb(d)
            if shape.kind in ("line", "multiline"):
                shape = S.Shape(shape.kind, [S.simplified(p, tolerance) for p in shape.parts])
            elif shape.kind in ("polygon", "multipolygon"):
                ring = lambda r: r if len(q := S.simplified(np.vstack((r, r[:1])), tolerance)) < 4 else q[:-1]
                shape = S.Shape(shape.kind, [[ring(r) for r in p] for p in shape.parts])
            return json.dumps(S.geojson(shape))

        return s.map(one, na_action="ignore")

    return encode(geometry)
