"""Spatial joins as equi-joins on grid cells, with exact conditions on what they find.

Each side is dealt to the cells that its bounding box meets. A pair that meets in several cells is kept in one of
them, the lower left one of the cells common to both, so no distinct is needed. Cell keys spread a city over many
tasks; a crowded cell is split by adaptive execution. A box of n by m cells is n * m rows: long segments are cut into
pieces first, or, where the box of the whole segment counts, dealt to the cells of a coarser grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOX = ("x0", "y0", "x1", "y1")


def with_box(rows: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    return rows.withColumns(dict(zip(BOX, (x0, y0, x1, y1))))


def point_box(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return with_box(rows, F.col(x), F.col(y), F.col(x), F.col(y))


def segment_box(rows: DataFrame) -> DataFrame:
    """Bounding boxes of segments (ax, ay) to (bx, by)."""
    return with_box(rows, F.least("ax", "bx"), F.least("ay", "by"), F.greatest("ax", "bx"), F.greatest("ay", "by"))


def split_segments(rows: DataFrame, longest: float) -> DataFrame:
    """Segments (ax, ay) to (bx, by) cut into equal pieces of at most ``longest`` along either axis, a row each; those
    that are no longer stay as they are. A piece ends where the next one starts."""
    n = F.greatest(F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))) / longest).cast("int"), F.lit(1))
    cut = rows.withColumn("pieces__", F.coalesce(n, F.lit(1))).withColumn("piece__", F.explode(F.sequence(F.lit(0), F.col("pieces__") - 1)))

    def at(a: str, b: str, i: Column) -> Column:
        inner = F.col(a) + (i / F.col("pieces__")) * (F.col(b) - F.col(a))
        return F.when(i == 0, F.col(a)).when(i == F.col("pieces__"), F.col(b)).otherwise(inner)

    i = F.col("piece__")
    ends = {"ax": at("ax", "bx", i), "ay": at("ay", "by", i), "bx": at("ax", "bx", i + 1), "by": at("ay", "by", i + 1)}
    return cut.withColumns(ends).drop("pieces__", "piece__")


def _dealt(rows: DataFrame, side: str, cell: float, pad: float) -> DataFrame:
    at = lambda c, d: F.floor((F.col(c) + d) / cell)
    return (
        rows.withColumn(f"{side}cx", at("x0", -pad)).withColumn(f"{side}cy", at("y0", -pad))
        .withColumn("cell__x", F.explode(F.sequence(F.col(f"{side}cx"), at("x1", pad))))
        .withColumn("cell__y", F.explode(F.sequence(F.col(f"{side}cy"), at("y1", pad))))
    )


def box_join(left: DataFrame, right: DataFrame, keys: list[str], cell: float, pad: float = 0.0) -> DataFrame:
    """Pairs of rows, equal in ``keys``, whose bounding boxes come within ``pad`` of each other along both axes.

    Both sides have the box columns; the right one's come out as ``r_x0`` and so on. Other column names differ."""
    l, r = _dealt(left, "l__", cell, 0.0), _dealt(right, "r__", cell, pad)
    for c in BOX:
        r = r.withColumnRenamed(c, f"r_{c}")
    near = (
        (F.col("x0") <= F.col("r_x1") + pad) & (F.col("x1") >= F.col("r_x0") - pad)
        & (F.col("y0") <= F.col("r_y1") + pad) & (F.col("y1") >= F.col("r_y0") - pad)
    )
    first = (F.col("cell__x") == F.greatest("l__cx", "r__cx")) & (F.col("cell__y") == F.greatest("l__cy", "r__cy"))
    return l.join(r, [*keys, "cell__x", "cell__y"]).where(near & first).drop("cell__x", "cell__y", "l__cx", "l__cy", "r__cx", "r__cy")


def point_segment_distance(x: Column, y: Column) -> Column:
    """Distance of (x, y) from the segment (ax, ay) to (bx, by)."""
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    t = F.coalesce(((x - ax) * dx + (y - ay) * dy) / F.nullif(square, F.lit(0.0)), F.lit(0.0))
    t = F.when(t < 0, F.lit(0.0)).when(t > 1, F.lit(1.0)).otherwise(t)
    ex, ey = x - (ax + t * dx), y - (ay + t * dy)
    return F.sqrt(ex * ex + ey * ey)


def point_box_distance(x: Column, y: Column) -> Column:
    """Distance of (x, y) from the rectangle of the box columns, 0 inside."""
    gap = lambda v, low, high: F.greatest(F.col(low) - v, v - F.col(high), F.lit(0.0))
    gx, gy = gap(x, "x0", "x1"), gap(y, "y0", "y1")
    return F.sqrt(gx * gx + gy * gy)


def clip_to_box(x0: str, y0: str, x1: str, y1: str) -> tuple[Column, Column]:
    """The part of the segment (ax, ay) to (bx, by) within a rectangle, as parameters (from, to); to < from: none."""
    lo, hi = F.lit(0.0), F.lit(1.0)
    for a, d, low, high in (("ax", F.col("bx") - F.col("ax"), x0, x1), ("ay", F.col("by") - F.col("ay"), y0, y1)):
        near, far = (F.col(low) - F.col(a)) / F.nullif(d, F.lit(0.0)), (F.col(high) - F.col(a)) / F.nullif(d, F.lit(0.0))
        inside = (F.col(a) >= F.col(low)) & (F.col(a) <= F.col(high))
        lo = F.greatest(lo, F.when(d == 0, F.when(inside, F.lit(0.0)).otherwise(F.lit(2.0))).otherwise(F.least(near, far)))
        hi = F.least(hi, F.when(d == 0, F.lit(1.0)).otherwise(F.greatest(near, far)))
    return lo, hi


def nearest_segment(points: DataFrame, segments: DataFrame, keys: list[str], point_id: str, window: float = 200.0, default: float = 500.0) -> DataFrame:
    """Each point's least distance to the segments whose box is within ``window`` of it along both axes; such a least
    distance may exceed the window. ``default`` where there is none."""
    own = [*keys, point_id]
    places, boxes = point_box(points.select(*own, "x", "y")), segment_box(segments.select(*keys, "ax", "ay", "bx", "by"))
    long = F.coalesce(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > 8 * window, F.lit(False))
    pairs = box_join(places, boxes.where(~long), keys, window, window).unionByName(box_join(places, boxes.where(long), keys, 32 * window, window))
    least = pairs.groupBy(*own).agg(F.min(point_segment_distance(F.col("x"), F.col("y"))).alias("distance_to_nearest_road"))
    return points.join(least, own, "left").withColumn("distance_to_nearest_road", F.coalesce("distance_to_nearest_road", F.lit(float(default))))


def within_distance(points: DataFrame, boxes: DataFrame, keys: list[str], distance: float, strict: bool = False, cell: float = 100.0) -> DataFrame:
    """Pairs of points and rectangles not further apart than ``distance``; nearer than it, if ``strict``."""
    b = boxes
    for c in BOX:
        b = b.withColumn(f"b_{c}", F.col(c))
    pairs = box_join(point_box(points), b, keys, cell, distance).drop(*BOX, *[f"r_{c}" for c in BOX])
    for c in BOX:
        pairs = pairs.withColumnRenamed(f"b_{c}", c)
    d = point_box_distance(F.col("x"), F.col("y"))
    return pairs.where(d < distance if strict else d <= distance)
