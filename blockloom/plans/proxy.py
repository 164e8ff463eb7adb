"""A deterministic city out of tables that hold no geometry, as DataFrames and as SQL.

Buildings are points from the first two components of an embedding, or rectangles from its next two; blocks are the
100 m cells of a city; each building's node is joined by a road to the node of a smaller number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 100.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part(i: int):
    return F.round(F.col("embedding")[i].cast("double") * 1000.0, 3)


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city, building_id, x, y, label, and the box of an upright footprint."""
    rows = table(spark, sf_dir, "embeddings").select(
        (F.col("label") % 3).alias("city"), F.col("vec_id").alias("building_id"), part(0).alias("x"), part(1).alias("y"), "label",
        (F.abs(part(2)) / 10.0 + 1.0).alias("hw"), (F.abs(part(3)) / 10.0 + 1.0).alias("hh"),
    )
    return rows.withColumns({"x0": F.col("x") - F.col("hw"), "y0": F.col("y") - F.col("hh"), "x1": F.col("x") + F.col("hw"), "y1": F.col("y") + F.col("hh")})


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city (that of u), road_id, u, v, and the ends: from each node to node u div 2, or 3 for an odd label."""
    b = buildings(spark, sf_dir).select("city", "building_id", "x", "y", "label")
    parent = F.expr("case when label % 2 = 0 then building_id div 2 else building_id div 3 end")
    u = b.select("city", F.col("building_id").alias("u"), parent.alias("v"), F.col("x").alias("ax"), F.col("y").alias("ay")).where("u <> v")
    v = b.select(F.col("building_id").alias("v"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return u.join(v, "v").withColumn("road_id", F.col("u"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city, block_id, box, block_area, max_radius: cells with a building, and those beside one to the east."""
    cells = buildings(spark, sf_dir).select("city", F.floor(F.col("x") / SIDE).alias("cx"), F.floor(F.col("y") / SIDE).alias("cy"))
    cells = cells.union(cells.select("city", F.col("cx") + 1, "cy")).distinct()
    return cells.select(
        "city", ((F.col("cx") + 1000) * 10000 + F.col("cy") + 1000).alias("block_id"),
        (F.col("cx") * SIDE).alias("x0"), (F.col("cy") * SIDE).alias("y0"), ((F.col("cx") + 1) * SIDE).alias("x1"), ((F.col("cy") + 1) * SIDE).alias("y1"),
        F.lit(SIDE * SIDE).alias("block_area"), F.when(F.col("cx") % 5 != 0, 10.0 + F.abs(F.col("cx")) * 7.0 + F.abs(F.col("cy")) * 3.0).alias("max_radius"),
    )


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """city, osmid, x, y, street_count: the number of road ends at each building point."""
    from ..operators.metrics import node_degrees

    b = buildings(spark, sf_dir).select("city", F.col("building_id").alias("osmid"), "x", "y")
    return b.join(node_degrees(segments(spark, sf_dir)).withColumnRenamed("degree", "street_count"), "osmid").select("city", "osmid", "x", "y", "street_count")


PROXY_SQL = """
WITH building AS (
    SELECT *, x - hw AS x0, y - hh AS y0, x + hw AS x1, y + hh AS y1 FROM (
        SELECT label % 3 AS city, vec_id AS building_id, label, round(CAST(embedding[1] AS DOUBLE) * 1000, 3) AS x, round(CAST(embedding[2] AS DOUBLE) * 1000, 3) AS y,
            abs(round(CAST(embedding[3] AS DOUBLE) * 1000, 3)) / 10 + 1 AS hw, abs(round(CAST(embedding[4] AS DOUBLE) * 1000, 3)) / 10 + 1 AS hh
        FROM embeddings)
), segment AS (
    SELECT a.city, a.building_id AS road_id, a.building_id AS u, b.building_id AS v, a.x AS ax, a.y AS ay, b.x AS ex, b.y AS ey
    FROM building a JOIN building b ON b.building_id = a.building_id // (CASE WHEN a.label % 2 = 0 THEN 2 ELSE 3 END) AND a.building_id <> b.building_id
), cell AS (
    SELECT city, CAST(floor(x / 100) AS BIGINT) AS cx, CAST(floor(y / 100) AS BIGINT) AS cy FROM building
    UNION SELECT city, CAST(floor(x / 100) AS BIGINT) + 1, CAST(floor(y / 100) AS BIGINT) FROM building
), block AS (
    SELECT city, (cx + 1000) * 10000 + cy + 1000 AS block_id, cx * 100.0::DOUBLE AS x0, cy * 100.0::DOUBLE AS y0, (cx + 1) * 100.0::DOUBLE AS x1, (cy + 1) * 100.0::DOUBLE AS y1,
        10000.0::DOUBLE AS block_area, CASE WHEN cx % 5 <> 0 THEN 10.0::DOUBLE + abs(cx) * 7 + abs(cy) * 3 END AS max_radius FROM cell
), degree AS (
    SELECT osmid, count(*) AS street_count FROM (SELECT u AS osmid FROM segment UNION ALL SELECT v FROM segment) GROUP BY osmid
), node AS (
    SELECT b.city, b.building_id AS osmid, b.x, b.y, d.street_count FROM building b JOIN degree d ON d.osmid = b.building_id
), held AS (
    SELECT k.city, k.block_id, b.building_id, b.x, b.y, b.label FROM building b JOIN block k ON b.city = k.city AND b.x BETWEEN k.x0 AND k.x1 AND b.y BETWEEN k.y0 AND k.y1
), distance AS (
    SELECT b.city, b.building_id, coalesce(min(sqrt((b.x - (s.ax + t * (s.ex - s.ax))) ** 2 + (b.y - (s.ay + t * (s.ey - s.ay))) ** 2)), 500) AS d
    FROM building b LEFT JOIN (SELECT *, (ex - ax) ** 2 + (ey - ay) ** 2 AS q FROM segment) s ON s.city = b.city
        AND least(s.ax, s.ex) - 200 <= b.x AND greatest(s.ax, s.ex) + 200 >= b.x AND least(s.ay, s.ey) - 200 <= b.y AND greatest(s.ay, s.ey) + 200 >= b.y,
        LATERAL (SELECT greatest(0, least(1, ((b.x - s.ax) * (s.ex - s.ax) + (b.y - s.ay) * (s.ey - s.ay)) / nullif(s.q, 0))) AS t) z
    GROUP BY b.city, b.building_id
), inside AS (
    SELECT k.city, k.block_id, s.*EXCLUDE (city), greatest(0, CASE WHEN ex = ax THEN CASE WHEN ax BETWEEN x0 AND x1 THEN 0 ELSE 2 END ELSE least((x0 - ax) / (ex - ax), (x1 - ax) / (ex - ax)) END,
            CASE WHEN ey = ay THEN CASE WHEN ay BETWEEN y0 AND y1 THEN 0 ELSE 2 END ELSE least((y0 - ay) / (ey - ay), (y1 - ay) / (ey - ay)) END) AS lo,
        least(1, CASE WHEN ex = ax THEN 1 ELSE greatest((x0 - ax) / (ex - ax), (x1 - ax) / (ex - ax)) END,
            CASE WHEN ey = ay THEN 1 ELSE greatest((y0 - ay) / (ey - ay), (y1 - ay) / (ey - ay)) END) AS hi
    FROM segment s JOIN block k ON s.city = k.city
), piece AS (
    SELECT city, block_id, road_id, sum((hi - lo) * sqrt((ex - ax) ** 2 + (ey - ay) ** 2)) AS length,
        min(least(ax + lo * (ex - ax), ax + hi * (ex - ax))) AS px0, min(least(ay + lo * (ey - ay), ay + hi * (ey - ay))) AS py0,
        max(greatest(ax + lo * (ex - ax), ax + hi * (ex - ax))) AS px1, max(greatest(ay + lo * (ey - ay), ay + hi * (ey - ay))) AS py1
    FROM inside WHERE hi > lo GROUP BY city, block_id, road_id
), footprint AS (
    SELECT k.city, k.block_id, b.building_id, greatest(b.x0, k.x0) AS px0, greatest(b.y0, k.y0) AS py0, least(b.x1, k.x1) AS px1, least(b.y1, k.y1) AS py1
    FROM building b JOIN block k ON b.city = k.city AND least(b.x1, k.x1) > greatest(b.x0, k.x0) AND least(b.y1, k.y1) > greatest(b.y0, k.y0)
), place AS (
    SELECT DISTINCT city, block_id, px0, py0, px1, py1 FROM footprint
), slab AS (
    SELECT city, block_id, x AS low, lead(x) OVER (PARTITION BY city, block_id ORDER BY x) AS high
    FROM (SELECT city, block_id, px0 AS x FROM place UNION SELECT city, block_id, px1 FROM place)
), strip AS (
    SELECT city, block_id, high - low AS width, py0, py1, max(py1) OVER (PARTITION BY city, block_id, low ORDER BY py0, py1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
    FROM slab JOIN place USING (city, block_id) WHERE px0 <= low AND px1 >= high
), built AS (
    SELECT city, block_id, built_area, n_buildings FROM (
        SELECT city, block_id, sum(width * greatest(0, py1 - greatest(py0, coalesce(top, py0)))) AS built_area FROM strip GROUP BY city, block_id)
    JOIN (SELECT city, block_id, count(DISTINCT building_id) AS n_buildings FROM footprint GROUP BY city, block_id) USING (city, block_id)
), node_block AS (
    SELECT k.city, k.block_id, n.osmid, n.street_count, sqrt(greatest(k.x0 - n.x, n.x - k.x1, 0) ** 2 + greatest(k.y0 - n.y, n.y - k.y1, 0) ** 2) AS gap
    FROM node n JOIN block k ON n.city = k.city AND n.x BETWEEN k.x0 - 1 AND k.x1 + 1 AND n.y BETWEEN k.y0 - 1 AND k.y1 + 1
), bearing AS (
    SELECT DISTINCT city, osmid, bearing FROM (
        SELECT n.city, n.osmid, (degrees(atan2(s.ey - n.y, s.ex - n.x)) % 360 + 360) % 360 AS bearing FROM segment s JOIN node n ON s.u = n.osmid AND s.city = n.city
        UNION ALL SELECT n.city, n.osmid, (degrees(atan2(s.ay - n.y, s.ax - n.x)) % 360 + 360) % 360 FROM segment s JOIN node n ON s.v = n.osmid AND s.city = n.city)
), gap AS (
    SELECT b.city, b.osmid, n.street_count, count(*) OVER w AS seen,
        coalesce(lead(bearing) OVER (PARTITION BY b.city, b.osmid ORDER BY bearing), min(bearing) OVER w + 360) - bearing AS gap
    FROM bearing b JOIN node n ON b.osmid = n.osmid AND b.city = n.city WHERE n.street_count IN (3, 4) WINDOW w AS (PARTITION BY b.city, b.osmid)
), angle AS (
    SELECT city, osmid, avg(abs(90 - gap)) AS average_angle FROM (
        SELECT *, row_number() OVER (PARTITION BY city, osmid ORDER BY gap) AS place FROM gap WHERE seen = street_count) WHERE place <= street_count - 2 GROUP BY city, osmid
)
"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, without a negative zero."""
    return df.select([(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
