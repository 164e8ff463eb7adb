import json
import sqlite3
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from blockloom.geom import shapes as S
from blockloom.operators.geometry import with_box
from blockloom.sources import layers as L
from blockloom.sources import runs as R
from blockloom.streaming.arrivals import follow, windowed_counts

SQUARE = S.Shape("polygon", [[np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float)]])


def test_conform(spark):
    rows = spark.createDataFrame([(["a", "b"], float("nan"), 3, "x")], "id array<string>, azimuth double, extra int, geometry string")
    out = L.conform(rows, "buildings")
    assert out.columns == [*L.LAYERS["buildings"].names, "extra"]
    assert out.first().id == "a, b" and out.first().azimuth is None and out.first().distance_to_nearest_road is None


def test_layers_by_city_and_runs(spark, tmp_path):
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    rows = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", None)], "city string, max_radius double")
    L.write_layer(rows, source)
    cities = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "city string")

    def make(todo):
        if todo.where("city = 'b'").count():
            raise ValueError("b is bad")
        return spark.read.parquet(source).join(todo, "city").where("max_radius is not null")

    first = {r.city: (r.status, r.n_rows) for r in R.run_group(spark, cities, make, out, ignore=["e"], inputs=[source]).collect()}
    assert first == {"a": ("ok", 1), "b": ("failed", 0), "c": ("empty", 0), "d": ("missing_input", 0), "e": ("ignored", 0)}
    assert {r.city: r.status for r in L.still_wanted(spark, cities, out).collect()} == {"a": "done", "b": "todo", "c": "todo", "d": "todo", "e": "todo"}
    plan = L.read_layer(spark, source, "blocks", "a")
    assert plan.count() == 1 and "PartitionFilters: [isnotnull(city" in plan._jdf.queryExecution().toString()
    assert sorted(r.n_rows for r in L.files_of(spark, source).collect()) == [1, 1, 1]
    R.record(first and R.run_group(spark, cities, make, out), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 5
    with pytest.raises(ValueError):
        L.write_layer(rows, out, "gpkg")


def test_box_filter_reaches_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("double(id) as x0", "double(id) as y0", "double(id + 1) as x1", "double(id + 1) as y1").write.parquet(str(tmp_path / "p"))
    out = L.in_box(spark.read.parquet(str(tmp_path / "p")), 10, 10, 12, 12)
    assert out.count() == 4 and "LessThanOrEqual(x0" in out._jdf.queryExecution().toString()


def test_csv(spark, tmp_path):
    rows = spark.createDataFrame([("São Paulo, SP", "Brazil")], "city_name string, country_name string")
    L.write_csv(rows, str(tmp_path / "c"))
    assert L.read_csv(spark, str(tmp_path / "c"), "city_list").collect() == rows.collect()


def test_geoparquet(spark, tmp_path):
    rows = spark.createDataFrame([(i, S.to_wkb(SQUARE)) for i in range(10)], "block_id int, geometry binary").repartition(2)
    written = L.write_geoparquet(rows, str(tmp_path / "g"))
    assert written.agg(F.sum("n_rows")).first()[0] == 10 == sum(r.n_rows for r in written.collect())
    assert spark.read.parquet(str(tmp_path / "g")).count() == 10  # however often the result is looked at
    geo = json.loads(pq.read_metadata(tmp_path / "g" / written.first().file).metadata[b"geo"])
    assert geo["primary_column"] == "geometry"
    column = geo["columns"]["geometry"]
    assert (column["encoding"], column["geometry_types"], column["bbox"], column["crs"]["id"]["code"]) == ("WKB", ["Polygon"], [0, 0, 2, 2], 4326)
    assert sorted(p.name for p in (tmp_path / "g").iterdir()) == sorted(r.file for r in written.collect())
    L.write_geoparquet(rows.limit(0), str(tmp_path / "h"))
    L.write_geoparquet(rows.limit(3), str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 13


def test_geoparquet_in_another_system(spark, tmp_path):
    at = str(tmp_path / "g")
    ring = np.array([(3.0, 50.0), (3.01, 50.0), (3.01, 50.01), (3.0, 50.01)])
    shapes = [S.Shape("polygon", [[ring]]), S.Shape("collection", [S.Shape("line", [ring]), S.Shape("point", [ring[:1]])])]
    rows = spark.createDataFrame([(i, S.to_wkb(x)) for i, x in enumerate(shapes)] + [(9, None)], "block_id int, geometry binary")
    L.write_geoparquet(rows, at)
    assert L.read_geoparquet(spark, at).schema == rows.schema
    out = L.read_geoparquet(spark, at, 32631)
    utm = {r.block_id: S.from_wkb(r.geometry and bytes(r.geometry)) for r in out.collect()}
    assert utm[9] is None and abs(utm[0].polygons[0][0][0] - (500_000, 5_538_630.7)).max() < 0.1  # on the zone's middle
    L.write_geoparquet(out, str(tmp_path / "u"), 32631)
    assert L.epsg_of(L.geo_metadata(str(tmp_path / "u"))) == 32631
    back = {r.block_id: S.from_wkb(r.geometry and bytes(r.geometry)) for r in L.read_geoparquet(spark, str(tmp_path / "u"), 4326).collect()}
    assert abs(back[0].polygons[0][0] - ring).max() < 1e-9 and abs(back[1].lines[0] - ring).max() < 1e-9
    area = {r.block_id: S.from_wkb(r.geometry and bytes(r.geometry)) for r in L.read_geoparquet(spark, at, 6933).collect()}
    assert S.area(area[0]) == pytest.approx(S.area(utm[0]) / 0.9996**2, rel=1e-4)
    with pytest.raises(ValueError):
        L.crs_json(27700)


def test_geopackage(spark, tmp_path):
    path = str(tmp_path / "x.gpkg")
    with sqlite3.connect(path) as con:
        con.executescript("create table gpkg_contents (table_name text, data_type text); create table gpkg_geometry_columns (table_name text, column_name text); create table cities (fid integer, city_name text, geom blob)")
        con.execute("insert into gpkg_contents values ('cities', 'features')")
        con.execute("insert into gpkg_geometry_columns values ('cities', 'geom')")
        head = b"GP\0" + bytes([1 | 1 << 1]) + struct.pack("<i4d", 4326, 0, 2, 0, 2)
        con.executemany("insert into cities values (?, ?, ?)", [(1, "A", head + S.to_wkb(SQUARE)), (2, "B", head + S.to_wkb(SQUARE))])
    out = L.read_geopackage(spark, path, columns=["city_name", "geom"], where="city_name = 'B'").collect()
    assert len(out) == 1 and S.area(S.from_wkb(bytes(out[0].geometry))) == 4
    with pytest.raises(ValueError):
        L.read_geopackage(spark, path, "nothing")


def test_shapefile(spark, tmp_path):
    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    body = struct.pack("<i4dii1i", 5, 0, 0, 2, 2, 1, 5, 0) + b"".join(struct.pack("<dd", *p) for p in ring)
    record = struct.pack(">ii", 1, len(body) // 2) + body
    (tmp_path / "s.shp").write_bytes(bytes(100) + record)
    head = struct.pack("<B3BIHH20x", 3, 0, 0, 0, 1, 32 + 64 + 1, 1 + 8 + 4)
    field = lambda n, t, k: n.encode().ljust(11, b"\0") + t + bytes(4) + bytes([k]) + bytes(15)
    (tmp_path / "s.dbf").write_bytes(head + field("name", b"C", 8) + field("n", b"N", 4) + b"\r" + b" " + b"Kano    " + b"  12")
    r = L.read_shapefile(spark, str(tmp_path / "s.shp")).first()
    assert (r.name, r.n) == ("Kano", 12) and S.area(S.from_wkb(bytes(r.geometry))) == 4


def test_gather_status(spark):
    want = spark.createDataFrame([(c, x) for c in "abc" for x in ("roads", "water")], "city string, layer string")
    have = spark.createDataFrame([("a", "roads"), ("a", "water"), ("b", "roads")], "city string, layer string")
    assert {(r.city, r.status, r.missing) for r in R.gather_status(want, have).collect()} == {("a", "OK", ""), ("b", "PARTIAL", "water"), ("c", "FAIL", "roads, water")}


def test_arriving_cities(spark, tmp_path):
    source, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    add = lambda *rows: spark.createDataFrame(rows, "city string, v int").write.mode("append").parquet(source)
    schema = spark.createDataFrame([], "city string, v int").schema
    for rows in ([("a", 1), ("b", 2)], [("a", 3)], [("c", 4), ("a", 5)]):
        add(*rows)
        follow(spark, source, schema, lambda d: d.withColumn("v", F.col("v") * 10), out, mark).awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted((r.city, r.v) for r in got.collect()) == [("a", 10), ("a", 30), ("a", 50), ("b", 20), ("c", 40)]
    assert got.where("city = 'a'").select("batch").distinct().count() == 3


def test_windows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_shapefile_round_trip(spark, tmp_path):
    hole = np.array([(0.5, 0.5), (1, 0.5), (1, 1), (0.5, 1)])
    ring = SQUARE.parts[0][0]
    shapes = [SQUARE, S.Shape("polygon", [[ring, hole]]), S.Shape("multipolygon", [[ring], [ring + 5]])]
    rows = [(i, f"ñ{i}", 0.5 * i, S.to_wkb(s)) for i, s in enumerate(shapes)] + [(9, None, None, None)]
    n = L.write_shapefile(spark.createDataFrame(rows, "block_id int, name string, radius double, geometry binary"), str(tmp_path / "o.shp"))
    back = L.read_shapefile(spark, str(tmp_path / "o.shp")).collect()
    assert n == len(back) == 4 and [r.name for r in back] == ["ñ0", "ñ1", "ñ2", None] and back[2].radius == 1.0
    assert [S.area(S.from_wkb(bytes(r.geometry))) for r in back[:3]] == [4, 3.75, 8] and back[3].geometry is None


def test_preprocess_makes_distances_then_directions(spark, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("buildings", "roads", "distances", "azimuths")}
    line = S.to_wkb(S.Shape("line", [np.array([(0.0, -3.0), (9.0, -3.0)])]))
    L.write_layer(spark.createDataFrame([("a", "h1", S.to_wkb(SQUARE)), ("b", "h2", S.to_wkb(SQUARE))], "city string, id string, geometry binary"), paths["buildings"])
    L.write_layer(spark.createDataFrame([("a", line)], "city string, geometry binary"), paths["roads"])
    cities = spark.createDataFrame([("a",), ("b",)], "city string")
    run = lambda: {r.city: (r.status, r.distances_skipped) for r in R.preprocess(spark, cities, paths["buildings"], paths["roads"], paths["distances"], paths["azimuths"]).collect()}
    assert run() == {"a": ("ok", False), "b": ("missing_inputs", False)}
    assert run() == {"a": ("ok", True), "b": ("missing_inputs", False)}
    (r,) = spark.read.parquet(paths["azimuths"]).collect()
    assert (r.city, r.id, r.distance_to_nearest_road, r.azimuth) == ("a", "h1", 3.0, 0.0)


def test_gather_every_layer(spark, tmp_path):
    cities = spark.createDataFrame([("a",), ("b",)], "city string")
    layers = {"roads": lambda todo: todo.withColumn("v", F.lit(1)), "water": lambda todo: todo.where("city = 'a'").withColumn("v", F.lit(1))}
    got = {(r.city, r.status, r.missing) for r in R.gather(spark, cities, layers, str(tmp_path)).collect()}
    assert got == {("a", "OK", ""), ("b", "PARTIAL", "water")}


def test_masks_of_land_and_water(spark, tmp_path):
    """Lines and points are left out, crossing rings made valid, what is far from the box is not read."""
    at = str(tmp_path / "m")
    ring = SQUARE.parts[0][0]
    bow = S.Shape("polygon", [[np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)]])
    shapes = [SQUARE, S.Shape("polygon", [[ring + (1, 0)]]), S.Shape("line", [ring]), S.Shape("polygon", [[ring + (50, 50)]]), bow]
    rows = spark.createDataFrame([(i, S.to_wkb(s)) for i, s in enumerate(shapes)], "id int, geometry binary")
    L.write_geoparquet(with_box(rows), at)
    water = {r.id: S.area(S.from_wkb(bytes(r.geometry))) for r in L.read_water(spark, at).collect()}
    assert water == {0: 4, 1: 4, 3: 4, 4: pytest.approx(2)}
    (land,) = L.read_land(spark, at, 0, 0, 4, 4, "a").collect()
    assert land.city == "a" and S.area(S.from_wkb(bytes(land.geometry))) == pytest.approx(6)
