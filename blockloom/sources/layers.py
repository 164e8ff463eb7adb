"""Layers of the engine: their columns, readers that prune and push down, writers, and runs that skip what is done."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import clean


def _schema(**columns: str) -> T.StructType:
    kinds = {"string": T.StringType, "long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType}
    out = T.StructType()
    for name, kind in columns.items():
        out = out.add(name, kinds[kind]())
    return out


# The columns of the layers, which other programs read and write.
LAYERS: dict[str, T.StructType] = {
    "city_list": _schema(city_name="string", country_name="string"),
    "conventions": _schema(combined_city_name="string", convention_name="string"),
    "search_buffer": _schema(city_name="string", csv_city_raw="string", csv_country_raw="string", csv_city_key="string", match_method="string", row_index="long", geometry="binary"),
    "urban_extent": _schema(city_name="string", source="string", geometry="binary"),
    "roads": _schema(osmid="string", u="long", v="long", highway="string", geometry="binary"),
    "intersections": _schema(osmid="string", street_count="int", geometry="binary"),
    "natural_features": _schema(geometry="binary"),
    "inland_water": _schema(geometry="binary"),
    "land": _schema(geometry="binary"),
    "buildings": _schema(id="string", distance_to_nearest_road="double", azimuth="double", geometry="binary"),
    "blocks": _schema(block_id="long", optimal_point="string", max_radius="double", is_fill_block="boolean", fill_method="string", block_area="double", geometry="binary"),
}


def conform(rows: DataFrame, layer: str) -> DataFrame:
    """The layer's columns in their types, then those that the layer does not name; missing ones NULL, NaN as NULL,
    lists of tags as one text. Done once, when a layer comes in."""
    have = dict(rows.dtypes)
    out = []
    for f in LAYERS[layer].fields:
        kind = have.get(f.name)
        c: Column = F.col(f"`{f.name}`") if kind else F.lit(None)
        if kind and kind.startswith("array") and isinstance(f.dataType, T.StringType):
            c = F.array_join(c, ", ")
        c = clean(c) if kind and isinstance(f.dataType, T.DoubleType) else c.cast(f.dataType)
        out.append(c.alias(f.name))
    return rows.select(*out, *[F.col(f"`{c}`") for c in rows.columns if c not in LAYERS[layer].names])


def read_layer(spark: SparkSession, path: str, layer: str, city: str | list[str] | None = None) -> DataFrame:
    """A layer from Parquet, a file or a folder; folders ``city=...`` give the column and are pruned by it."""
    rows = spark.read.parquet(path)
    if city is not None:
        rows = rows.where(F.col("city").isin([city] if isinstance(city, str) else city))
    return conform(rows, layer)


def in_box(rows: DataFrame, x0: float, y0: float, x1: float, y1: float, pad: float = 0.01) -> DataFrame:
    """Rows whose box (columns x0.., or a struct bbox of xmin..) comes within ``pad`` of a box: inequalities that
    reach the scan."""
    c = {"x0": "bbox.xmin", "y0": "bbox.ymin", "x1": "bbox.xmax", "y1": "bbox.ymax"} if "bbox" in rows.columns else {k: k for k in ("x0", "y0", "x1", "y1")}
    return rows.where((F.col(c["x0"]) <= x1 + pad) & (F.col(c["x1"]) >= x0 - pad) & (F.col(c["y0"]) <= y1 + pad) & (F.col(c["y1"]) >= y0 - pad))


def read_csv(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Text columns separated by semicolons, under a header, in UTF-8."""
    rows = spark.read.csv(path, sep=";", header=True, encoding="utf-8", multiLine=False)
    return conform(rows, layer) if layer else rows


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, sep=";", header=True)


def write_layer(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """One folder a city; only the cities of ``rows`` are replaced. Formats: parquet, csv, json."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError(f"no writer for {fmt}")
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("city")
    {"parquet": writer.parquet, "json": writer.json, "csv": lambda p: writer.csv(p, sep=";", header=True)}[fmt](path)


def cities_with(spark: SparkSession, path: str) -> DataFrame:
    """(city, n_rows) of what is written under a folder; a folder that is not there has none."""
    try:
        rows = spark.read.parquet(path)
    except Exception as e:  # the catalogue of a first run
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return spark.createDataFrame([], "city string, n_rows long")
        raise
    return rows.groupBy(F.col("city").cast("string").alias("city")).agg(F.count("*").alias("n_rows"))


def still_wanted(spark: SparkSession, cities: DataFrame, out: str | None, ignore: list[str] = [], inputs: list[str] = []) -> DataFrame:
    """(city, status): ``todo``, or why not: ``ignored``, ``done`` (rows are there; without ``out`` nothing is), or
    ``missing_input``."""
    there = cities_with(spark, out) if out else spark.createDataFrame([], "city string, n_rows long")
    done = there.where("n_rows > 0").select("city", F.lit(True).alias("done__"))
    rows = cities.select(F.col("city").cast("string").alias("city")).distinct().join(done, "city", "left")
    ready = F.lit(True)
    for i, path in enumerate(inputs):
        has = cities_with(spark, path).where("n_rows > 0").select("city", F.lit(True).alias(f"in{i}__"))
        rows = rows.join(has, "city", "left")
        ready = ready & F.col(f"in{i}__").isNotNull()
    status = F.when(F.col("city").isin(ignore), "ignored").when(F.col("done__").isNotNull(), "done").when(~ready, "missing_input").otherwise("todo")
    return rows.select("city", status.alias("status"))


def files_of(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, changed, n_rows) of a layer's files: emptiness by rows, not by bytes."""
    m = F.col("_metadata")
    rows = spark.read.parquet(path).select(m["file_path"].alias("file"), m["file_size"].alias("size"), m["file_modification_time"].alias("changed"))
    return rows.groupBy("file", "size", "changed").agg(F.count("*").alias("n_rows"))


def read_land(spark: SparkSession, path: str, x0: float, y0: float, x1: float, y1: float, city: str, epsg: int | None = None) -> DataFrame:
    """(city, geometry): the polygons of a mask of land near a box, united; the box reaches the scan."""
    from ..operators.geometry import dissolve, polygons_only

    rows = polygons_only(in_box(read_geoparquet(spark, path), x0, y0, x1, y1)).withColumn("city", F.lit(city))
    if epsg:
        from ..operators.geometry import reproject

        rows = rows.withColumn("geometry", reproject(F.col("geometry"), epsg_of(geo_metadata(path)), epsg))
    return dissolve(rows.select("city", "geometry"), ["city"])


def read_water(spark: SparkSession, path: str, epsg: int | None = None) -> DataFrame:
    """A layer of inland water: polygons alone, made valid, in the system asked for, with the other columns."""
    from ..operators.geometry import polygons_only

    return polygons_only(read_geoparquet(spark, path, epsg))


# The names of shapes in GeoParquet footers.
GEOMETRY_TYPES = {"point": "Point", "line": "LineString", "polygon": "Polygon", "multipoint": "MultiPoint", "multiline": "MultiLineString", "multipolygon": "MultiPolygon", "collection": "GeometryCollection"}


def crs_json(epsg: int) -> dict:
    """A reference system as PROJJSON: degrees, or a zone of universal transverse Mercator."""
    base = {
        "type": "GeographicCRS", "name": "WGS 84", "datum": {"type": "GeodeticReferenceFrame", "name": "World Geodetic System 1984", "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563}},
        "coordinate_system": {"subtype": "ellipsoidal", "axis": [{"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"}, {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"}]},
        "id": {"authority": "EPSG", "code": 4326},
    }
    if epsg == 4326:
        return base
    zone, south = epsg % 100, epsg // 100 == 327
    if epsg // 100 not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"EPSG:{epsg} is neither 4326 nor a zone of universal transverse Mercator")
    values = [("Latitude of natural origin", 0, "degree"), ("Longitude of natural origin", zone * 6 - 183, "degree"), ("Scale factor at natural origin", 0.9996, "unity"), ("False easting", 500000, "metre"), ("False northing", 10000000 if south else 0, "metre")]
    axis = lambda name, short, to: {"name": name, "abbreviation": short, "direction": to, "unit": "metre"}
    return {
        "type": "ProjectedCRS", "name": f"WGS 84 / UTM zone {zone}{'S' if south else 'N'}", "base_crs": base,
        "conversion": {"name": f"UTM zone {zone}{'S' if south else 'N'}", "method": {"name": "Transverse Mercator"}, "parameters": [{"name": n, "value": v, "unit": u} for n, v, u in values]},
        "coordinate_system": {"subtype": "Cartesian", "axis": [axis("Easting", "E", "east"), axis("Northing", "N", "north")]}, "id": {"authority": "EPSG", "code": epsg},
    }


def geo_footer(epsg: int, kinds: list[str], box: list[float] | None) -> bytes:
    """The ``geo`` entry of a GeoParquet footer."""
    column = {"encoding": "WKB", "geometry_types": sorted(GEOMETRY_TYPES[k] for k in kinds), "crs": crs_json(epsg), "edges": "planar"} | ({"bbox": box} if box else {})
    return json.dumps({"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": column}}).encode()


def open_folder(path: str):
    """The file system and the folder of a path."""
    from pyarrow import fs as pafs

    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def write_geoparquet(rows: DataFrame, path: str, epsg: int = 4326) -> DataFrame:
    """GeoParquet files with footers of their own (system, kinds of shapes, box), one for each partition that has rows,
    added to the folder ``path`` through ``pyarrow.fs``. Returns (file, n_rows) of the files.

    The job runs at once and only once. Tasks write to a folder of this call; when all have ended, the files that the
    job reports are moved into place, so that neither a repeated task nor a failed job leaves rows behind."""
    import uuid

    import pyarrow as pa

    names, call = rows.schema.names, uuid.uuid4().hex
    at = rows.schema.names.index("geometry")

    def write(batches):
        import numpy as np
        import pyarrow.parquet as pq

        from ..geom import shapes as S

        fs, folder = open_folder(path)
        fs.create_dir(f"{folder}/_{call}", recursive=True)
        name, n, writer, kinds, box = f"{uuid.uuid4().hex}.parquet", 0, None, set(), np.array([np.inf, np.inf, -np.inf, -np.inf])
        for b in batches:
            if writer is None:
                sink = fs.open_output_stream(f"{folder}/_{call}/{name}")
                writer = pq.ParquetWriter(sink, b.schema)
            writer.write_batch(pa.RecordBatch.from_arrays(b.columns, schema=writer.schema))
            n += b.num_rows
            for data in b.column(at):
                shape = S.from_wkb(data.as_py())
                if shape is not None:
                    kinds.add(shape.kind)
                    own = S.bounds(shape)
                    if own is not None:
                        box = np.concatenate((np.minimum(box[:2], own[:2]), np.maximum(box[2:], own[2:])))
        if writer is not None:
            writer.add_key_value_metadata({"geo": geo_footer(epsg, sorted(kinds), box.tolist() if np.isfinite(box).all() else None).decode()})
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["file", "n_rows"])

    found = [(r.file, r.n_rows) for r in rows.select(*names).mapInArrow(write, "file string, n_rows long").collect()]
    fs, folder = open_folder(path)
    for file, _ in found:
        fs.move(f"{folder}/_{call}/{file}", f"{folder}/{file}")
    from pyarrow import fs as pafs

    if fs.get_file_info(f"{folder}/_{call}").type == pafs.FileType.Directory:
        fs.delete_dir(f"{folder}/_{call}")
    return rows.sparkSession.createDataFrame(found, "file string, n_rows long")


def geo_metadata(path: str) -> dict:
    """The ``geo`` entry of the first file of a GeoParquet file or folder; empty if it has none."""
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, at = open_folder(path)
    if fs.get_file_info(at).type == pafs.FileType.Directory:
        files = sorted(i.path for i in fs.get_file_info(pafs.FileSelector(at, recursive=True)) if i.base_name.endswith(".parquet") and "/_" not in i.path[len(at) :])
        if not files:
            return {}
        at = files[0]
    with fs.open_input_file(at) as f:
        return json.loads((pq.read_metadata(f).metadata or {}).get(b"geo", b"{}"))


def epsg_of(meta: dict) -> int:
    """The EPSG code of the main column; 4326 where the footer names no system, as the format has it."""
    column = meta.get("columns", {}).get(meta.get("primary_column", "geometry"), {})
    crs = column.get("crs") or {}
    code = crs.get("id", {}).get("code", 4326)
    return 4326 if code in ("CRS84", 4326) else int(code)


def read_geoparquet(spark: SparkSession, path: str, epsg: int | None = None) -> DataFrame:
    """A GeoParquet file or folder with its main column as ``geometry``, in the system ``epsg`` if one is asked for.
    The system that it comes from is read from the footer."""
    from ..operators.geometry import reproject

    meta = geo_metadata(path)
    rows = spark.read.parquet(path)
    main = meta.get("primary_column", "geometry")
    if main != "geometry":
        rows = rows.withColumnRenamed(main, "geometry")
    own = epsg_of(meta)
    return rows if epsg in (None, own) else rows.withColumn("geometry", reproject(F.col("geometry"), own, epsg))


def read_geopackage_blob(data: bytes | None) -> bytes | None:
    """The well-known binary within a GeoPackage geometry, whose header holds flags, a system and maybe a box."""
    if data is None or data[:2] != b"GP":
        return data
    box = (data[3] >> 1) & 7
    struct.unpack_from("<i" if data[3] & 1 else ">i", data, 4)
    return data[8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[box]:]


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """A layer of a GeoPackage, a file of one machine, read with columns and condition in its own SQL; done once, at
    ingest, by the driver, for catalogues of names and extents. Without a layer the first one."""
    import sqlite3

    import pandas as pd

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        layers = [r[0] for r in con.execute("SELECT table_name FROM gpkg_contents WHERE data_type = 'features' ORDER BY table_name")]
        if not layers or layer and layer not in layers:
            raise ValueError(f"layers of the file: {layers}")
        layer = layer or layers[0]
        (geometry,) = con.execute("SELECT column_name FROM gpkg_geometry_columns WHERE table_name = ?", (layer,)).fetchone()
        listed = ", ".join('"%s"' % c.replace('"', '""') for c in columns) if columns else "*"
        rows = pd.read_sql_query(f'SELECT {listed} FROM "{layer}"' + (f" WHERE {where}" if where else ""), con)
    if geometry in rows:
        rows[geometry] = rows[geometry].map(read_geopackage_blob)
        rows = rows.rename(columns={geometry: "geometry"})
    return spark.createDataFrame(rows)


def read_shapefile(spark: SparkSession, path: str) -> DataFrame:
    """A shapefile of polygons, lines or points, and its table of attributes in UTF-8, read once, at ingest."""
    import numpy as np

    from ..geom import shapes as S

    def parts_of(raw: bytes, at: int) -> list[np.ndarray]:
        n, m = struct.unpack_from("<ii", raw, at + 36)
        cuts = [*struct.unpack_from(f"<{n}i", raw, at + 44), m]
        xy = np.frombuffer(raw, "<f8", 2 * m, at + 44 + 4 * n).reshape(-1, 2)
        return [xy[a:b] for a, b in zip(cuts, cuts[1:])]

    with open(path, "rb") as f:
        raw = f.read()
    found, at = [], 100
    while at < len(raw):
        (size,) = struct.unpack_from(">i", raw, at + 4)
        kind = struct.unpack_from("<i", raw, at + 8)[0] % 10
        if kind == 0:
            found.append(None)
        elif kind == 1:
            found.append(S.to_wkb(S.Shape("point", [np.array([struct.unpack_from("<dd", raw, at + 12)])])))
        elif kind == 3:
            lines = parts_of(raw, at + 8)
            found.append(S.to_wkb(S.Shape("line" if len(lines) == 1 else "multiline", lines)))
        elif kind == 5:
            rings = [S.open_ring(r) for r in parts_of(raw, at + 8)]
            outer = [[r] for r in rings if S.ring_area(r) < 0]  # clockwise rings are outer ones
            for h in (r for r in rings if S.ring_area(r) > 0):
                next((p for p in outer if S.inside(p[:1], *h[0])[0]), outer[0] if outer else []).append(h)
            found.append(S.to_wkb(S.Shape("polygon" if len(outer) == 1 else "multipolygon", outer)))
        else:
            raise ValueError(f"shape type {kind} is not read")
        at += 8 + 2 * size
    with open(path[:-4] + ".dbf", "rb") as f:
        dbf = f.read()
    n, head, width = struct.unpack_from("<IHH", dbf, 4)
    fields, at, start = [], 32, 1
    while dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode()
        fields.append((name, chr(dbf[at + 11]), start, dbf[at + 16]))
        start, at = start + dbf[at + 16], at + 32
    rows = []
    for i in range(n):
        record = dbf[head + i * width : head + (i + 1) * width]
        value = lambda t, a, k: (s := record[a : a + k].decode("utf-8", "replace").strip()) and (float(s) if t in "NF" else s) or None  # noqa: E731, B023
        rows.append((*[value(t, a, k) for _, t, a, k in fields], found[i]))
    schema = T.StructType()
    for name, t, _, _ in fields:
        schema = schema.add(name, T.DoubleType() if t in "NF" else T.StringType())
    return spark.createDataFrame(rows, schema.add("geometry", T.BinaryType()))


def write_shapefile(rows: DataFrame, path: str) -> int:
    """A shapefile of polygons with its index and table, for programs that read nothing else: an export of one city or
    less, through one machine, row by row. Texts are cut at 254 bytes and names at 10, as the format has it."""
    import numpy as np

    from ..geom import shapes as S

    names = [f for f in rows.schema.fields if f.name != "geometry"]
    numeric = [isinstance(f.dataType, T.NumericType) for f in names]
    shapes, offsets, table, box = bytearray(), bytearray(), bytearray(), np.array([np.inf, np.inf, -np.inf, -np.inf])
    n = 0
    for r in rows.toLocalIterator():
        s = S.from_wkb(bytes(r.geometry)) if r.geometry is not None else S.Shape("polygon")
        rings = [np.vstack((q, q[:1])) for p in s.polygons for i, q in enumerate([x[::-1] if (S.ring_area(x) > 0) == (k == 0) else x for k, x in enumerate(p)])]
        if rings:
            xy = np.concatenate(rings)
            own = np.concatenate((xy.min(axis=0), xy.max(axis=0)))
            box = np.concatenate((np.minimum(box[:2], own[:2]), np.maximum(box[2:], own[2:])))
            starts = np.cumsum([0, *map(len, rings)])[:-1]
            body = struct.pack("<i4dii", 5, *own, len(rings), len(xy)) + starts.astype("<i4").tobytes() + xy.astype("<f8").tobytes()
        else:
            body = struct.pack("<i", 0)
        n += 1
        offsets += struct.pack(">ii", (100 + len(shapes)) // 2, len(body) // 2)
        shapes += struct.pack(">ii", n, len(body) // 2) + body
        table += b" "
        for f, is_number in zip(names, numeric):
            v = r[f.name]
            if is_number:
                table += ("" if v is None else f"{v:.10g}").rjust(20).encode()[:20]
            else:
                table += ("" if v is None else str(v)).encode()[:254].ljust(254)
    if not n or np.isinf(box).any():
        box = np.zeros(4)

    def head(size: int) -> bytes:
        return struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + size) // 2) + struct.pack("<ii8d", 1000, 5, *box, 0, 0, 0, 0)

    fields = b"".join(f.name.encode()[:10].ljust(11, b"\0") + (b"N" if k else b"C") + bytes(4) + bytes([20 if k else 254, 9 if k else 0]) + bytes(14) for f, k in zip(names, numeric))
    width = 1 + sum(20 if k else 254 for k in numeric)
    files = {".shp": head(len(shapes)) + shapes, ".shx": head(len(offsets)) + offsets, ".dbf": struct.pack("<B3BIHH20x", 3, 124, 1, 1, n, 33 + len(fields), width) + fields + b"\r" + table, ".cpg": b"UTF-8"}
    for suffix, data in files.items():
        with open(path.removesuffix(".shp") + suffix, "wb") as f:
            f.write(data)
    return n
