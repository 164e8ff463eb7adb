import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import names as N
from blockloom.functions import numeric as U
from blockloom.functions.projection import from_utm, to_utm, utm_epsg
from blockloom.geom import shapes as S
from blockloom.operators import geometry as G
from blockloom.operators import matching as A
from blockloom.operators import metrics as M
from blockloom.operators import spatial as X
from blockloom.operators import tables as R


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_missing_values(spark):
    d = lambda v: F.lit(v).cast("double")
    assert one(spark, U.clean(d(float("nan")))) is None and one(spark, U.clean(d(float("inf")))) is None and one(spark, U.clean(d(2.0))) == 2
    assert one(spark, U.ratio(F.lit(1), F.lit(0))) is None
    assert one(spark, U.at_most(d(None), 5.0)) is None and one(spark, U.at_least(d(None), 5.0)) is None
    assert one(spark, U.row_mean([d(None), d(1.0), d(2.0)])) == 1.5 and one(spark, U.row_mean([d(None)])) is None
    assert [one(spark, U.bin_of(d(v), 0.0, 180.0, 18)) for v in (0.0, 9.99, 180.0, 180.1, None)] == [0, 0, 17, None, None]
    assert one(spark, U.azimuth(d(0.0), d(-1.0))) == 270


def test_divergence_of_even_and_single_bins(spark):
    rows = spark.createDataFrame([("even", float(5 + 10 * i)) for i in range(18)] + [("one", 7.0)] * 4 + [("none", None)], "g string, a double")
    out = {r.g: r.m for r in U.histogram_divergence(rows, ["g"], "a", 0.0, 180.0, 18, "m").collect()}
    assert abs(out["even"]) < 1e-12 and abs(out["one"] - 1) < 1e-12 and "none" not in out


def test_box_join_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    def boxes(n, id_):
        lo = rng.uniform(-500, 500, (n, 2))
        size = rng.exponential(60, (n, 2))
        return [(int(i), int(i % 2), *map(float, (*a, *(a + s)))) for i, (a, s) in enumerate(zip(lo, size))], f"{id_} int, city int, x0 double, y0 double, x1 double, y1 double"
    (a, sa), (b, sb) = boxes(120, "a"), boxes(90, "b")
    for pad in (0.0, 35.0):
        got = sorted((r.a, r.b) for r in X.box_join(spark.createDataFrame(a, sa), spark.createDataFrame(b, sb), ["city"], 100.0, pad).collect())
        want = sorted((p[0], q[0]) for p in a for q in b if p[1] == q[1] and p[2] <= q[4] + pad and p[4] >= q[2] - pad and p[3] <= q[5] + pad and p[5] >= q[3] - pad)
        assert got == want


def test_nearest_segment_window_and_default(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 0.0, 900.0)], "city int, building_id int, x double, y double")
    roads = spark.createDataFrame([(1, 150.0, 150.0, 400.0, 400.0), (2, 0.0, 0.0, 1.0, 1.0)], "city int, ax double, ay double, bx double, by double")
    out = {r.building_id: r.distance_to_nearest_road for r in M.distances(points, roads).collect()}
    assert out[1] == pytest.approx(150 * 2**0.5) and out[2] == 500  # in the window's box, though beyond 200 m


def test_counts_do_not_depend_on_partitions(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0, 1e4)], "city int, block_id int, x0 double, y0 double, x1 double, y1 double, block_area double")
    foot = spark.createDataFrame([(1, 1, 7, 0.0, 0.0, 10.0, 5.0), (1, 1, 7, 0.0, 5.0, 5.0, 10.0), (1, 1, 8, 5.0, 5.0, 10.0, 10.0)], "city int, block_id int, building_id int, px0 double, py0 double, px1 double, py1 double").repartition(3)
    nodes = spark.createDataFrame([(1, 1, 5, 4), (1, 1, 5, 4), (1, 1, 6, 3), (1, 1, 9, 1)], "city int, block_id int, osmid int, street_count int").repartition(4)
    pieces = spark.createDataFrame([], "city int, block_id int, length double")
    r = M.block_base(blocks, M.built_rectangles(foot), pieces, nodes).first()
    assert (r.n_buildings, r.built_area, r.n_intersections, r.intersections_3plus, r.intersections_4way) == (2, 100.0, 2, 2, 1)
    assert r.m4_raw == 0.5 and r.m3_raw == 0 and r.m12_raw == 50 and not r.has_roads


def boxes_at_random(seed, n=60, size=250):
    rng = np.random.default_rng(seed)
    low = rng.integers(0, size, (n, 2))
    return np.hstack((low, low + rng.integers(1, 40, (n, 2))))


def test_covered_area_counts_every_place_once(spark):
    """Footprints over several cells of the grid, some equal, some within others, against a raster."""
    rows, want = [], {}
    for block in range(3):
        boxes = boxes_at_random(block)
        boxes = np.vstack((boxes, boxes[:20], [[10, 10, 290, 290]] if block == 2 else np.empty((0, 4), int)))
        raster = np.zeros((300, 300), bool)
        for i, (x0, y0, x1, y1) in enumerate(boxes.tolist()):
            raster[x0:x1, y0:y1] = True
            rows.append((1, block, i, *map(float, (x0, y0, x1, y1))))
        want[block] = (float(raster.sum()), len(boxes))
    foot = spark.createDataFrame(rows, "city int, block_id int, building_id int, px0 double, py0 double, px1 double, py1 double").repartition(3)
    assert {r.block_id: (round(r.built_area, 6), r.n_buildings) for r in M.built_rectangles(foot).collect()} == want
    assert M.built_rectangles(foot.limit(0)).count() == 0


def test_two_equal_footprints_are_one_place(spark):
    one = spark.createDataFrame([(1, i, 10.0, 10.0, 50.0, 50.0) for i in (1, 2)], "city int, building_id int, x0 double, y0 double, x1 double, y1 double")
    block = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0)], "city int, block_id int, x0 double, y0 double, x1 double, y1 double")
    r = M.built_rectangles(M.rectangle_pieces(one, block)).first()
    assert (r.built_area, r.n_buildings) == (1_600.0, 2)
    shape = lambda df: df.withColumn("geometry", G.rectangle_wkb("x0", "y0", "x1", "y1", F.lit(0.0)))
    r = G.built_polygons(shape(one), shape(block), cell=30.0).first()
    assert (round(r.built_area, 6), r.n_buildings) == (1_600.0, 2)


def test_a_long_segment_is_a_row_for_each_piece(spark):
    long = spark.createDataFrame([(1, 1, 0.0, 0.0, 30_000.0, 30_000.0)], "city int, road_id int, ax double, ay double, bx double, by double")
    cut = X.split_segments(long, 400.0)
    assert X._dealt(X.segment_box(cut), "l__", 100.0, 0.0).count() <= 2_500 < X._dealt(X.segment_box(long), "l__", 100.0, 0.0).count()
    assert X._dealt(X.segment_box(long), "r__", 32 * 200.0, 200.0).count() <= 100
    ends = sorted((r.ax, r.ay, r.bx, r.by) for r in cut.collect())
    assert ends[0][:2] == (0, 0) and ends[-1][2:] == (30_000, 30_000) and all(a[2:] == b[:2] for a, b in zip(ends, ends[1:]))
    blocks = spark.createDataFrame([(1, 7, 900.0, 900.0, 2_000.0, 1_500.0)], "city int, block_id int, x0 double, y0 double, x1 double, y1 double")
    (r,) = M.road_pieces(long, blocks).collect()
    assert r.length == pytest.approx(600 * 2**0.5) and (r.px0, r.py0, r.px1, r.py1) == pytest.approx((900, 900, 1_500, 1_500))
    points = spark.createDataFrame([(1, 1, 0.0, 300.0), (1, 2, 40_000.0, 0.0)], "city int, building_id int, x double, y double")
    out = {r.building_id: r.distance_to_nearest_road for r in M.distances(points, long).collect()}
    assert out[1] == pytest.approx(300 / 2**0.5) and out[2] == 500


def test_right_angles(spark):
    b = spark.createDataFrame([(1, 1, x) for x in (0.0, 90.0, 180.0, 270.0)] + [(1, 2, x) for x in (10.0, 100.0, 190.0)] + [(1, 3, 0.0), (1, 3, 90.0), (1, 3, 90.0)], "city int, osmid int, bearing double")
    n = spark.createDataFrame([(1, 1, 4), (1, 2, 3), (1, 3, 3)], "city int, osmid int, street_count int")
    assert {r.osmid: r.average_angle for r in M.right_angle_deviation(b, n).collect()} == {1: 0.0, 2: 0.0}


def test_first_group_wins(spark):
    a = spark.createDataFrame([(1, 1, 5)], "city int, block_id int, n int")
    b = spark.createDataFrame([(1, 1, 9, 2.0, 3)], "city int, block_id int, n int, x double, k_complexity int")
    out = R.consolidate([a, b], M.BLOCK, {1: "k_"})
    assert out.columns == ["city", "block_id", "n", "k_n", "k_x", "k_complexity"] and out.first().n == 5
    assert R.consolidate([a, b], M.BLOCK).columns == ["city", "block_id", "n", "x", "k_complexity"]


def test_classes(spark):
    cases = [
        (0, 0.9, 0.9, 0.9, 0.9, "open_space"), (1, 0.4, 0.9, 0.9, 0.9, "open_space"), (1, 0.9, 0.4, 0.9, 0.9, "non_residential"), (1, 0.9, 0.9, 0.7, 0.9, "irregular_settlement"),
        (1, 0.9, 0.9, 0.8, 0.5, "formal_subdivision"), (1, 0.9, 0.9, 0.8, 0.4, "informal_subdivision"), (1, 0.9, 0.9, 0.8, None, "unclassified"), (1, None, None, 0.9, 0.9, "formal_subdivision"), (None, 0.9, 0.9, None, 0.9, "unclassified"),
    ]
    names = "n_buildings int, p_built double, p_residential double, p_subdivision double, p_formal double, want string"
    for r in R.classify(spark.createDataFrame(cases, names)).collect():
        assert r.classification == r.want
    alone = spark.createDataFrame([(1, 0.9, 0.9, 0.85, None)], "n_buildings int, p_built double, p_residential double, p_subdivision double, p_formal double")
    assert R.classify(alone).first().classification == "subdivision"
    assert R.classify(alone.select("p_subdivision")).first().regularity_index == 0.85


@pytest.mark.parametrize("text, key, token", [("São Paulo", "saopaulo", "Sao_Paulo"), (" nan ", "", ""), (None, "", ""), ("SÃ£o Paulo", "saopaulo", "Sao_Paulo"), ("Val-d’Or / Québec", "valdorquebec", "Val_d_Or_Quebec"), ("__a__", "a", "a")])
def test_name_keys(spark, text, key, token):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(N.name_key(F.col("c")), N.folder_token(F.col("c"))).first() == (key, token)


def test_match_plan(spark):
    wanted = spark.createDataFrame([(0, "Medellín", ""), (1, "Medelin", ""), (2, "Mexico", ""), (3, "", ""), (4, "Nowhere", ""), (5, "Here", "There"), (6, "San Jose", "")], "row_index int, city string, country string")
    names = ["Medellin", "Mexico City", "San José", "San_Jose", "Somewhere Else"]
    catalogue = spark.createDataFrame([(n,) for n in names], "name string")
    over = spark.createDataFrame([("here", "there", "Mapped")], "city string, country string, name string")
    out = {r.row_index: (r.name, r.match_method, r.is_ambiguous) for r in A.match_plan(wanted, catalogue, over).collect()}
    assert out[0] == ("Medellin", "NAME_KEY_UNIQUE", False) and out[1] == ("Medellin", "FUZZY_UNIQUE", False) and out[2] == ("Mexico City", "LIKE_UNIQUE", False)
    assert out[3][1] == "EMPTY_CITY_KEY" and out[4] == (None, "NO_GPKG_MATCH", False) and out[5][:2] == ("Mapped", "OVERRIDE")
    assert out[6][:2] == ("San_Jose", "NAME_KEY_MULTI_BEST_GUESS")


def test_near_keys_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    words = lambda n: sorted({"".join(rng.choice(list("abcdez"), rng.integers(1, 9))) for _ in range(n)})
    a, b = words(60), words(80)
    frame = lambda w: spark.createDataFrame([(x,) for x in w], "key string")
    from difflib import SequenceMatcher

    got = {r.key: round(r.score, 9) for r in A.near_keys(frame(a), frame(b)).collect()}
    best = {x: max(SequenceMatcher(None, x, y).ratio() for y in b) for x in a}
    assert got == {x: round(s, 9) for x, s in best.items() if s >= A.NEAR_KEY}


def test_utm_of_a_known_place(spark):
    lon, lat = F.lit(2.2945), F.lit(48.8582)  # 448252 E, 5411935 N in zone 31
    x, y = to_utm(lon, lat, utm_epsg(lon, lat))
    e, n, code = spark.range(1).select(x, y, utm_epsg(lon, lat)).first()
    assert code == 32631 and abs(e - 448252) < 5 and abs(n - 5411935) < 25
    back = spark.range(1).select(*from_utm(F.lit(e), F.lit(n), F.lit(code))).first()
    assert abs(back[0] - 2.2945) < 1e-9 and abs(back[1] - 48.8582) < 1e-9


def test_polygonize_in_tiles_equals_whole(spark):
    rng = np.random.default_rng(3)
    lines = [np.array([(x, -20.0), (x, 620.0)]) for x in np.cumsum(rng.uniform(20, 150, 8))] + [np.array([(-20.0, y), (720.0, y)]) for y in np.cumsum(rng.uniform(20, 150, 7))]
    df = spark.createDataFrame([(1, S.to_wkb(S.Shape("line", [p]))) for p in lines], "city int, geometry binary")
    from blockloom.geom.planar import polygonize

    areas = lambda faces: sorted(round(S.polygon_area(p), 4) for p in faces)
    got = [p for r in G.polygonize(G.with_box(df), tiles=(50.0, 200.0, 800.0)).collect() for p in S.from_wkb(r.geometry).polygons]
    assert areas(got) == areas(polygonize(lines))


def test_produce_blocks(spark):
    """A square kilometre with a cross of roads and a lake: four quarters, and the rim of the extent as fill."""
    line = lambda *p: S.to_wkb(S.Shape("line", [np.array(p, float)]))
    ring = lambda a, b: S.to_wkb(S.Shape("polygon", [[np.array([(a, a), (b, a), (b, b), (a, b)], float)]]))
    frame = lambda rows: spark.createDataFrame([(1, r) for r in rows], "city int, geometry binary")
    roads = frame([line((0, 0), (1000, 0), (1000, 1000), (0, 1000), (0, 0)), line((0, 500), (1000, 500)), line((500, 0), (500, 1000))])
    out = G.produce_blocks(roads, frame([ring(-100, 1100)]), water=frame([ring(100, 300)]), tiles=(2_000.0,)).toPandas().sort_values("block_id")
    assert out.block_id.tolist() == list(range(len(out)))
    base, rim = out[~out.is_fill_block], out[out.is_fill_block]
    assert sorted(base.block_area.round()) == [210_000, 250_000, 250_000, 250_000]
    assert rim.block_area.sum() == pytest.approx(1200**2 - 1000**2) and set(rim.fill_method) == {"polygonized"}
    assert base.max_radius.max() == pytest.approx(250, abs=1)


def test_numbers_by_cells(spark):
    rows = spark.createDataFrame([(c, float(i * 37 % 100)) for c in (1, 2) for i in range(100)], "city int, x0 double")
    out = R.number_blocks(rows, ["x0"], {"x": F.floor(F.col("x0") / 10)}).toPandas()
    for _, city in out.groupby("city"):
        assert city.sort_values("x0").block_id.tolist() == list(range(100))


def test_missing_groups(spark):
    b = spark.createDataFrame([(1, 1, 9)], "city int, block_id int, n int")
    assert R.consolidate([None, b, None], M.BLOCK).first().n == 9
    with pytest.raises(ValueError):
        R.consolidate([None], M.BLOCK)


def test_dissolve_and_hull(spark):
    box = lambda x, w: S.to_wkb(S.Shape("polygon", [[np.array([(x, 0), (x + w, 0), (x + w, 1), (x, 1)], float)]]))
    rows = spark.createDataFrame([("a", box(0, 2)), ("a", box(1, 2)), ("a", box(9, 1)), ("b", box(0, 1)), ("c", None)], "city string, geometry binary")
    out = {r.city: S.from_wkb(bytes(r.geometry)) for r in G.dissolve(rows, ["city"], tile=1.0).collect()}
    assert S.area(out["a"]) == pytest.approx(4) and len(out["a"].polygons) == 2 and set(out) == {"a", "b"}
    hulls = G.dissolve(rows, ["city"]).withColumn("h", G.convex_hull("geometry")).collect()
    assert {r.city: S.area(S.from_wkb(bytes(r.h))) for r in hulls} == {"a": 10, "b": 1}


def test_labels_and_bounds(spark):
    rows = spark.createDataFrame([("formal_subdivision", 0.8765, 12345.6, 0.0, 1.0, 2.0, 3.0), (None, None, None, -1.0, 0.0, 1.0, 9.0)], "classification string, regularity_index double, block_area double, x0 double, y0 double, x1 double, y1 double")
    assert [r.tooltip for r in R.tooltip(rows).collect()] == [
        "<b>Formal Subdivision</b><br>Regularity index: 0.88<br>Block area: 12,346 m²", "<b>Unclassified</b><br>Regularity index: N/A<br>Block area: 0 m²",
    ]
    assert tuple(R.bounds(rows).first()) == (-1.0, 0.0, 2.0, 9.0)


def test_buffers():
    from blockloom.geom import planar as L

    total = lambda p: sum(map(S.polygon_area, p))
    corner = 32 * np.sin(np.pi / 32)  # a disc of 64 sides
    ell = [[np.array([(0, 0), (10, 0), (10, 4), (4, 4), (4, 10), (0, 10)], float)]]
    assert total(L.buffer(ell, 1.0)) == pytest.approx(64 + 40 + corner - (1 - corner / 4), abs=1e-6)  # the inner corner lacks a square less a quarter disc
    assert total(L.buffer(ell, -1.0)) == pytest.approx(64 - 40 + 4 + (1 - corner / 4), abs=1e-6)
    assert L.buffer(ell, -3.0) == [] and L.buffer([], 2.0) == [] and L.buffer(ell, 0.0) is ell
    square = [[np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float)]]
    near = L.inner_buffer_of_area(square, 50.0, tries=12)
    assert abs(total(near) - 50) < 10 and L.inner_buffer_of_area(square, 100.0) is square and L.inner_buffer_of_area(square, 64.0)[0][0].min() == pytest.approx(1)
