"""Block production and parcel layers on tables, against the kernels run on whole cities, and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.geom import parcels as K
from blockloom.geom import planar as L
from blockloom.geom import shapes as S
from blockloom.operators import geometry as G

A = lambda *p: np.array(p, float)
wkb = lambda p: S.to_wkb(S.Shape("line", [p]))
shape = lambda data: S.from_wkb(bytes(data))


def square(x, y, w, h=None):
    h = w if h is None else h
    return A((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def areas(polygons):
    return sorted(round(S.polygon_area(p), 5) for p in polygons)


def linework():
    """A small grid, a long thin face, a ring road with an island, and a loose end."""
    lines = [A((x, 0), (x, 9)) for x in range(0, 10, 3)] + [A((0, y), (9, y)) for y in range(0, 10, 3)]
    lines += [A((9, 0), (70, 0)), A((9, 3), (70, 3)), A((70, 0), (70, 3))]
    ring = square(-5, -40, 90, 95)
    island = square(40, 20, 5)
    return lines + [np.vstack((r, r[:1])) for r in (ring, island)] + [A((85, 10), (120, 10)), A((50, 55), (50, 40))]


@pytest.mark.parametrize("tiles", [(5.0,), (4.0, 12.0), (500.0,)])
def test_polygonize_finds_every_face(spark, tiles):
    own = linework()
    rows = spark.createDataFrame([(c, wkb(p + 7.3 * c)) for c in (1, 2) for p in own], "city int, geometry binary")
    out = G.polygonize(G.with_box(rows), tiles).collect()
    want = areas(L.polygonize(own))
    assert len(want) == 9 + 1 + 1 + 1
    for c in (1, 2):
        assert areas([p for r in out if r.city == c for p in shape(r.geometry).polygons]) == want


def test_parts_outside_of_polygons():
    p = [[square(0, 0, 10), square(4, 4, 2)]]
    assert [S.line_length(x) for x in L.clip_lines([A((-5, 5), (15, 5))], p, outside=True)] == pytest.approx([5, 2, 5])
    assert L.clip_lines([A((-5, 0), (15, 0))], [], outside=True)[0].tolist() == [[-5, 0], [15, 0]]


def test_blocks_fill_the_extent(spark):
    """Blocks and fill cover the extent but for the lake, none twice, whatever the tiles."""
    lines = [A((x, -10), (x, 310)) for x in (0, 100, 200)] + [A((-10, y), (210, y)) for y in (0, 100, 200, 300)]
    rows = spark.createDataFrame([(1, wkb(p)) for p in lines], "city int, geometry binary")
    box = lambda *b: spark.createDataFrame([(1, S.polygon_wkb([[square(*b)]]))], "city int, geometry binary")
    found = {}
    for tiles in ((2_000.0,), (70.0,)):
        out = G.produce_blocks(rows, box(-50, -50, 400, 400), water=box(-50, -50, 80, 80), tiles=tiles).collect()
        polygons = [p for r in out for p in shape(r.geometry).polygons]
        assert sum(map(S.polygon_area, polygons)) == pytest.approx(400 * 400 - 80 * 80)
        assert sum(map(S.polygon_area, L.union(polygons))) == pytest.approx(400 * 400 - 80 * 80)
        assert sorted(r.block_id for r in out) == list(range(min(r.block_id for r in out), min(r.block_id for r in out) + len(out)))
        found[tiles] = sorted((r.is_fill_block, round(r.block_area, 3)) for r in out)
    assert found[(2_000.0,)] == found[(70.0,)]
    assert sum(not f for f, _ in found[(70.0,)]) == 6


def test_layers_of_blocks_are_those_of_the_kernel(spark):
    rng = np.random.default_rng(4)
    blocks, houses, roads, want = [], [], [], {}
    for b in range(4):
        x0 = 300.0 * b
        area = [[square(x0, 0, 120, 80)]]
        at = np.column_stack((x0 + rng.uniform(2, 118, 12), rng.uniform(2, 78, 12)))
        street = A((x0 + 60, -60), (x0 + 60, 30))
        blocks.append((1, b, S.polygon_wkb(area)))
        houses += [(1, float(x), float(y)) for x, y in at]
        roads.append((1, wkb(street)))
        want[b] = K.complexity(area, at, [street], 100.0)
    box = lambda rows, schema: G.with_box(spark.createDataFrame(rows, schema))
    out = G.parcel_layers(box(blocks, "city int, block_id int, geometry binary"), spark.createDataFrame(houses, "city int, x double, y double"), box(roads, "city int, geometry binary")).collect()
    assert len(out) == 4
    for r in out:
        w = want[r.block_id]
        assert (r.building_count, r.building_layers, r.k_complexity) == (12, ",".join(map(str, w["building_layers"])), w["k_complexity"])
        assert r.on_network_street_length == pytest.approx(w["on_network_street_length"]) and r.nearest_external_street == pytest.approx(w["nearest_external_street"])


def test_representative_points_and_systems(spark):
    hole = [square(0, 0, 10), square(1, 1, 8)]
    shapes = [S.Shape("polygon", [hole]), S.Shape("line", [A((1, 2), (3, 4))]), S.Shape("polygon")]
    rows = spark.createDataFrame([(i, S.to_wkb(s)) for i, s in enumerate(shapes)] + [(9, None)], "id int, geometry binary")
    out = {r.id: r.p for r in rows.select("id", G.representative_point("geometry").alias("p")).collect()}
    assert S.inside(hole, out[0].x, out[0].y)[0] and (out[1].x, out[1].y) == (1, 2) and out[2].x is None and out[9].x is None
