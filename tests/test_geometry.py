import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from blockloom.geom import parcels as K
from blockloom.geom import planar as L
from blockloom.geom import shapes as S

A = lambda *p: np.array(p, float)


def square(x=0.0, y=0.0, w=1.0, h=None):
    h = w if h is None else h
    return A((x, y), (x + w, y), (x + w, y + h), (x, y + h))


def total(polygons):
    return sum(map(S.polygon_area, polygons))


def test_wkb_round_trip_and_measures():
    hole = square(0.25, 0.25, 0.5)[::-1]
    shapes = [
        S.Shape("point", [A((1, 2))]), S.Shape("line", [A((0, 0), (3, 4))]), S.Shape("polygon", [[square(), hole]]), S.Shape("multipoint", [A((1, 2)), A((3, 4))]),
        S.Shape("multiline", [A((0, 0), (1, 1)), A((2, 2), (3, 3))]), S.Shape("multipolygon", [[square()], [square(5, 5)]]), S.Shape("collection", [S.Shape("point", [A((1, 2))]), S.Shape("polygon", [[square()]])]), S.Shape("polygon"), S.Shape("point"),
    ]
    for s in shapes:
        again = S.from_wkb(S.to_wkb(s))
        assert S.to_wkb(again) == S.to_wkb(s) and again.kind == s.kind
        assert S.geojson(again)["type"]
    assert S.area(shapes[2]) == 0.75 and S.area(shapes[5]) == 2
    assert S.centroid(shapes[2]).tolist() == [0.5, 0.5] and S.centroid(shapes[1]).tolist() == [1.5, 2]
    assert S.bounds(shapes[4]) == (0, 0, 3, 3) and S.bounds(shapes[7]) is None
    assert len(S.linework(shapes[6])) == 1 and S.from_wkb(None) is None


def test_distance():
    a = S.Shape("polygon", [[square()]])
    assert S.distance(a, S.Shape("line", [A((2, 0), (2, 5))])) == 1
    assert S.distance(a, S.Shape("line", [A((-1, 0.5), (2, 0.5))])) == 0
    assert S.distance(a, S.Shape("point", [A((0.5, 0.5))])) == 0
    assert S.distance(a, S.Shape("line")) is None


@pytest.mark.parametrize("degrees", [0, 10, 44, 89])
def test_rectangle_azimuth(degrees):
    t = np.radians(degrees)
    r = (square(0, 0, 4, 1)) @ np.array([[np.cos(t), np.sin(t)], [-np.sin(t), np.cos(t)]])
    assert abs(S.rectangle_azimuth(S.Shape("polygon", [[r]])) - degrees) < 1e-6
    assert S.rectangle_azimuth(S.Shape("polygon")) is None


def test_polygonize_a_street_grid_drops_loose_ends():
    lines = [A((x, -1), (x, 4)) for x in range(4)] + [A((-1, y), (4, y)) for y in range(4)]
    faces = L.polygonize(lines)
    assert len(faces) == 9 and all(abs(S.polygon_area(f) - 1) < 1e-9 for f in faces)


def test_polygonize_island_is_a_hole():
    ring = lambda r: np.vstack((r, r[:1]))
    faces = L.polygonize([ring(square(0, 0, 10)), ring(square(4, 4, 2))])
    assert sorted(round(S.polygon_area(f), 6) for f in faces) == [4, 96]


def test_boolean_operations():
    a, b = [[square(0, 0, 2)]], [[square(1, 1, 2)]]
    assert total(L.intersection(a, b)) == pytest.approx(1)
    assert total(L.union(a, b)) == pytest.approx(7) and len(L.union(a, b)) == 1
    assert total(L.difference(a, b)) == pytest.approx(3)
    inner = [[square(0.5, 0.5, 1)]]
    assert total(L.difference(a, inner)) == pytest.approx(3) and len(L.difference(a, inner)[0]) == 2
    assert len(L.difference(a, [[square(0.5, -1, 1, 4)]])) == 2
    assert L.intersection(a, [[square(5, 5)]]) == []
    assert len(L.union(a, [[square(2, 0, 2)]])) == 1  # sides that touch
    bow = A((0, 0), (2, 2), (2, 0), (0, 2))
    assert total(L.repaired([bow])) == pytest.approx(2)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.integers(1, 5), st.integers(1, 5)), min_size=2, max_size=5))
def test_union_of_rectangles_on_a_grid(boxes):
    cells = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
    polygons = [[square(x, y, w, h)] for x, y, w, h in boxes]
    assert total(L.union(polygons)) == pytest.approx(len(cells))
    one, rest = polygons[:1], polygons[1:]
    x, y, w, h = boxes[0]
    own = {(i, j) for i in range(x, x + w) for j in range(y, y + h)}
    others = {(i, j) for x, y, w, h in boxes[1:] for i in range(x, x + w) for j in range(y, y + h)}
    assert total(L.intersection(one, rest)) == pytest.approx(len(own & others))
    assert total(L.difference(one, rest)) == pytest.approx(len(own - others))


def test_clip_lines():
    p = [[square(0, 0, 10), square(4, 4, 2)]]
    assert [S.line_length(x) for x in L.clip_lines([A((-5, 5), (15, 5))], p)] == pytest.approx([4, 4])
    along = L.clip_lines([A((-5, 0), (15, 0))], p)
    assert sum(map(S.line_length, along)) == pytest.approx(10)
    bent = L.clip_lines([A((1, 1), (2, 2), (3, 1), (30, 1))], p)
    assert len(bent) == 1 and S.line_length(bent[0]) == pytest.approx(2 * 2**0.5 + 7)
    assert L.clip_lines([A((20, 20), (30, 30))], p) == []


def test_fill_blocks():
    fill = [[square(0, 0, 10)]]
    faces, how = L.fill_blocks([A((5, -5), (5, 15)), A((2, 3), (3, 3))], fill)
    assert how == "polygonized" and sorted(map(S.polygon_area, faces)) == pytest.approx([50, 50])
    assert L.fill_blocks([], [[square(0, 0, 0.1)]])[1] == "fallback_fill_polygon"


def test_inscribed_circle():
    x, y, r = K.inscribed_circle([[square(0, 0, 10, 4)]], 0.01)
    assert abs(r - 2) < 0.02 and abs(y - 2) < 0.05
    ell = A((0, 0), (10, 0), (10, 2), (2, 2), (2, 10), (0, 10))
    assert abs(K.inscribed_circle([[ell]], 0.001)[2] - (4 - 8**0.5)) < 0.01  # in the corner of the two arms
    assert K.inscribed_circle([[square()], [square(5, 5, 4)]], 0.01)[2] == pytest.approx(2, abs=0.02)


def lattice(n, size=10.0):
    return np.array([((i + 0.5) * size, (j + 0.5) * size) for i in range(n) for j in range(n)])


def test_layers_of_a_lattice():
    for n, layers in ((1, [1]), (2, [4]), (3, [8, 1]), (5, [16, 8, 1]), (6, [20, 12, 4])):
        out = K.complexity([[square(0, 0, 10.0 * n)]], lattice(n), [])
        assert out["building_layers"] == layers and out["k_complexity"] == len(layers) and out["building_count"] == n * n


def test_a_street_into_the_block_gives_access():
    street = A((25.0, -150.0), (25.0, 25.0))
    out = K.complexity([[square(0, 0, 50)]], lattice(5), [street])
    assert out["on_network_street_length"] == pytest.approx(75, abs=1e-3)  # 25 m inside and the 50 m before it
    assert out["off_network_street_length"] == pytest.approx(100, abs=1e-3)
    assert out["building_layers"][0] == 3 and sum(out["building_layers"]) == 25
    assert out["nearest_external_street"] == pytest.approx(0)


def test_complexity_without_buildings_or_area():
    none = K.complexity([[square()]], np.empty((0, 2)), [])
    assert none["k_complexity"] == 1 and none["building_layers"] == [0]
    assert K.complexity([], lattice(2), [])["building_count"] == 0


def test_simplified():
    p = A((0, 0), (1, 0.01), (2, 0), (2, 5))
    assert S.simplified(p, 0.1).tolist() == [[0, 0], [2, 0], [2, 5]]


def test_a_hole_with_an_island_belongs_to_the_ring_around_it():
    """The island's largest part reaches over the hole's interior point; a hole is never a part of what lies in it."""
    frame = [[square(0, 0, 40), square(10, 10, 20)]]
    island = [[square(11, 11, 18)]]
    both = L.union(frame, island)
    assert sum(map(S.polygon_area, both)) == pytest.approx(1200 + 324) and len(both) == 2
    assert sum(map(S.polygon_area, L.intersection(both, [[square(0, 0, 40)]]))) == pytest.approx(1524)


def test_the_union_of_many_polygons():
    rng = np.random.default_rng(5)
    boxes = [(int(x), int(y), int(w), int(h)) for x, y, w, h in zip(*rng.integers(0, 60, (2, 150)), *rng.integers(1, 9, (2, 150)))]
    cells = {(i, j) for x, y, w, h in boxes for i in range(x, x + w) for j in range(y, y + h)}
    found = L.union([[square(x, y, w, h)] for x, y, w, h in boxes])
    assert sum(map(S.polygon_area, found)) == pytest.approx(len(cells))


def test_reach_is_the_share_of_points_that_are_near():
    rng = np.random.default_rng(2)
    e, targets = rng.uniform(-50, 50, (40, 4)), rng.uniform(-30, 30, (50, 4))
    e[0, 2:], targets[0, 2:], targets[1, 1] = e[0, :2], targets[0, :2], targets[1, 3]  # points, and a level one
    t = (np.arange(4_000) + 0.5) / 4_000
    for radius in (1.0, 6.0):
        want = 0.0
        for s in e:
            at = s[:2] + t[:, None] * (s[2:] - s[:2])
            want += (S.points_to_segments(at, targets) <= radius).mean() * np.hypot(*(s[2:] - s[:2]))
        assert K.reach_within(e, targets, radius) == pytest.approx(want, rel=2e-4)


def test_a_block_of_many_streets_is_quick():
    """Pairs of a street near the block and one in it were some 200 rounds of distances each."""
    import time

    rng = np.random.default_rng(4)
    streets, points = list(rng.uniform(-120, 220, (1_200, 2, 2))), np.round(rng.uniform(0, 100, (500, 2)), 3)
    start = time.process_time()
    out = K.complexity([[square(0, 0, 100)]], points, streets)
    assert time.process_time() - start < 15 and sum(out["building_layers"]) >= 500


def test_reach_and_access_take_little_memory():
    """What streets reach and how near they are, of thousands of streets in one block: as all pairs give, in little memory."""
    rng = np.random.default_rng(6)
    at = rng.uniform(0, 100, (1_500, 2))
    out = np.hstack((at, rng.normal(50, 120, (1_500, 2))))
    streets = [s.reshape(2, 2) for s in out]
    tracemalloc.start()
    found = K.complexity([[np.array([(0, 0), (100, 0), (100, 100), (0, 100)], float)]], at + 1e-3, streets, 100.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6
    assert found["nearest_external_street"] == pytest.approx(min(S.points_to_segments(at[k : k + 50] + 1e-3, out).min() for k in range(0, 1_500, 50)))


def test_clipped_segments_are_those_of_lines():
    rng = np.random.default_rng(7)
    hole = [[np.array([(0, 0), (10, 0), (10, 10), (0, 10)], float), np.array([(3, 3), (3, 6), (6, 6), (6, 3)], float)]]
    e = np.vstack((np.round(rng.uniform(-3, 13, (300, 4))), rng.uniform(-3, 13, (300, 4))))
    for s in e:
        want = sum(map(S.line_length, L.clip_lines([s.reshape(2, 2)], hole)))
        own = L.clip_segments(s[None], hole, 5)
        assert np.hypot(own[:, 2] - own[:, 0], own[:, 3] - own[:, 1]).sum() == pytest.approx(want, abs=1e-9)
    both = L.clip_segments(e, hole, 50)
    assert len(both) == sum(len(L.clip_segments(s[None], hole)) for s in e)


def test_what_is_reached_lies_within_the_radius():
    """Against points along the segments, with targets that are points, parallel, and far apart."""
    for seed in range(4):
        rng = np.random.default_rng(seed)
        e, c = rng.uniform(-200, 200, (60, 4)), rng.uniform(-60, 60, (40, 2))
        targets = np.hstack((c, c + rng.normal(0, (0.0, 20.0, 80.0, 1e-3)[seed], (40, 2))))
        t = (np.arange(4_000) + 0.5) / 4_000
        want = 0.0
        for s in e:
            p = s[:2] + t[:, None] * (s[2:] - s[:2])
            want += float((S.points_to_segments(p, targets) <= 30).mean() * np.hypot(*(s[2:] - s[:2])))
        assert K.reach_within(e, targets, 30.0, 500, 3) == pytest.approx(want, rel=1e-3)
