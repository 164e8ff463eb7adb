"""Faces of dense linework, square by square, against the plain kernel over all lines at once."""

import tracemalloc

import numpy as np
import pytest

from blockloom.geom import arrangement as R
from blockloom.geom import planar as L
from blockloom.geom import shapes as S
from blockloom.operators import geometry as G

wkb = lambda p: S.to_wkb(S.Shape("line", [p]))


def dense(n, seed=1):
    """Lines at random, some along the borders of squares, an island and a line that leads nowhere."""
    rng = np.random.default_rng(seed)
    lines = [rng.normal(0, 40, (2, 2)) for _ in range(n)]
    lines += [np.round(p / 8) * 8 for p in lines[: n // 3]] + [np.array([(-64, y), (64, y)], float) for y in (-8, 0, 8, 3)]
    return lines + [np.array([(250.0, 250), (270, 250), (270, 270), (250, 250)]), np.array([(0.0, 0), (300, 1)])]


def rings(polygons):
    """Areas and numbers of corners of the faces that are more than slivers."""
    return sorted((round(S.polygon_area(p), 6), sum(len(L.straight(r)) for r in p)) for p in polygons if S.polygon_area(p) > 1e-6)


@pytest.mark.parametrize("edges,grow", [(5_000.0, 4), (1e5, 4)])
def test_squares_give_the_faces_of_all_lines(spark, edges, grow):
    own = dense(60)
    rows = spark.createDataFrame([(c, wkb(p + 11.3 * c)) for c in (0, 1) for p in own], "city int, geometry binary")
    want = L.polygonize(own)
    for least in (0.0,) if edges > 1e4 else (30.0,):
        faces, outlines = G._faces_and_outlines(G.with_box(rows), (2_000.0,), least, edges, grow)
        faces, outlines = faces.collect(), outlines.collect()
        for c in (0, 1):
            of = lambda out, c=c: [p for r in out if r.city == c for p in S.from_wkb(bytes(r.geometry)).polygons]
            assert rings(of(faces)) == rings(p for p in want if S.polygon_area(p) >= least)
            assert sum(map(S.polygon_area, of(outlines))) == pytest.approx(sum(map(S.polygon_area, want)), abs=1e-5)


def test_a_square_holds_its_own_faces_only():
    """What a task takes is a small part of what the faces of a whole city take."""
    lines = [np.random.default_rng(5).uniform(0, 400, (400, 2, 2))][0]

    def peak(f):
        tracemalloc.start()
        f()
        size = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return size

    e = S.line_segments(list(lines))
    _, x, y, p = R.pieces_in_squares(e, 32.0)
    i, j = max(zip(*np.unique(np.column_stack((x, y)), axis=0).T), key=lambda c: ((x == c[0]) & (y == c[1])).sum())
    mine = (x == i) & (y == j)
    none = np.zeros(mine.sum(), bool)
    whole = peak(lambda: L.polygonize(list(lines)))
    assert peak(lambda: R.settle(p[mine], none, none, (i * 32, j * 32, i * 32 + 32, j * 32 + 32))) < whole / 20
    assert peak(lambda: R.settle(e, np.zeros(len(e), bool), np.zeros(len(e), bool), None, 700.0)) < whole


def test_what_is_settled_is_not_found_again():
    square = lambda a, b: np.array([(a, a, b, a), (b, a, b, b), (b, b, a, b), (a, b, a, a)], float)
    e = np.vstack((square(0, 10), square(4, 6)))
    left = np.array([False] * 4 + [True] * 4)
    out = R.settle(e, left, np.zeros(8, bool), None)
    assert [S.polygon_area(p) for p in out.faces] == [96.0] and [S.polygon_area(p) for p in out.outlines] == [100.0]
    assert not len(R.settle(np.empty((0, 4)), np.empty(0, bool), np.empty(0, bool), (0, 0, 1, 1)).edges)


def test_lines_with_their_middles_in_a_row_are_not_dealt_to_tiny_squares(spark):
    lines = [np.array([(x, -10), (x, 310)], float) for x in (0, 100, 200)] + [np.array([(-10, y), (210, y)], float) for y in (0, 100, 200, 300)]
    rows = spark.createDataFrame([(1, wkb(p)) for p in lines], "city int, geometry binary")
    assert rings(p for r in G.polygonize(G.with_box(rows)).collect() for p in S.from_wkb(bytes(r.geometry)).polygons) == [(10_000.0, 4)] * 6


@pytest.mark.parametrize("first,seed", [(20, 0), (60, 1), (150, 2)])
def test_rounds_give_the_large_faces_of_all_lines(first, seed):
    """Lines in rounds, in squares that the lines reach over, and then all that is open: as all lines at once."""
    own = dense(220, seed + 10) + [np.array([(30, 60), (90, 60), (90, 100), (30, 100), (30, 60)], float), np.array([(95, 20), (140, 80)], float)]
    e = S.line_segments(own)
    none = np.zeros(len(e), bool)
    want = R.settle(e, none, none, None, 30.0)
    _, x, y, p = R.pieces_in_squares(e, 64.0)
    found, left = [], []
    for i, j in np.unique(np.column_stack((x, y)), axis=0):
        f = R.settle_large(p[(x == i) & (y == j)], (i * 64.0, j * 64.0, i * 64.0 + 64, j * 64.0 + 64), 30.0, 64.0, first)
        found += f.faces
        left.append((f.edges, f.left, f.right))
    f = R.settle(*map(np.concatenate, zip(*left)), None, 30.0, 64.0)
    assert rings(found + f.faces) == rings(want.faces)
    assert sum(map(S.polygon_area, f.outlines)) == pytest.approx(sum(map(S.polygon_area, want.outlines)), abs=1e-5)


def test_rounds_leave_most_of_a_dense_square_uncut(monkeypatch):
    e = np.random.default_rng(3).uniform(0, 300, (4_000, 4))
    count, points_on = [], R.points_on
    monkeypatch.setattr(R, "points_on", lambda e: count.append(len((out := points_on(e))[0])) or out)
    f = R.settle_large(e, (0.0, 0.0, 512.0, 512.0), 700.0)
    every = np.random.default_rng(4).integers(0, 4_000, (2, 20_000))
    crossings = S.crossing(e[every[0][:200]], e[every[1][:200]]).mean() * 4_000**2 / 2
    assert max(count) < crossings / 3 and len(f.edges)


def test_a_short_edge_does_not_settle_a_face():
    """An edge turned by rounding tells that a large face is settled; the rest of its outline tells that it is not."""
    e = np.array([(0, 0, 30, 0), (30, 0, 30, 30), (30, 30, 0, 30), (0, 30, 0, 1e-4), (0, 1e-4, 0, 0)], float)
    assert [S.polygon_area(p) for p in R.settle(e, np.array([False] * 4 + [True]), np.zeros(5, bool), None).faces] == [900.0]


def test_links_and_pairs():
    assert R.linked(6, np.array([5, 4, 1]), np.array([4, 2, 0])).tolist() == [0, 0, 2, 3, 2, 2]
    e = np.random.default_rng(8).uniform(0, 50, (300, 4))
    pairs = {(min(i, j), max(i, j)) for a in R.pairs_in_cells(e, 1_000) for i, j in zip(*a)}
    assert pairs >= {(i, j) for i, j in np.argwhere(np.triu(S.crossing(e, e), 1))}
