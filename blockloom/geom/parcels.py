"""Largest inscribed circles, and the number of layers of parcels behind a block's accessible ones."""

from __future__ import annotations

import heapq
import math

import numpy as np

from .planar import EPS, Faces, Vertices, clip_segments, cut, repaired
from .shapes import Polygon, Shape, centroid, crossing, inside, interior_point, line_segments, points_to_segments, polygon_area, segments_of


def inscribed_circle(polygons: list[Polygon], tolerance: float = 1.0) -> tuple[float, float, float] | None:
    """Centre and radius of the largest circle in one of the polygons, to ``tolerance``; of equals the first."""
    best = None
    for p in polygons:
        e = segments_of(p)
        lo, hi = p[0].min(axis=0), p[0].max(axis=0)
        size = max(float((hi - lo).min()), float((hi - lo).max()) / 32)
        if (hi - lo).min() <= 0:
            continue

        def reach(x: float, y: float) -> float:
            d = float(points_to_segments(np.array([[x, y]]), e)[0])
            return d if inside(p, x, y)[0] else -d

        queue: list[tuple[float, float, float, float]] = []
        half = size / 2
        for x in np.arange(lo[0], hi[0], size):
            for y in np.arange(lo[1], hi[1], size):
                heapq.heappush(queue, (-(reach(x + half, y + half) + half * math.sqrt(2)), x + half, y + half, half))
        c = centroid(Shape("polygon", [p]))
        found = max((reach(*c), *c), (reach(*(q := interior_point(p))), *q))
        while queue:
            bound, x, y, h = heapq.heappop(queue)
            if -bound - found[0] <= tolerance:
                break
            d = reach(x, y)
            if d > found[0]:
                found = (d, x, y)
            for dx in (-h / 2, h / 2):
                for dy in (-h / 2, h / 2):
                    r = reach(x + dx, y + dy)
                    if r + h / 2 * math.sqrt(2) > found[0] + tolerance:
                        heapq.heappush(queue, (-(r + h / 2 * math.sqrt(2)), x + dx, y + dy, h / 2))
        if best is None or found[0] > best[2]:
            best = (float(found[1]), float(found[2]), float(found[0]))
    return best


def voronoi_edges(points: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """Segments (n, 4) between cells of nearest points, within a box: each cell by cutting it along the middle lines to
    the points around, nearest first, until none can reach it."""
    x0, y0, x1, y1 = box
    out = []
    for i, p in enumerate(points):
        cell, owner = np.array([[x0, y0], [x1, y0], [x1, y1], [x0, y1]]), [-1] * 4
        d = np.hypot(*(points - p).T)
        for j in np.argsort(d, kind="stable"):
            if j == i:
                continue
            if d[j] > 2 * np.hypot(*(cell - p).T).max():
                break
            n, m = points[j] - p, (points[j] + p) / 2
            side = (cell - m) @ n
            if (side <= 0).all():
                continue
            new, own = [], []
            for k in range(len(cell)):
                a, b, sa, sb = cell[k], cell[(k + 1) % len(cell)], side[k], side[(k + 1) % len(cell)]
                if sa <= 0:
                    new.append(a)
                    own.append(owner[k])
                if (sa <= 0) != (sb <= 0):
                    new.append(a + sa / (sa - sb) * (b - a))
                    own.append(int(j) if sa <= 0 else owner[k])
            cell, owner = np.array(new), own
        for k, j in enumerate(owner):
            if j > i:
                out.append(np.concatenate((cell[k], cell[(k + 1) % len(cell)])))
    return np.array(out) if out else np.empty((0, 4))


def _near_interval(e: np.ndarray, t: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """From and to, as shares of each segment of ``e``, of the part within ``radius`` of the target of the same row; to
    below from: none. The places near a target are its band and a disc at each end, together convex."""
    p, d = e[:, :2], e[:, 2:] - e[:, :2]
    u = t[:, 2:] - t[:, :2]
    long, a = np.hypot(*u.T), (d * d).sum(axis=1)
    lo, hi = np.full(len(e), np.inf), np.full(len(e), -np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for end in (t[:, :2], t[:, 2:]):
            r = p - end
            half, c = (r * d).sum(axis=1) / a, ((r * r).sum(axis=1) - radius * radius) / a
            root = np.sqrt(half * half - c)  # nan where the disc is missed
            lo, hi = np.fmin(lo, -half - root), np.fmax(hi, -half + root)
        along, r = u / long[:, None], p - t[:, :2]
        x, dx = (r * along).sum(axis=1), (d * along).sum(axis=1)
        y, dy = along[:, 0] * r[:, 1] - along[:, 1] * r[:, 0], along[:, 0] * d[:, 1] - along[:, 1] * d[:, 0]
        first, last = np.full(len(e), -np.inf), np.full(len(e), np.inf)
        for v, dv, low, high in ((x, dx, np.zeros(len(e)), long), (y, dy, -radius, radius)):
            one, two = (low - v) / dv, (high - v) / dv
            level = np.where((v >= low) & (v <= high), -np.inf, np.inf)
            first = np.maximum(first, np.where(dv == 0, level, np.minimum(one, two)))
            last = np.minimum(last, np.where(dv == 0, -level, np.maximum(one, two)))
        band = (long > 0) & (first <= last)
    return np.clip(np.where(band, np.minimum(lo, first), lo), 0, None), np.clip(np.where(band, np.maximum(hi, last), hi), None, 1)


def _joined(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals within 0 to 1 of each row, as those apart from each other that cover the same."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    # Rows lie two apart on one axis, so that what lies before on it is the same row's, or ends before the row.
    reached = np.maximum.accumulate(np.concatenate(([-1.0], hi + 2.0 * row)))[:-1]
    first = np.flatnonzero(lo + 2.0 * row > reached)
    return row[first], lo[first], np.maximum.reduceat(hi, first) if len(first) else hi[:0]


def least_distance(p: np.ndarray, e: np.ndarray, at_once: int = 200_000) -> float:
    """The least distance of points from segments, some pairs at a time; 0 where a point is an end of one."""
    if np.isin(np.ascontiguousarray(p).view(complex), np.ascontiguousarray(np.vstack((e[:, :2], e[:, 2:]))).view(complex)).any():
        return 0.0
    lo, hi = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
    best, many = np.inf, max(1, min(100, at_once // max(1, len(e))))
    for start in range(0, len(p), many):
        own = p[start : start + many]
        near = e[((lo <= own.max(axis=0) + best) & (hi >= own.min(axis=0) - best)).all(axis=1)]
        for at in range(0, len(near), at_once):
            best = min(best, float(points_to_segments(own, near[at : at + at_once]).min()))
    return best


def _dealt(n: np.ndarray, at_once: int) -> list[tuple[int, int]]:
    """From and to of runs of rows with about ``at_once`` pairs each; row i has ``n[i]``."""
    made, out, start = np.cumsum(n), [], 0
    while start < len(n):
        end = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + at_once, "right")))
        out.append((start, end))
        start = end
    return out


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers from ``first[i]`` on, ``n[i]`` of them, for one i after the other."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def reach_within(e: np.ndarray, targets: np.ndarray, radius: float, at_once: int = 200_000, few: int = 8) -> float:
    """The total length of the parts of segments within ``radius`` of the target segments. Squares around the targets are
    near or far as a whole, by the least distance of their middles, or quartered, with the parts of segments in them and
    those targets that can be the nearest to a place in them. In squares with ``few`` targets, or that are small, each
    target is near along one interval of a part, and the intervals of a part are united."""
    size = np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1])
    e, size = e[size > EPS], size[size > EPS]
    if not len(targets) or not len(e):
        return 0.0
    low, high = np.minimum(targets[:, :2], targets[:, 2:]).min(axis=0) - radius, np.maximum(targets[:, :2], targets[:, 2:]).max(axis=0) + radius
    p, d = e[:, :2], e[:, 2:] - e[:, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        one, two = (low - p) / d, (high - p) / d
    outside = (p < low) | (p > high)
    t0 = np.where(d == 0, np.where(outside, 2.0, 0.0), np.minimum(one, two)).max(axis=1).clip(0, None)
    t1 = np.where(d == 0, 1.0, np.maximum(one, two)).min(axis=1).clip(None, 1)
    own = np.flatnonzero(t0 < t1)  # parts of segments: which, from, to, in which square
    t0, t1, square = t0[own], t1[own], np.zeros(len(own), np.int64)
    half, middle = float((high - low).max()) / 2, ((low + high) / 2)[None]
    first, n, cand = np.zeros(1, np.int64), np.array([len(targets)]), np.arange(len(targets))
    q, way = targets[:, :2], targets[:, 2:] - targets[:, :2]
    long = np.maximum((way * way).sum(axis=1), 1e-300)
    total = 0.0
    while len(own):
        used, square = np.unique(square, return_inverse=True)
        middle, first, n = middle[used], first[used], n[used]
        reach, least, kept, count = half * math.sqrt(2), np.empty(len(used)), [], []
        for a, b in _dealt(n, at_once):
            c = cand[_runs(first[a:b], n[a:b])]
            r = np.repeat(middle[a:b], n[a:b], axis=0) - q[c]
            t = np.clip((r * way[c]).sum(axis=1) / long[c], 0, 1)
            gap = np.hypot(*(r - t[:, None] * way[c]).T)
            at = np.cumsum(n[a:b]) - n[a:b]
            least[a:b] = np.minimum.reduceat(gap, at)
            near = gap <= np.repeat(least[a:b], n[a:b]) + 2 * reach + EPS
            kept.append(c[near])
            count.append(np.add.reduceat(near, at, dtype=np.int64))
        cand, n = np.concatenate(kept), np.concatenate(count)
        first = np.cumsum(n) - n
        whole, none = least + reach <= radius, least - reach > radius
        k = whole[square]
        total += float(((t1 - t0)[k] * size[own[k]]).sum())
        last = ~whole & ~none & ((n <= few) | (half < radius / 256))
        k = np.flatnonzero(last[square])
        pairs = n[square[k]]
        for a, b in _dealt(pairs, at_once):
            i, row = k[a:b], np.repeat(np.arange(b - a), pairs[a:b])
            part = np.hstack([p[own[i]] + t[i, None] * d[own[i]] for t in (t0, t1)])
            x, y = _near_interval(part[row], targets[cand[_runs(first[square[i]], pairs[a:b])]], radius)
            real = x < y
            row, x, y = _joined(row[real], x[real], y[real])
            total += float(((y - x) * ((t1 - t0) * size[own])[i[row]]).sum())
        k = ~(whole | none | last)[square]
        own, t0, t1, square = own[k], t0[k], t1[k], square[k]
        # Parts are cut by the lines between the quarters, and each is in that of its middle.
        with np.errstate(divide="ignore", invalid="ignore"):
            cuts = np.sort(np.clip(np.nan_to_num((middle[square] - p[own]) / d[own], nan=-1.0), t0[:, None], t1[:, None]), axis=1)
        ends = np.column_stack((t0, cuts, t1))
        own, square, t0, t1 = np.repeat(own, 3), np.repeat(square, 3), ends[:, :-1].ravel(), ends[:, 1:].ravel()
        real = t1 > t0
        own, square, t0, t1 = own[real], square[real], t0[real], t1[real]
        right, above = ((p[own] + ((t0 + t1) / 2)[:, None] * d[own]) >= middle[square]).T
        square, half = 4 * square + 2 * above + right, half / 2
        middle = np.repeat(middle, 4, axis=0) + half * np.tile([(-1, -1), (1, -1), (-1, 1), (1, 1)], (len(middle), 1))
        first, n = np.repeat(first, 4), np.repeat(n, 4)
    return total


def _boxes(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([p.min(axis=0) for p in lines]).reshape(-1, 2), np.array([p.max(axis=0) for p in lines]).reshape(-1, 2)


def _around(lines: list[np.ndarray], p: np.ndarray, radius: float) -> list[np.ndarray]:
    """The lines whose box comes within ``radius`` of that of points."""
    low, high = _boxes(lines)
    return [lines[i] for i in np.flatnonzero(((low <= p.max(axis=0) + radius) & (high >= p.min(axis=0) - radius)).all(axis=1))]


def complexity(block: list[Polygon], buildings: np.ndarray, streets: list[np.ndarray], radius: float = 100.0) -> dict:
    """Street access and layers of parcels of one block; buildings are their centroids.

    Parcels are the cells of nearest building in the block. The first layer is what the streets inside reach, if they
    are connected to those around, else what is on the border; each next one shares a border with the layer before;
    what none reaches is the last."""
    out = {"on_network_street_length": 0.0, "off_network_street_length": 0.0, "nearest_external_street": None, "building_count": len(buildings), "building_layers": [0], "k_complexity": 1}
    whole = [q for p in block for q in repaired(p)]
    if not whole or not len(buildings):
        return {**out, "building_count": len(buildings) if whole else 0}
    shape = max(whole, key=polygon_area)
    crossed = _around(streets, shape[0], EPS)  # others have no part in the block
    inner = clip_segments(line_segments(crossed), [shape])
    connected = False
    if len(inner):
        rim = segments_of(shape[:1])
        outward = [s for s, near in zip(streets, near_lines(streets, rim, radius)) if near]
        if outward:
            taken = set(map(id, outward))
            rest = [s for s in crossed if id(s) not in taken]
            net = np.vstack((line_segments(outward), clip_segments(line_segments(rest), [shape])))
            total = float(np.hypot(net[:, 2] - net[:, 0], net[:, 3] - net[:, 1]).sum())
            on = reach_within(net, inner, radius / 2)
            out |= {"on_network_street_length": on, "off_network_street_length": max(0.0, total - on), "nearest_external_street": least_distance(buildings, line_segments(outward))}
            connected = on > 0
        else:
            out["off_network_street_length"] = float(np.hypot(inner[:, 2] - inner[:, 0], inner[:, 3] - inner[:, 1]).sum())
    lo, hi = shape[0].min(axis=0) - 1, shape[0].max(axis=0) + 1
    points = np.unique(buildings, axis=0)
    edges = np.vstack((segments_of(shape), voronoi_edges(points, (*lo, *hi))))
    vertices = Vertices()
    faces = Faces(cut(edges, vertices), vertices)
    parcels = {s for s in faces.shells if inside(shape, *interior_point(faces.polygon(s)))[0]}
    if not parcels:
        return {**out, "building_layers": [1]}
    beside: dict[int, set[int]] = {s: set() for s in parcels}
    outer = set()
    for a, b in faces.left:
        here, there = faces.side(a, b), faces.side(b, a)
        if here in parcels and here != there:
            beside[here].add(there) if there in parcels else outer.add(here)
    ring: set[int] = set()
    if connected:
        low, high = np.minimum(inner[:, :2], inner[:, 2:]) - 1.0, np.maximum(inner[:, :2], inner[:, 2:]) + 1.0
        for s in parcels:
            p = faces.polygon(s)
            beside_it = inner[((low <= p[0].max(axis=0)) & (high >= p[0].min(axis=0))).all(axis=1)]
            if len(beside_it) and (_near(beside_it, segments_of(p), 1.0) or inside(p, inner[0, 0], inner[0, 1])[0]):
                ring.add(s)
    ring = ring or outer or set(parcels)
    layers, left = [len(ring)], parcels - ring
    while left:
        ring = {s for s in left if beside[s] & ring}
        if not ring:
            layers.append(len(left))
            break
        layers.append(len(ring))
        left -= ring
    return {**out, "building_layers": layers, "k_complexity": len(layers)}


def near_lines(lines: list[np.ndarray], b: np.ndarray, radius: float, at_once: int = 200_000) -> np.ndarray:
    """For each line, whether it comes within ``radius`` of one of the segments ``b``."""
    owner, e = np.repeat(np.arange(len(lines)), [max(len(p) - 1, 0) for p in lines]), line_segments(lines)
    out, step = np.zeros(len(lines), bool), max(1, at_once // max(1, len(b)))
    corners = np.unique(np.vstack((b[:, :2], b[:, 2:])), axis=0)
    for start in range(0, len(e), step):
        a = e[start : start + step]
        near = crossing(a, b).any(axis=1) | (points_to_segments(a[:, :2], b) <= radius) | (points_to_segments(a[:, 2:], b) <= radius)
        d = (a[:, 2:] - a[:, :2])[:, None]
        rel = corners[None] - a[:, None, :2]
        t = np.clip((rel * d).sum(axis=2) / np.maximum((d * d).sum(axis=2), 1e-300), 0, 1)
        near |= (np.hypot(*np.moveaxis(rel - t[..., None] * d, 2, 0)) <= radius).any(axis=1)
        out[owner[start : start + step][near]] = True
    return out


def _near(a: np.ndarray, b: np.ndarray, radius: float) -> bool:
    """Whether any segment of ``a`` comes within ``radius`` of one of ``b``."""
    if crossing(a, b).any():
        return True
    ends = lambda e: np.vstack((e[:, :2], e[:, 2:]))
    return min(points_to_segments(ends(a), b).min(), points_to_segments(ends(b), a).min()) <= radius
