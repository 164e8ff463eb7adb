"""Planar arrangements: linework cut where it meets, its faces, and what follows from them - polygons from lines,
boolean operations, clipping. Vertices nearer than ``EPS`` are one."""

from __future__ import annotations

from collections import defaultdict
from itertools import product

import numpy as np

from .shapes import Polygon, inside, interior_point, line_segments, points_to_segments, polygon_area, ring_area, segments_of

EPS = 1e-6


class Vertices:
    """Numbers for points, the same for points nearer than EPS."""

    def __init__(self):
        self.xy: list[tuple[float, float]] = []
        self.cells: dict[tuple[int, int], list[int]] = defaultdict(list)

    def number(self, x: float, y: float) -> int:
        cx, cy = int(np.floor(x / (2 * EPS))), int(np.floor(y / (2 * EPS)))
        for dx, dy in product((-1, 0, 1), repeat=2):
            for i in self.cells.get((cx + dx, cy + dy), ()):
                a, b = self.xy[i]
                if abs(a - x) <= EPS and abs(b - y) <= EPS:
                    return i
        self.xy.append((float(x), float(y)))
        self.cells[cx, cy].append(len(self.xy) - 1)
        return len(self.xy) - 1


def near_pairs(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of segments whose boxes meet, found in a grid."""
    n = len(e)
    lo, hi = np.minimum(e[:, :2], e[:, 2:]) - EPS, np.maximum(e[:, :2], e[:, 2:]) + EPS
    if n < 200:
        i, j = np.triu_indices(n, 1)
    else:
        size = max(float(np.median(hi - lo)) * 2, float((hi.max(axis=0) - lo.min(axis=0)).max()) / 2_000, EPS)
        cells = defaultdict(list)
        a, b = np.floor(lo / size).astype(int), np.floor(hi / size).astype(int)
        for k in range(n):
            for c in product(range(a[k, 0], b[k, 0] + 1), range(a[k, 1], b[k, 1] + 1)):
                cells[c].append(k)
        found = [np.array(v) for v in cells.values() if len(v) > 1]
        if not found:
            return np.empty(0, int), np.empty(0, int)
        codes = []
        for v in found:
            p, q = np.triu_indices(len(v), 1)
            codes.append(np.minimum(v[p], v[q]) * n + np.maximum(v[p], v[q]))
        codes = np.unique(np.concatenate(codes))
        i, j = codes // n, codes % n
    meet = ((lo[i] <= hi[j]) & (lo[j] <= hi[i])).all(axis=1)
    return i[meet], j[meet]


def cut(e: np.ndarray, vertices: Vertices) -> set[tuple[int, int]]:
    """Undirected edges between numbered vertices: segments split at crossings, at touching ends and at overlaps."""
    ends = [(vertices.number(*s[:2]), vertices.number(*s[2:])) for s in e]
    on: list[set[int]] = [set(p) for p in ends]
    if len(e) > 1:
        i, j = near_pairs(e)
        p, r = e[i, :2], e[i, 2:] - e[i, :2]
        q, s = e[j, :2], e[j, 2:] - e[j, :2]
        cross = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        scale = np.hypot(*r.T) * np.hypot(*s.T)
        skew = np.abs(cross) > 1e-12 * np.maximum(scale, 1e-300)
        d = q - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / cross
            u = (d[:, 0] * r[:, 1] - d[:, 1] * r[:, 0]) / cross
        te, ue = EPS / np.maximum(np.hypot(*r.T), EPS), EPS / np.maximum(np.hypot(*s.T), EPS)
        meet = skew & (t >= -te) & (t <= 1 + te) & (u >= -ue) & (u <= 1 + ue)
        for k in np.flatnonzero(meet):
            x, y = p[k] + np.clip(t[k], 0, 1) * r[k]
            v = vertices.number(x, y)
            on[i[k]].add(v)
            on[j[k]].add(v)
        # Ends on the other segment: touching, and parallel ones that overlap.
        for a, b in ((i, j), (j, i)):
            for end in (e[b, :2], e[b, 2:]):
                base, along = e[a, :2], e[a, 2:] - e[a, :2]
                size = np.maximum((along**2).sum(axis=1), 1e-300)
                w = ((end - base) * along).sum(axis=1) / size
                gap = np.hypot(*(end - base - np.clip(w, 0, 1)[:, None] * along).T)
                for k in np.flatnonzero(gap <= EPS):
                    on[a[k]].add(vertices.number(*end[k]))
    out: set[tuple[int, int]] = set()
    for s, ids in zip(e, on):
        d = s[2:] - s[:2]
        order = sorted(ids, key=lambda v: (vertices.xy[v][0] - s[0]) * d[0] + (vertices.xy[v][1] - s[1]) * d[1])
        for a, b in zip(order, order[1:]):
            if a != b:
                out.add((min(a, b), max(a, b)))
    return out


class Faces:
    """The faces of cut linework. ``left`` tells the cycle on the left of each directed edge; a cycle that runs
    counter-clockwise bounds a face, one that runs clockwise a hole in the face around it, or the outside."""

    def __init__(self, edges: set[tuple[int, int]], vertices: Vertices):
        xy = np.array(vertices.xy) if vertices.xy else np.empty((0, 2))
        around: dict[int, list[int]] = defaultdict(list)
        for a, b in edges:
            around[a].append(b)
            around[b].append(a)
        # Ends that lead nowhere bound nothing.
        loose = [v for v, n in around.items() if len(n) == 1]
        while loose:
            v = loose.pop()
            if len(around[v]) == 1:
                (w,) = around.pop(v)
                around[w].remove(v)
                if len(around[w]) == 1:
                    loose.append(w)
        place: dict[tuple[int, int], int] = {}
        for v, n in around.items():
            n.sort(key=lambda w: np.arctan2(xy[w, 1] - xy[v, 1], xy[w, 0] - xy[v, 0]))
            for k, w in enumerate(n):
                place[v, w] = k
        self.xy, self.left, self.cycles = xy, {}, []
        for start in place:
            if start in self.left:
                continue
            cycle, edge = [], start
            while edge not in self.left:
                self.left[edge] = len(self.cycles)
                cycle.append(edge[0])
                a, b = edge
                n = around[b]
                edge = b, n[place[b, a] - 1]  # the next one clockwise from the way back
            self.cycles.append(cycle)
        self.areas = [ring_area(xy[c]) for c in self.cycles]
        self.shells = [i for i, a in enumerate(self.areas) if a > EPS * EPS]
        self.face = {s: s for s in self.shells}
        self.holes: dict[int, list[int]] = defaultdict(list)
        if self.shells:
            size = sorted(self.shells, key=lambda s: self.areas[s])
            box = {s: (xy[self.cycles[s]].min(axis=0), xy[self.cycles[s]].max(axis=0)) for s in size}
            for h, a in enumerate(self.areas):
                if a <= EPS * EPS:
                    own = set(self.cycles[h])
                    p = xy[self.cycles[h][0]]
                    for s in size:
                        lo, hi = box[s]
                        if (p >= lo - EPS).all() and (p <= hi + EPS).all() and not own & set(self.cycles[s]) and inside([xy[self.cycles[s]]], p[0], p[1])[0]:
                            self.holes[s].append(h)
                            self.face[h] = s
                            break

    def side(self, a: int, b: int) -> int | None:
        """The face on the left of an edge, None for the outside."""
        return self.face.get(self.left.get((a, b), -1))

    def polygon(self, shell: int) -> Polygon:
        """A face; holes that are lines without width are left out."""
        rings = [self.xy[self.cycles[shell]]]
        return rings + [self.xy[self.cycles[h]] for h in self.holes[shell] if abs(self.areas[h]) > EPS * EPS]

    def polygons(self) -> list[Polygon]:
        return [self.polygon(s) for s in self.shells]

    def dissolved(self, kept: set[int]) -> list[Polygon]:
        """Polygons of the union of some faces."""
        border: dict[int, list[int]] = defaultdict(list)
        for (a, b) in self.left:
            if self.side(a, b) in kept and self.side(b, a) not in kept:
                border[a].append(b)
        rings = []
        while border:
            first = next(iter(border))
            a, ring = first, [first]
            before = None
            while True:
                choice = border[a]
                if before is None or len(choice) == 1:
                    b = choice[0]
                else:  # keep to the left, so that rings that touch in a vertex come apart
                    back = np.arctan2(*(self.xy[before] - self.xy[a])[::-1])
                    b = min(choice, key=lambda w: (back - np.arctan2(*(self.xy[w] - self.xy[a])[::-1])) % (2 * np.pi) or 7)
                choice.remove(b)
                if not choice:
                    del border[a]
                before, a = a, b
                if a == first:
                    break
                ring.append(a)
            rings.append(self.xy[ring])
        outer = [r for r in rings if ring_area(r) > 0]
        out: list[Polygon] = [[straight(r)] for r in sorted(outer, key=ring_area)]
        sizes = [ring_area(q[0]) for q in out]
        for h in rings:
            if ring_area(h) < 0:
                p = interior_point([h])
                for q, size in zip(out, sizes):  # a ring within the hole may be around the point, but is smaller
                    if size > -ring_area(h) and inside(q[:1], p[0], p[1])[0]:
                        q.append(straight(h))
                        break
        return out


def straight(r: np.ndarray) -> np.ndarray:
    """A ring without vertices in the middle of straight stretches."""
    a, b = np.roll(r, 1, axis=0), np.roll(r, -1, axis=0)
    bend = np.abs((r[:, 0] - a[:, 0]) * (b[:, 1] - r[:, 1]) - (r[:, 1] - a[:, 1]) * (b[:, 0] - r[:, 0]))
    keep = bend > 1e-9 * np.maximum(1, np.hypot(*(b - a).T))
    return r[keep] if keep.sum() > 2 else r


def polygonize(lines: list[np.ndarray]) -> list[Polygon]:
    """All faces that linework bounds, cut where it meets; loose ends are dropped."""
    vertices = Vertices()
    return Faces(cut(line_segments(lines), vertices), vertices).polygons()


def within(polygons: list[Polygon], p: np.ndarray) -> bool:
    return any(inside(q, p[0], p[1])[0] for q in polygons)


def covered(polygons: list[Polygon], at: np.ndarray) -> np.ndarray:
    """Whether each point is in any of the polygons."""
    out = np.zeros(len(at), bool)
    for p in polygons:
        lo, hi = p[0].min(axis=0), p[0].max(axis=0)
        here = np.flatnonzero(~out & ((at >= lo) & (at <= hi)).all(axis=1))
        if len(here):
            out[here] = inside(p, at[here, 0], at[here, 1])
    return out


def overlay(a: list[Polygon], b: list[Polygon], keep) -> list[Polygon]:
    """Polygons of the places for which ``keep(in a, in b)`` holds."""
    edges = [segments_of(p) for p in (*a, *b)]
    if not edges:
        return []
    vertices = Vertices()
    faces = Faces(cut(np.vstack(edges), vertices), vertices)
    if not faces.shells:
        return []
    at = np.array([interior_point(faces.polygon(s)) for s in faces.shells])
    kept = {s for s, x, y in zip(faces.shells, covered(a, at), covered(b, at)) if keep(bool(x), bool(y))}
    return [p for p in faces.dissolved(kept) if polygon_area(p) > EPS]


def intersection(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    return overlay(a, b, lambda x, y: x and y)


def difference(a: list[Polygon], b: list[Polygon]) -> list[Polygon]:
    return overlay(a, b, lambda x, y: x and not y)


def union(a: list[Polygon], b: list[Polygon] = []) -> list[Polygon]:
    """Many polygons are united by halves of their places, so that what lies inside is gone before all meet."""
    found = [*a, *b]
    if len(found) <= 8:
        return overlay(found, [], lambda x, y: x)
    middle = np.array([(p[0].min(axis=0) + p[0].max(axis=0)) / 2 for p in found])
    order = np.argsort(middle[:, int(np.ptp(middle, axis=0).argmax())], kind="stable")
    halves = [union([found[i] for i in part]) for part in np.array_split(order, 2)]
    return overlay(*halves, lambda x, y: x or y)


def repaired(p: Polygon) -> list[Polygon]:
    """A polygon whose rings may cross, as valid ones: what an odd number of its rings is around."""
    vertices = Vertices()
    faces = Faces(cut(segments_of(p), vertices), vertices)
    return faces.dissolved({s for s in faces.shells if inside(p, *interior_point(faces.polygon(s)))[0]})


def clip_lines(lines: list[np.ndarray], polygons: list[Polygon], outside: bool = False) -> list[np.ndarray]:
    """The parts of lines in polygons, those along a border among them, or, if ``outside``, all other parts; parts that
    follow each other are joined."""
    out: list[np.ndarray] = []
    if not polygons:
        return list(lines) if outside else out
    border = np.vstack([segments_of(p) for p in polygons])
    lo, hi = np.minimum(border[:, :2], border[:, 2:]) - EPS, np.maximum(border[:, :2], border[:, 2:]) + EPS
    for line in lines:
        run: list[np.ndarray] = []
        for p, q in zip(line[:-1], line[1:]):
            d = q - p
            size = np.hypot(*d)
            if size <= EPS:
                continue
            near = border[((lo <= np.maximum(p, q)) & (hi >= np.minimum(p, q))).all(axis=1)]
            ts = [0.0, 1.0]
            if len(near):
                r, s = near[:, :2] - p, near[:, 2:] - near[:, :2]
                cross = d[0] * s[:, 1] - d[1] * s[:, 0]
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = (r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]) / cross
                    u = (r[:, 0] * d[1] - r[:, 1] * d[0]) / cross
                tol = EPS / np.maximum(np.hypot(*s.T), EPS)
                ts += t[(np.abs(cross) > 1e-12 * size * np.hypot(*s.T)) & (u >= -tol) & (u <= 1 + tol)].tolist()
                for end in (near[:, :2], near[:, 2:]):  # ends of borders that lie along the segment
                    w = ((end - p) @ d) / size**2
                    on = np.hypot(*(end - p - w[:, None] * d).T) <= EPS
                    ts += w[on].tolist()
            ts = np.unique(np.clip(ts, 0, 1))
            for a, b in zip(ts[:-1], ts[1:]):
                if (b - a) * size <= EPS:
                    continue
                m = p + (a + b) / 2 * d
                held = within(polygons, m)
                if not held and len(near):
                    s = near[:, 2:] - near[:, :2]
                    w = np.clip(((m - near[:, :2]) * s).sum(axis=1) / np.maximum((s * s).sum(axis=1), 1e-300), 0, 1)
                    held = bool((np.hypot(*(m - near[:, :2] - w[:, None] * s).T) <= EPS).any())
                held = held != outside
                x, y = p + a * d, p + b * d
                if held and run and np.hypot(*(run[-1] - x)) <= EPS:
                    run.append(y)
                elif held:
                    if len(run) > 1:
                        out.append(np.array(run))
                    run = [x, y]
                elif run:
                    out.append(np.array(run))
                    run = []
        if len(run) > 1:
            out.append(np.array(run))
    return out


def clip_segments(e: np.ndarray, polygons: list[Polygon], at_once: int = 200_000) -> np.ndarray:
    """The parts of segments in polygons as ``clip_lines`` finds them, each a segment, many at a time."""
    e = e[np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]) > EPS]
    if not polygons or not len(e):
        return np.empty((0, 4))
    border = np.vstack([segments_of(p) for p in polygons])
    lo, hi = np.minimum(border[:, :2], border[:, 2:]) - EPS, np.maximum(border[:, :2], border[:, 2:]) + EPS
    out, step = [], max(1, at_once // len(border))
    for start in range(0, len(e), step):
        p, d = e[start : start + step, :2], e[start : start + step, 2:] - e[start : start + step, :2]
        size = np.hypot(*d.T)
        i, j = np.nonzero(((lo <= np.maximum(p, p + d)[:, None]) & (hi >= np.minimum(p, p + d)[:, None])).all(axis=2))
        r, s = border[j, :2] - p[i], border[j, 2:] - border[j, :2]
        cross, long = d[i, 0] * s[:, 1] - d[i, 1] * s[:, 0], np.hypot(*s.T)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]) / cross
            u = (r[:, 0] * d[i, 1] - r[:, 1] * d[i, 0]) / cross
        tol = EPS / np.maximum(long, EPS)
        met = (np.abs(cross) > 1e-12 * size[i] * long) & (u >= -tol) & (u <= 1 + tol)
        row, ts = [np.arange(len(p)), np.arange(len(p)), i[met]], [np.zeros(len(p)), np.ones(len(p)), t[met]]
        for end in (border[j, :2], border[j, 2:]):  # ends of borders that lie along the segment
            w = ((end - p[i]) * d[i]).sum(axis=1) / size[i] ** 2
            on = np.hypot(*(end - p[i] - w[:, None] * d[i]).T) <= EPS
            row.append(i[on])
            ts.append(w[on])
        k, t = np.concatenate(row), np.clip(np.concatenate(ts), 0, 1)
        order = np.lexsort((t, k))
        k, t = k[order], t[order]
        real = (k[1:] == k[:-1]) & ((t[1:] - t[:-1]) * size[k[1:]] > EPS)
        k, a, b = k[1:][real], t[:-1][real], t[1:][real]
        held = np.empty(len(k), bool)
        for at in range(0, len(k), step):
            m = p[k[at : at + step]] + ((a + b) / 2)[at : at + step, None] * d[k[at : at + step]]
            held[at : at + step] = covered(polygons, m) | (points_to_segments(m, border) <= EPS)
        k, a, b = k[held], a[held, None], b[held, None]
        out.append(np.hstack((p[k] + a * d[k], p[k] + b * d[k])))
    return np.vstack(out)


def buffer(polygons: list[Polygon], d: float, quarter: int = 16) -> list[Polygon]:
    """The places within ``d`` of polygons, or, below 0, those in them that are further than that from the outline.
    Round corners have a chord for each part of ``quarter`` of a right angle, with ends on the circle."""
    if not polygons or d == 0:
        return polygons
    r, bands = abs(d), []
    for p in polygons:
        for k, ring in enumerate(p):
            at = straight(ring if (ring_area(ring) > 0) == (k == 0) else ring[::-1])  # the inside to the left
            way = np.roll(at, -1, axis=0) - at
            way = way / np.hypot(*way.T)[:, None]
            off = (r if d > 0 else -r) * np.column_stack((way[:, 1], -way[:, 0]))
            ends = np.roll(at, -1, axis=0)
            bands += [[np.array((a, b, b + n, a + n))] for a, b, n in zip(at, ends, off)]
            before = np.roll(way, 1, axis=0)
            turn = np.arctan2(before[:, 0] * way[:, 1] - before[:, 1] * way[:, 0], (before * way).sum(axis=1))
            for i in np.flatnonzero(turn * d > 1e-9):  # between the bands of two sides, a part of a disc
                first = np.arctan2(off[i - 1, 1], off[i - 1, 0])
                angles = first + np.linspace(0, turn[i], max(2, int(np.ceil(abs(turn[i]) / (np.pi / 2 / quarter) - 1e-9)) + 1))
                bands.append([np.vstack((at[i], at[i] + r * np.column_stack((np.cos(angles), np.sin(angles)))))])
    ribbon = union(bands)
    return union(polygons, ribbon) if d > 0 else difference(polygons, ribbon)


def inner_buffer_of_area(polygons: list[Polygon], target: float, tolerance: float = 1e-6, tries: int = 100) -> list[Polygon]:
    """Polygons shrunk to an area, by widths that change by a tenth from a tenth of the area's root on: the first within
    ``tolerance``, else the last try. Unchanged where they are no larger, or where a try leaves nothing."""
    whole = sum(map(polygon_area, polygons))
    if whole <= target:
        return polygons
    width, found = 0.1 * whole**0.5, polygons
    for _ in range(tries):
        found = buffer(polygons, -width)
        if not found:
            return polygons
        excess = sum(map(polygon_area, found)) - target
        if abs(excess) < tolerance:
            break
        width *= 1.1 if excess > 0 else 0.9
    return found


def fill_blocks(lines: list[np.ndarray], fill: list[Polygon], least: float = 1.0) -> tuple[list[Polygon], str]:
    """The faces that linework cuts a fill area into, none below ``least``; the area itself if there are none."""
    rings = [np.vstack((r, r[:1])) for p in fill for r in p]
    kept = []
    for face in polygonize(clip_lines(lines, fill) + rings):
        if polygon_area(face) >= least and within(fill, interior_point(face)):
            kept.append(face)
    return (kept, "polygonized") if kept else (fill, "fallback_fill_polygon")
