"""Faces of dense linework, a square at a time, on arrays: faces that a square holds whole are settled there, and only
edges beside the others go on to the larger square around it. Where small faces are not wanted, lines are added in rounds:
what lies in a small face of some of the lines lies in small faces of all, and need not be cut there."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from .planar import EPS
from .shapes import Polygon


def grouped_min(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The least value of each row's group."""
    order = np.argsort(group, kind="stable")
    g, v = group[order], value[order]
    start = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
    out = np.empty_like(value)
    out[order] = np.repeat(np.minimum.reduceat(v, start), np.diff(np.append(start, len(g))))
    return out


def snapped(p: np.ndarray) -> np.ndarray:
    """For each point the first of those that it is one with: nearer than 2 EPS, or linked by such points."""
    cells = []
    for dx in (0.0, 0.5):
        for dy in (0.0, 0.5):
            x = np.unique(np.floor(p[:, 0] / (4 * EPS) + dx), return_inverse=True)[1]
            y = np.unique(np.floor(p[:, 1] / (4 * EPS) + dy), return_inverse=True)[1]
            cells.append(x.astype(np.int64) * (int(y.max()) + 1) + y)
    label, before = np.arange(len(p)), None
    while before is None or (label != before).any():
        before = label
        for c in cells:
            label = grouped_min(c, label)
    return label


def linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers the least of those that pairs link it to."""
    label = np.arange(n)
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label != label[label]).any():
            label = label[label]
    return label


def pairs_in_cells(e: np.ndarray, at_once: int = 500_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of segments that meet a common cell of a grid and whose boxes meet, some of them in several cells, in parts."""
    lo, hi = np.minimum(e[:, :2], e[:, 2:]) - EPS, np.maximum(e[:, :2], e[:, 2:]) + EPS
    reach = float((hi.max(axis=0) - lo.min(axis=0)).max())
    size = max(float(np.abs(e[:, 2:] - e[:, :2]).sum()) / (4 * len(e)), reach / 1e6, 8 * EPS)
    seg, x, y, _ = pieces_in_squares(e, size)
    order = np.lexsort((seg, y, x))
    seg, x, y = seg[order], x[order], y[order]
    first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
    before = np.arange(len(seg)) - np.flatnonzero(first)[np.cumsum(first) - 1]  # those of the cell before each
    made = np.cumsum(before)
    start = 0
    while start < len(seg):
        end = max(start + 1, int(np.searchsorted(made, (made[start - 1] if start else 0) + at_once, "right")))
        n = before[start:end]
        j = np.repeat(np.arange(start, end), n)
        i = np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n) + j - before[j]
        i, j, start = seg[i], seg[j], end
        meet = (i != j) & ((lo[i] <= hi[j]) & (lo[j] <= hi[i])).all(axis=1)
        yield i[meet], j[meet]


def points_on(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segment numbers and points: the ends of each segment, and where others cross it, touch it or end on it."""
    n = len(e)
    seg, at = [np.arange(n), np.arange(n)], [e[:, :2], e[:, 2:]]
    for i, j in pairs_in_cells(e):
        p, r = e[i, :2], e[i, 2:] - e[i, :2]
        q, s = e[j, :2], e[j, 2:] - e[j, :2]
        cross = r[:, 0] * s[:, 1] - r[:, 1] * s[:, 0]
        a, b = np.hypot(*r.T), np.hypot(*s.T)
        d = q - p
        with np.errstate(divide="ignore", invalid="ignore"):
            t = (d[:, 0] * s[:, 1] - d[:, 1] * s[:, 0]) / cross
            u = (d[:, 0] * r[:, 1] - d[:, 1] * r[:, 0]) / cross
        te, ue = EPS / np.maximum(a, EPS), EPS / np.maximum(b, EPS)
        k = np.flatnonzero((np.abs(cross) > 1e-12 * np.maximum(a * b, 1e-300)) & (t >= -te) & (t <= 1 + te) & (u >= -ue) & (u <= 1 + ue))
        x = p[k] + np.clip(t[k], 0, 1)[:, None] * r[k]
        seg += [i[k], j[k]]
        at += [x, x]
        for own, other in ((i, j), (j, i)):
            base, along = e[own, :2], e[own, 2:] - e[own, :2]
            size = np.maximum((along**2).sum(axis=1), 1e-300)
            for end in (e[other, :2], e[other, 2:]):
                w = np.clip(((end - base) * along).sum(axis=1) / size, 0, 1)
                k = np.flatnonzero(np.hypot(*(end - base - w[:, None] * along).T) <= EPS)
                seg.append(own[k])
                at.append(end[k])
    return np.concatenate(seg), np.vstack(at)


@dataclass
class Settled:
    """What a square leaves: its new whole faces, the edges that go on with what is settled to their left and right, and
    without a square the rings around all faces."""

    faces: list[Polygon]
    edges: np.ndarray
    left: np.ndarray
    right: np.ndarray
    outlines: list[Polygon]
    loose: np.ndarray = field(default_factory=lambda: np.empty((0, 4)))


class Leak(ValueError):
    """What is settled reaches what is not: rounding has opened an edge between them."""


NOTHING = Settled([], np.empty((0, 4)), np.empty(0, bool), np.empty(0, bool), [])


def settle(e: np.ndarray, left: np.ndarray, right: np.ndarray, box: tuple[float, float, float, float] | None, least: float = 0.0, unit: float | None = None, more: bool = False, parts: bool = False) -> Settled:
    """The faces of segments that lie in ``box`` (x0, y0, x1, y1), or anywhere without one, of an area of ``least`` or
    more; smaller ones are settled too. ``left`` and ``right`` tell on which side of a segment all is settled. Vertices
    where lines of a grid of ``unit`` cut straight edges are left out. With ``more`` lines to come no faces are made, those of
    ``least`` or more stay open, and loose ends are told. ``parts``: there are parts of lines in what is settled, to leave out."""
    if not len(e):
        return NOTHING
    real = np.ones(len(e), bool)
    if box is not None:
        x0, y0, x1, y1 = box
        e = np.vstack((e, [(x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)]))
        real, left, right = (np.append(v, [False] * 4) for v in (real, left, right))
    origin = (e[:, :2].min(axis=0) + e[:, :2].max(axis=0)) / 2
    seg, at = points_on(e)
    vertex = snapped(at - origin)
    # Segments in pieces between the vertices on them.
    along = ((at - e[seg, :2]) * (e[seg, 2:] - e[seg, :2])).sum(axis=1)
    order = np.lexsort((vertex, along, seg))
    s, v = seg[order], vertex[order]
    step = (s[1:] == s[:-1]) & (v[1:] != v[:-1])
    a, b, s = v[:-1][step], v[1:][step], s[1:][step]
    turn = a > b
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    flags = np.column_stack((real[s], np.where(turn, right[s], left[s]), np.where(turn, left[s], right[s])))
    order = np.lexsort((hi, lo))
    lo, hi, flags = lo[order], hi[order], flags[order]
    if not len(lo):
        return NOTHING
    start = np.flatnonzero(np.append(True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])))
    lo, hi, flags = lo[start], hi[start], np.logical_or.reduceat(flags, start, axis=0)
    # Ends that lead nowhere bound nothing.
    loose = []
    while True:
        degree = np.bincount(np.concatenate((lo, hi)), minlength=len(at))
        firm = (degree[lo] > 1) & (degree[hi] > 1)
        if firm.all():
            break
        if parts and flags[~firm, 1:].any():
            raise Leak
        loose.append(np.column_stack((at[lo[~firm]], at[hi[~firm]])))
        lo, hi, flags = lo[firm], hi[firm], flags[firm]
    loose = np.vstack(loose) if more and loose else NOTHING.loose
    m = len(lo)
    if not m:
        return NOTHING if not len(loose) else Settled([], NOTHING.edges, NOTHING.left, NOTHING.right, [], loose)
    # Half-edges 2k and 2k + 1 run both ways along edge k; the next one is clockwise from the way back.
    tail, head = np.column_stack((lo, hi)).ravel(), np.column_stack((hi, lo)).ravel()
    way = at[head] - at[tail]
    order = np.lexsort((np.arctan2(way[:, 1], way[:, 0]), tail))
    place = np.empty(2 * m, np.int64)
    place[order] = np.arange(2 * m)
    first = np.searchsorted(tail[order], np.arange(len(at)))
    back = place[np.arange(2 * m) ^ 1] - first[head]
    follow = order[first[head] + (back - 1) % degree[head]]
    cycle, jump, reach = np.arange(2 * m), follow, 1
    while reach < 2 * m:
        cycle, jump, reach = np.minimum(cycle, cycle[jump]), jump[jump], 2 * reach
        if (cycle == cycle[follow]).all():
            break
    names, cycle = np.unique(cycle, return_inverse=True)
    xy = at - origin
    area = np.bincount(cycle, xy[tail, 0] * xy[head, 1] - xy[head, 0] * xy[tail, 1]) / 2
    shell = area > EPS * EPS
    face = np.where(shell, np.arange(len(names)), -1)
    # A cycle that is no shell is a hole of what is left of its leftmost vertex, or outside of all.
    by_x = np.lexsort((xy[tail, 0], cycle))
    leftmost = by_x[np.searchsorted(cycle[by_x], np.arange(len(names)))]
    holes = np.flatnonzero(~shell)
    y0, y1 = xy[tail, 1], xy[head, 1]
    for h in holes[np.argsort(xy[tail[leftmost[holes]], 0], kind="stable")]:
        x, y = xy[tail[leftmost[h]]]
        near = np.flatnonzero((y0 > y) & (y1 <= y))  # those that run down have the left side to the right of them
        cut = xy[tail[near], 0] + (y - y0[near]) * (xy[head[near], 0] - xy[tail[near], 0]) / (y1[near] - y0[near])
        near, cut = near[cut < x], cut[cut < x]
        near, cut = near[cycle[near] != h], cut[cycle[near] != h]
        if len(near):
            face[h] = face[cycle[near[np.argmax(cut)]]]
    of = face[cycle]
    known = of >= 0
    done, open_ = np.zeros(len(names) + 1, bool), np.zeros(len(names) + 1, bool)
    settled = flags[:, 1:].ravel()
    # Rounding may turn or close slivers, so that a short edge tells wrong: what most of the length around a face tells holds.
    told, size = np.ravel(flags[:, 2:0:-1]), np.hypot(*way.T)
    group = np.arange(len(names))
    if parts:  # Only edges that tell so lie between what is settled and what is not; nothing at the border is settled.
        free = flags[:, 0] & ~flags[:, 1:].any(axis=1) & known[::2] & known[1::2]
        group = linked(len(names), of[::2][free], of[1::2][free])
    against = ~settled & (told | np.repeat(~flags[:, 0], 2)) if parts else ~settled
    yes, no = (np.bincount(group[of[known & v]], size[known & v], len(names)) for v in (settled, against))
    if parts:
        no[group[of[known & np.repeat(~flags[:, 0], 2)]]] += np.inf
        if (np.minimum(yes, no) > np.maximum(1e3 * EPS, np.maximum(yes, no) / 10)).any():
            raise Leak
    done[:-1] = (yes > no)[group]
    open_[of[known & ~np.repeat(flags[:, 0], 2)]] = True
    if more:
        open_[:-1] |= shell & (np.bincount(face[face >= 0], area[face >= 0], len(names)) >= least)
    open_ &= ~done
    new = np.zeros(len(names), bool) if more else shell & ~done[:-1] & ~open_[:-1] & (face == np.arange(len(names))) & (area >= least)
    inner: dict[int, list[int]] = {}
    for h in holes[face[holes] >= 0]:
        if new[face[h]] and abs(area[h]) > EPS * EPS:
            inner.setdefault(int(face[h]), []).append(int(h))

    def ring(c: int) -> np.ndarray:
        out, k = [], int(names[c])
        while not out or k != names[c]:
            out.append(k)
            k = int(follow[k])
        v = tail[out]
        p = at[v]
        if unit is not None and len(p) > 3:
            p0, p1 = p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p
            flat = np.abs(p0[:, 0] * p1[:, 1] - p0[:, 1] * p1[:, 0]) <= EPS * np.hypot(*(p0 + p1).T)
            on = (np.abs(p / unit - np.round(p / unit)) * unit <= EPS).any(axis=1)
            keep = ~(flat & on & (degree[v] == 2))
            p = p[keep] if keep.sum() > 2 else p
        return p

    faces = [q for c in np.flatnonzero(new) if (size := area[c] + sum(area[h] for h in inner.get(int(c), []))) >= least and size > EPS * EPS for q in [[ring(c), *map(ring, inner.get(int(c), []))]]]
    if box is None:
        return Settled(faces, np.empty((0, 4)), np.empty(0, bool), np.empty(0, bool), [[ring(h)[::-1]] for h in holes if face[h] < 0 and area[h] < -EPS * EPS])
    held = np.where(of >= 0, ~open_[of], False)  # each half-edge's left side is settled now
    l, r = held[::2], held[1::2]
    on = flags[:, 0] & ~(l & r)
    return Settled(faces, np.column_stack((at[lo[on]], at[hi[on]])), l[on], r[on], [], loose)


def settle_large(e: np.ndarray, box: tuple[float, float, float, float], least: float, unit: float | None = None, first: int = 1_000, seed: int = 0) -> Settled:
    """As ``settle`` of lines of which nothing is settled, by rounds: each adds some of the lines, from all over, and
    settles the faces below ``least`` that are away from the border. Of the other lines only the parts near what is
    open are left then. Of what a dense square holds most is never cut."""
    rest = e[np.random.default_rng(seed).permutation(len(e))]
    edges, left, right, many = NOTHING.edges, NOTHING.left, NOTHING.right, first
    try:
        while len(rest) > many:
            own, rest = rest[:many], rest[many:]
            none = np.zeros(len(own), bool)
            f = settle(np.vstack((edges, own)), np.append(left, none), np.append(right, none), box, least, unit, True, True)
            edges, left, right = f.edges, f.left, f.right
            loose, rest = parts_near_open(f.loose, edges, left, right, box), parts_near_open(rest, edges, left, right, box)
            rest, many = np.vstack((loose, rest)), 3 * many + len(loose)
        none = np.zeros(len(rest), bool)
        return settle(np.vstack((edges, rest)), np.append(left, none), np.append(right, none), box, least, unit, False, True)
    except Leak:
        none = np.zeros(len(e), bool)
        return settle_large(e, box, least, unit, first, seed + 1) if seed < 3 else settle(e, none, none, box, least, unit)


def parts_near_open(e: np.ndarray, edges: np.ndarray, left: np.ndarray, right: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """The parts of segments in those cells of a fine grid that meet what is open. ``edges`` are all that are beside it,
    with what is settled to their left and right; all along the border of ``box`` is open."""
    if not len(e):
        return e
    x0, y0, x1, y1 = box
    n = int(np.clip(400_000 * (x1 - x0) / max(float(np.abs(e[:, 2:] - e[:, :2]).sum()), 1e-9), 16, 2_048))
    size = (x1 - x0) / n
    shift = np.array([x0, y0, x0, y0])
    at = lambda v: np.clip(v, 0, n - 1)
    live = np.zeros((n, n), bool)
    if len(edges):
        _, x, y, _ = pieces_in_squares(edges - shift, size)
        live[at(y), at(x)] = True
    # Cells without an edge are open or settled as their centres are: what lies between is passed along rows of centres.
    rim = (edges - shift)[left != right] / size - 0.5
    up = rim[:, 3] > rim[:, 1]
    low, high = np.minimum(rim[:, 1], rim[:, 3]), np.maximum(rim[:, 1], rim[:, 3])
    a, b = np.ceil(low).astype(np.int64), np.ceil(high).astype(np.int64)  # rows from low on and below high
    k = np.repeat(np.arange(len(rim)), b - a)
    row = np.arange(len(k)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[k]
    with np.errstate(divide="ignore", invalid="ignore"):
        x = rim[k, 0] + (row - rim[k, 1]) / (rim[k, 3] - rim[k, 1]) * (rim[k, 2] - rim[k, 0])
    column, inside = np.ceil(x).astype(np.int64), (row >= 0) & (row < n)
    opens = np.where(up[k] == left[left != right][k], 1, -1)  # an edge that runs up has its right side further on
    change = np.bincount((row * (n + 1) + np.clip(column, 0, n))[inside], opens[inside], n * (n + 1)).reshape(n, n + 1)
    live |= 1 + np.cumsum(change[:, :n], axis=1) > 0.5
    seg, x, y, p = pieces_in_squares(e - shift, size)
    keep = live[at(y), at(x)]
    seg, p = seg[keep], p[keep] + shift
    d = e[:, 2:] - e[:, :2]
    long = np.maximum((d * d).sum(axis=1), 1e-300)
    t0, t1 = ((((q - e[seg, :2]) * d[seg]).sum(axis=1)) / long[seg] for q in (p[:, :2], p[:, 2:]))
    t0, t1 = np.clip(np.minimum(t0, t1), 0, 1), np.clip(np.maximum(t0, t1), 0, 1)
    order = np.lexsort((t0, seg))
    seg, t0, t1 = seg[order], t0[order], t1[order]
    slack = 1e-9
    reached = np.maximum.accumulate(np.concatenate(([-1.0], t1 + 2.0 * seg)))[:-1]
    start = np.flatnonzero(t0 + 2.0 * seg > reached + slack)
    if not len(start):
        return e[:0]
    seg, t0, t1 = seg[start], t0[start], np.maximum.reduceat(t1, start)
    ends = [np.where((t <= slack)[:, None], e[seg, :2], np.where((t >= 1 - slack)[:, None], e[seg, 2:], e[seg, :2] + t[:, None] * d[seg])) for t in (t0, t1)]
    out = np.hstack(ends)
    return out[np.hypot(out[:, 2] - out[:, 0], out[:, 3] - out[:, 1]) > 0]


def pieces_in_squares(e: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The parts of segments in the closed squares of a grid: segment numbers, square numbers x and y, parts."""
    def split(which: np.ndarray, p: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lo, hi = np.minimum(p[:, axis], p[:, axis + 2]), np.maximum(p[:, axis], p[:, axis + 2])
        a, b = np.ceil((lo - EPS) / size).astype(np.int64) - 1, np.floor((hi + EPS) / size).astype(np.int64)
        n = b - a + 1
        row = np.repeat(np.arange(len(p)), n)
        cell = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + a[row]
        low, high = cell * size, (cell + 1) * size
        q = p[row].copy()
        start, end = p[row, axis], p[row, axis + 2]
        other = 1 - axis
        with np.errstate(divide="ignore", invalid="ignore"):
            for at in (axis, axis + 2):
                bound = np.where(q[:, at] < low, low, np.where(q[:, at] > high, high, q[:, at]))
                moved = (bound != q[:, at]) & (start != end)
                t = np.clip((bound - start) / (end - start), 0, 1)
                q[:, at - axis + other] = np.where(moved, p[row, other] + t * (p[row, other + 2] - p[row, other]), q[:, at - axis + other])
                q[:, at] = bound
        return which[row], cell, q

    which, x, p = split(np.arange(len(e)), e, 0)
    row, y, p = split(np.arange(len(p)), p, 1)
    return which[row], x[row], y, p
