"""Vectorised planar predicates on flat geometry batches (used inside Spark tasks)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from plotweave.functions.geoarrays import Flat

CHUNK = 2_000_000


def spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For group sizes: the group of every item, and the position of the item in its group."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner]


def chunks(sizes: np.ndarray, limit: int = CHUNK):
    """Slices of consecutive groups whose summed size stays near `limit`."""
    if len(sizes) == 0:
        return
    bucket = (np.cumsum(sizes) - sizes) // limit
    edges = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(sizes)]):
        yield slice(lo, hi)


@dataclass(frozen=True)
class Segments:
    """Directed edges of a batch, interior on the left; edges of one geometry are consecutive."""

    a: np.ndarray
    b: np.ndarray
    start: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.start)


def segments(flat: Flat) -> Segments:
    n_rings = len(flat.ring_start) - 1
    sizes = np.diff(flat.ring_start)
    ring, pos = spread(np.maximum(sizes - 1, 0))
    at = flat.ring_start[ring] + pos
    a, b = flat.xy[at], flat.xy[at + 1]
    origin = flat.xy[flat.ring_start[ring]] if len(at) else a
    cross = (a[:, 0] - origin[:, 0]) * (b[:, 1] - origin[:, 1]) - (b[:, 0] - origin[:, 0]) * (a[:, 1] - origin[:, 1])
    ccw = np.bincount(ring, cross, n_rings) >= 0
    outer = np.zeros(n_rings, bool)
    firsts = flat.polygon_start[:-1][np.diff(flat.polygon_start) > 0]
    outer[firsts] = True
    flip = (ccw != outer)[ring]
    a, b = np.where(flip[:, None], b, a), np.where(flip[:, None], a, b)
    polygon_of_ring = np.repeat(np.arange(len(flat.polygon_start) - 1), np.diff(flat.polygon_start))
    geom_of_polygon = np.repeat(np.arange(flat.n_geoms), np.diff(flat.geom_start))
    geom = geom_of_polygon[polygon_of_ring[ring]] if len(ring) else ring
    long_enough = (a != b).any(axis=1)
    counts = np.bincount(geom[long_enough], minlength=flat.n_geoms)
    return Segments(a[long_enough], b[long_enough], np.concatenate([[0], np.cumsum(counts)]))


def boxes(flat: Flat, xy: np.ndarray | None = None) -> np.ndarray:
    """(x0, y0, x1, y1) per geometry; geometries without vertices get an empty (inverted) box."""
    xy = flat.xy if xy is None else xy
    starts = flat.vertex_start
    out = np.tile([np.inf, np.inf, -np.inf, -np.inf], (flat.n_geoms, 1))
    filled = np.flatnonzero(np.diff(starts) > 0)
    if len(filled):
        at = starts[:-1][filled]
        out[filled, :2] = np.minimum.reduceat(xy, at, axis=0)
        out[filled, 2:] = np.maximum.reduceat(xy, at, axis=0)
    return out


def measures(flat: Flat) -> np.ndarray:
    """(area, perimeter, centroid x, centroid y) per geometry; holes are subtracted.

    A geometry without area has the mean of its vertices for a centroid.
    """
    n_rings, n = len(flat.ring_start) - 1, flat.n_geoms
    ring, pos = spread(np.maximum(np.diff(flat.ring_start) - 1, 0))
    at = flat.ring_start[ring] + pos
    origin = flat.xy[np.minimum(flat.ring_start[:-1], max(len(flat.xy) - 1, 0))] if len(flat.xy) else np.zeros((n_rings, 2))
    a, b = flat.xy[at] - origin[ring], flat.xy[at + 1] - origin[ring]
    cross = a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]
    total = lambda w: np.bincount(ring, w, n_rings)
    doubled, length = total(cross), total(np.hypot(*(b - a).T))
    safe = np.where(doubled == 0, 1.0, doubled)
    centre = origin + np.column_stack([total((a[:, 0] + b[:, 0]) * cross), total((a[:, 1] + b[:, 1]) * cross)]) / (3 * safe)[:, None]
    outer = np.zeros(n_rings, bool)
    outer[flat.polygon_start[:-1][np.diff(flat.polygon_start) > 0]] = True
    weight = np.abs(doubled) / 2 * np.where(outer, 1.0, -1.0)
    geom_of_polygon = np.repeat(np.arange(n), np.diff(flat.geom_start))
    geom = np.repeat(geom_of_polygon, np.diff(flat.polygon_start))
    per_geom = lambda w: np.bincount(geom, w, n)
    area, perimeter = per_geom(weight), per_geom(length)
    n_vertices = np.diff(flat.vertex_start)
    owner = np.repeat(np.arange(n), n_vertices)
    mean = np.column_stack([np.bincount(owner, flat.xy[:, i], n) for i in (0, 1)]) / np.where(n_vertices, n_vertices, np.nan)[:, None]
    shift = centre - mean[geom]
    moved = np.column_stack([per_geom(weight * shift[:, i]) for i in (0, 1)]) / np.where(area == 0, 1.0, area)[:, None]
    centroid = np.where((area == 0)[:, None], mean, mean + moved)
    return np.column_stack([area, perimeter, centroid])


def overlapping_boxes(left: np.ndarray, right: np.ndarray, slack: float = 0.0):
    """Index pairs of closed boxes that meet, found in row chunks so memory stays bounded."""
    order = np.argsort(right[:, 0], kind="stable")
    sorted_x0 = right[order, 0]
    for lo in range(0, len(left), 512):
        part = left[lo : lo + 512]
        reach = np.searchsorted(sorted_x0, part[:, 2] + slack, side="right")
        cand = order[: reach.max(initial=0)]
        meet = (
            (right[cand, 0] <= part[:, 2, None] + slack)
            & (right[cand, 2] >= part[:, 0, None] - slack)
            & (right[cand, 1] <= part[:, 3, None] + slack)
            & (right[cand, 3] >= part[:, 1, None] - slack)
        )
        i, j = np.nonzero(meet)
        yield lo + i, cand[j]


def _cross(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0]


def _dot(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return u[:, 0] * v[:, 0] + u[:, 1] * v[:, 1]


def inside(px: np.ndarray, py: np.ndarray, segs: Segments, geom: np.ndarray) -> np.ndarray:
    """Even-odd test of point i in geometry `geom[i]`."""
    hit = np.zeros(len(px), bool)
    for s in chunks(segs.count[geom]):
        owner, pos = spread(segs.count[geom[s]])
        at = segs.start[geom[s]][owner] + pos
        x, y = px[s][owner], py[s][owner]
        ax, ay, bx, by = segs.a[at, 0], segs.a[at, 1], segs.b[at, 0], segs.b[at, 1]
        spans = (ay > y) != (by > y)
        rise = np.where(spans, by - ay, 1.0)
        crossed = spans & (x < ax + (bx - ax) * (y - ay) / rise)
        hit[s] = np.bincount(owner, crossed, len(px[s])) % 2 == 1
    return hit


def boundary_distance(px: np.ndarray, py: np.ndarray, segs: Segments, geom: np.ndarray) -> np.ndarray:
    """Distance of point i to the boundary of geometry `geom[i]`; inf if it has none."""
    best = np.full(len(px), np.inf)
    for s in chunks(segs.count[geom]):
        owner, pos = spread(segs.count[geom[s]])
        if not len(owner):
            continue
        at = segs.start[geom[s]][owner] + pos
        d = segs.b[at] - segs.a[at]
        p = np.column_stack([px[s][owner], py[s][owner]]) - segs.a[at]
        t = np.clip(_dot(p, d) / _dot(d, d), 0.0, 1.0)
        gap = p - t[:, None] * d
        part = best[s]
        np.minimum.at(part, owner, np.sqrt(_dot(gap, gap)))
        best[s] = part
    return best


def _contacts(segs: Segments, p: np.ndarray, q: np.ndarray, tol: float):
    """Edge-to-edge relations of geometry pairs (p[i], q[i]).

    Returns per pair: interiors certainly meet, boundaries meet, shared length; and the break
    points `(pair, edge, offset along the edge)` on the edges of both sides.
    """
    n = len(p)
    clash, contact, shared = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n)
    breaks_p, breaks_q = [], []
    for s in chunks(segs.count[p] * segs.count[q]):
        cp, cq = segs.count[p[s]], segs.count[q[s]]
        pair, pos = spread(cp * cq)
        width = np.maximum(cq[pair], 1)
        e = segs.start[p[s]][pair] + pos // width
        f = segs.start[q[s]][pair] + pos % width
        near = np.ones(len(e), bool)
        for axis in (0, 1):
            near &= np.maximum(segs.a[e, axis], segs.b[e, axis]) >= np.minimum(segs.a[f, axis], segs.b[f, axis]) - tol
            near &= np.maximum(segs.a[f, axis], segs.b[f, axis]) >= np.minimum(segs.a[e, axis], segs.b[e, axis]) - tol
        e, f, pair = e[near], f[near], pair[near] + s.start
        a1, a2 = segs.a[e], segs.a[f]
        d1, d2 = segs.b[e] - a1, segs.b[f] - a2
        n1, n2 = np.sqrt(_dot(d1, d1)), np.sqrt(_dot(d2, d2))
        u1, u2 = d1 / n1[:, None], d2 / n2[:, None]
        off = a2 - a1
        # signed distances of the ends of each edge from the line of the other
        f_a, f_b = _cross(u1, off), _cross(u1, off + d2)
        e_a, e_b = _cross(u2, -off), _cross(u2, d1 - off)
        flat = (np.maximum(np.abs(f_a), np.abs(f_b)) <= tol) | (np.maximum(np.abs(e_a), np.abs(e_b)) <= tol)
        crossing = (
            (np.sign(f_a) * np.sign(f_b) < 0) & (np.minimum(np.abs(f_a), np.abs(f_b)) > tol)
            & (np.sign(e_a) * np.sign(e_b) < 0) & (np.minimum(np.abs(e_a), np.abs(e_b)) > tol)
        )
        t_a, t_b = _dot(off, u1), _dot(off + d2, u1)
        lo, hi = np.maximum(np.minimum(t_a, t_b), 0.0), np.minimum(np.maximum(t_a, t_b), n1)
        overlap = np.where(flat, hi - lo, 0.0)
        along = flat & (overlap > tol)
        same_way = along & (_dot(d1, d2) > 0)
        clash[np.unique(pair[crossing | same_way])] = True
        shared += np.bincount(pair[along & ~same_way], overlap[along & ~same_way], n)
        s_a, s_b = _dot(-off, u2), _dot(d1 - off, u2)
        met = along.copy()
        for t, gap, length, own, store in (
            (t_a, f_a, n1, e, breaks_p), (t_b, f_b, n1, e, breaks_p), (s_a, e_a, n2, f, breaks_q), (s_b, e_b, n2, f, breaks_q)
        ):
            on = (np.abs(gap) <= tol) & (t >= -tol) & (t <= length + tol)
            met |= on
            store.append((pair[on], own[on], np.clip(t[on], 0.0, length[on])))
        contact[np.unique(pair[met])] = True
    join = lambda parts: tuple(np.concatenate(c) for c in zip(*parts)) if parts else (np.empty(0, int),) * 3
    return clash, contact, shared, join(breaks_p), join(breaks_q)


def _enters(segs: Segments, own: np.ndarray, other: np.ndarray, live: np.ndarray, breaks, tol: float) -> np.ndarray:
    """Whether some stretch of the boundary of own[i] runs strictly inside other[i], for live pairs."""
    out = np.zeros(len(own), bool)
    at = np.flatnonzero(live)
    if not len(at):
        return out
    pair_local, pos = spread(segs.count[own[at]])
    pair = at[pair_local]
    edge = segs.start[own[pair]] + pos
    length = np.sqrt(((segs.b[edge] - segs.a[edge]) ** 2).sum(axis=1))
    bp, be, bt = breaks
    keep = live[bp] if len(bp) else np.empty(0, bool)
    all_pair = np.concatenate([pair, pair, bp[keep]]).astype(int)
    all_edge = np.concatenate([edge, edge, be[keep]]).astype(int)
    all_t = np.concatenate([np.zeros(len(edge)), length, bt[keep]])
    order = np.lexsort((all_t, all_edge, all_pair))
    all_pair, all_edge, all_t = all_pair[order], all_edge[order], all_t[order]
    same = (all_pair[1:] == all_pair[:-1]) & (all_edge[1:] == all_edge[:-1]) & (np.diff(all_t) > 2 * tol)
    i = np.flatnonzero(same)
    mid_t = (all_t[i] + all_t[i + 1]) / 2
    e = all_edge[i]
    span = segs.b[e] - segs.a[e]
    mid = segs.a[e] + span * (mid_t / np.sqrt(_dot(span, span)))[:, None]
    geom = other[all_pair[i]]
    within = inside(mid[:, 0], mid[:, 1], segs, geom)
    w = np.flatnonzero(within)
    clear = boundary_distance(mid[w, 0], mid[w, 1], segs, geom[w]) > tol
    out[all_pair[i][w[clear]]] = True
    return out


def touching(flat: Flat, p: np.ndarray, q: np.ndarray, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Per pair: do boundaries meet while interiors do not, and how long is the shared boundary."""
    segs = segments(flat)
    clash, contact, shared, on_p, on_q = _contacts(segs, p, q, tol)
    live = contact & ~clash
    live &= ~_enters(segs, p, q, live, on_p, tol)
    live &= ~_enters(segs, q, p, live, on_q, tol)
    return live, shared


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull, counter-clockwise, not closed (monotone chain)."""
    pts = sorted(set(map(tuple, points.tolist())))
    if len(pts) < 3:
        return np.array(pts, float).reshape(-1, 2)

    def chain(items):
        out: list = []
        for x, y in items:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (y - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (x - out[-2][0]):
                out.pop()
            out.append((x, y))
        return out[:-1]

    return np.array(chain(pts) + chain(pts[::-1]))


def loop_area(loop: np.ndarray) -> float:
    """Unsigned area of an unclosed ring."""
    if len(loop) < 3:
        return 0.0
    p = loop - loop[0]
    return abs(float(np.sum(p[:, 0] * np.roll(p[:, 1], -1) - p[:, 1] * np.roll(p[:, 0], -1)))) / 2


def rectangle_sides(loops: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(short, long) side of the smallest-area rectangle around each convex loop of a batch.

    A smallest rectangle lies along an edge of the loop, so every edge is tried at once.
    """
    sizes = np.diff(starts)
    out = np.zeros((len(sizes), 2))
    for s in chunks(sizes**2):
        n = np.where(sizes[s] >= 3, sizes[s], 0)
        loop, edge = spread(n)
        if not len(loop):
            continue
        first = starts[:-1][s][loop]
        a = loops[first + edge]
        u = loops[first + (edge + 1) % n[loop]] - a
        u = u / np.maximum(np.hypot(u[:, 0], u[:, 1]), 1e-300)[:, None]
        pair, vertex = spread(n[loop])
        rel = loops[first[pair] + vertex] - a[pair]
        along, across = _dot(rel, u[pair]), _cross(u[pair], rel)
        at = np.cumsum(n[loop]) - n[loop]
        w = np.maximum.reduceat(along, at) - np.minimum.reduceat(along, at)
        h = np.maximum.reduceat(across, at) - np.minimum.reduceat(across, at)
        best = np.lexsort((edge, w * h, loop))
        best = best[np.r_[True, np.diff(loop[best]) != 0]]
        rows = np.arange(len(sizes))[s][loop[best]]
        out[rows] = np.sort(np.column_stack([w[best], h[best]]), axis=1)
    return out


def convex_rings(flat: Flat) -> np.ndarray:
    """Which rings turn one way only, and just once around."""
    n_rings = len(flat.ring_start) - 1
    n = np.maximum(np.diff(flat.ring_start) - 1, 0)
    ring, pos = spread(n)
    first = flat.ring_start[ring]
    a = flat.xy[first + pos]
    d = flat.xy[first + (pos + 1) % n[ring]] - a
    e = flat.xy[first + (pos + 2) % n[ring]] - flat.xy[first + (pos + 1) % n[ring]]
    turn = np.arctan2(_cross(d, e), _dot(d, e))
    moving = (d != 0).any(axis=1) & (e != 0).any(axis=1)
    left = np.bincount(ring, moving & (turn > 0), n_rings) > 0
    right = np.bincount(ring, moving & (turn < 0), n_rings) > 0
    still = np.bincount(ring, ~moving, n_rings) > 0
    once = np.abs(np.abs(np.bincount(ring, turn, n_rings)) - 2 * np.pi) < 1e-6
    return (n >= 3) & once & (left != right) & ~still
