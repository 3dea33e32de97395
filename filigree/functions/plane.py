"""Plane geometry on graph-sized inputs: hulls, polygons, crossings."""

from __future__ import annotations

import numpy as np


def line_crossing(a1, a2, b1, b2) -> tuple[float, float]:
    """Where two lines meet; infinity where they are parallel."""
    d, e = np.subtract(a2, a1), np.subtract(b2, b1)
    cross = d[0] * e[1] - d[1] * e[0]
    if abs(cross) < 1e-300:
        return float("inf"), float("inf")
    f = np.subtract(b1, a1)
    t = (f[0] * e[1] - f[1] * e[0]) / cross
    return float(a1[0] + t * d[0]), float(a1[1] + t * d[1])


def is_between(a, b, c) -> bool:
    """Whether ``c``'s foot on the line through ``a`` and ``b`` lies between them."""
    s = float(np.dot(np.subtract(c, a), np.subtract(b, a)))
    return 0 <= s <= float(np.sum(np.subtract(b, a) ** 2))


def ray_crossings(points: np.ndarray, y: np.ndarray, edges: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """For each point, where the line from ``centre`` through it crosses the cycle on the point's side; infinity if nowhere.

    On the point's side is a crossing that is nearer to the point than to the centre; of several, that of the last edge counts.
    """
    out = np.full((len(points), 2), np.inf)
    for a, b in edges:
        at = np.array([line_crossing(centre, p, y[a], y[b]) for p in points]).reshape(-1, 2)
        met = np.isfinite(at).all(1)
        side = np.where(met, ((at - points) ** 2).sum(1) < ((at - centre) ** 2).sum(1), False)
        on = np.array([m and is_between(y[a], y[b], c) for m, c in zip(met, at)], bool)
        out[side & on] = at[side & on]
    return out


def centre_weights(points: np.ndarray, y: np.ndarray, edges: np.ndarray, centre: np.ndarray, threshold: float = 0.2) -> np.ndarray:
    """Falling from the centre to 0 at the boundary; what lies above ``threshold`` counts in full, as 1."""
    at = ray_crossings(points, y, edges, centre)
    far = np.linalg.norm(at - centre, axis=1)
    share = 1 - np.linalg.norm(points - centre, axis=1) / np.where(far > 0, far, np.inf)
    return np.where(share > threshold, 1.0, share)


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise, by the monotone chain."""
    p = np.unique(np.asarray(points, float), axis=0)
    if len(p) < 3:
        return p

    def half(q):
        out: list = []
        for v in q:
            while len(out) > 1 and _turn(out[-2], out[-1], v) <= 0:
                out.pop()
            out.append(v)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def _turn(a, b, c) -> float:
    return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])


def in_hull(points: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Whether each query lies strictly inside the hull of the points."""
    h = hull(points)
    if len(h) < 3:
        return np.zeros(len(queries), bool)
    nxt = np.roll(h, -1, axis=0)
    side = (nxt[:, 0] - h[:, 0]) * (queries[:, 1:2] - h[:, 1]) - (nxt[:, 1] - h[:, 1]) * (queries[:, 0:1] - h[:, 0])
    return (side > 0).all(1)


def in_polygon(polygon: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Even-odd test of each query against a simple polygon."""
    a, b = polygon, np.roll(polygon, -1, axis=0)
    y = queries[:, 1:2]
    spans = (a[:, 1] > y) != (b[:, 1] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        x = a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])
    return (spans & (queries[:, 0:1] < x)).sum(1) % 2 == 1


def polygon_area(x: np.ndarray, y: np.ndarray) -> float:
    return 0.5 * abs(float(np.dot(x, np.roll(y, 1)) - np.dot(y, np.roll(x, 1))))


def compactness(cycle: np.ndarray) -> float:
    """Area over the squared length of the open polyline, times four pi (the closing edge is not counted)."""
    length = np.linalg.norm(np.diff(cycle, axis=0), axis=1).sum()
    return float(4 * np.pi * polygon_area(cycle[:, 0], cycle[:, 1]) / length**2) if length else 0.0


def inset(polygon: np.ndarray, factor: float = 0.10, swell: bool = False) -> np.ndarray:
    """The polygon with every side moved in (or out) by ``factor`` times the distance from the centre to the lower left corner of its box.

    Neighbouring sides meet where their moved lines do (mitred corners).
    """
    p = np.asarray(polygon, float)
    centre = (p.min(0) + p.max(0)) / 2
    step = factor * np.linalg.norm(centre - p.min(0)) * (-1 if swell else 1)
    signed = 0.5 * float(np.dot(p[:, 0], np.roll(p[:, 1], -1)) - np.dot(p[:, 1], np.roll(p[:, 0], -1)))
    p = p if signed > 0 else p[::-1]
    side = np.roll(p, -1, axis=0) - p
    normal = np.stack([-side[:, 1], side[:, 0]], 1) / np.maximum(np.linalg.norm(side, axis=1), 1e-300)[:, None]
    a, b = p + step * normal, np.roll(p, -1, axis=0) + step * normal
    out = []
    for i in range(len(p)):
        at = line_crossing(a[i - 1], b[i - 1], a[i], b[i])
        out.append(at if np.isfinite(at[0]) else tuple(a[i]))
    return np.array(out)


def mahalanobis(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distance of each row from ``centre`` in units of the rows' covariance (pseudo-inverse where singular)."""
    # The rows' own axes and spreads; axes without spread do not count, which is the pseudo-inverse.
    _, spread, axes = np.linalg.svd((points - points.mean(0)) / np.sqrt(max(1, len(points) - 1)), full_matrices=False)
    used = spread > 1e-12 * max(spread.max(initial=0), 1e-300)
    return np.linalg.norm((points - centre) @ axes[used].T / spread[used], axis=1)


def remove_crossings(y: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Puts a node wherever two edges cross in the first two dimensions."""
    y, edges, again = np.asarray(y, float), [tuple(e) for e in np.asarray(edges).tolist()], True
    while again:
        again = False
        for i, (a, b) in enumerate(edges):
            for j in range(i + 1, len(edges)):
                c, d = edges[j]
                if len({a, b, c, d}) < 4:
                    continue
                at = line_crossing(y[a][:2], y[b][:2], y[c][:2], y[d][:2])
                strict = np.isfinite(at[0]) and all(is_between(y[p][:2], y[q][:2], at) for p, q in ((a, b), (c, d)))
                if strict:
                    u = np.linalg.norm(np.subtract(at, y[a][:2])) / max(np.linalg.norm(y[b][:2] - y[a][:2]), 1e-300)
                    new = len(y)
                    y = np.vstack([y, y[a] + u * (y[b] - y[a])])
                    edges = [e for k, e in enumerate(edges) if k not in (i, j)] + [(a, new), (new, b), (c, new), (new, d)]
                    again = True
                    break
            if again:
                break
    return y, np.array(edges)
