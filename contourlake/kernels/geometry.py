"""Polygons as (m, 2) arrays: area, centroid, scaling, equal-area slicing, triangulation."""

from __future__ import annotations

import numpy as np


def signed_area(p: np.ndarray) -> float:
    """Shoelace; positive counter-clockwise."""
    if len(p) < 3:
        return 0.0
    q = np.roll(p, -1, axis=0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def centroid(p: np.ndarray) -> np.ndarray:
    """The centre of mass, or the mean vertex of a polygon without area."""
    area = signed_area(p)
    if abs(area) < 1e-300:
        return p.mean(axis=0)
    origin = p[0]  # nearer numbers lose fewer digits
    x = p - origin
    y = np.roll(x, -1, axis=0)
    cross = x[:, 0] * y[:, 1] - y[:, 0] * x[:, 1]
    return origin + ((x + y) * cross[:, None]).sum(axis=0) / (6 * area)


def scale(p: np.ndarray, factor: float) -> np.ndarray:
    """Towards the centroid; the area changes by the factor's square."""
    c = centroid(p)
    return c + (p - c) * factor


def clip(p: np.ndarray, normal: np.ndarray, offset: float) -> np.ndarray:
    """The part of a convex polygon with ``normal . x <= offset``."""
    side = p @ normal - offset
    out = []
    for i in range(len(p)):
        j = (i + 1) % len(p)
        if side[i] <= 0:
            out.append(p[i])
        if (side[i] < 0 < side[j]) or (side[j] < 0 < side[i]):
            out.append(p[i] + (p[j] - p[i]) * (side[i] / (side[i] - side[j])))
    return np.array(out).reshape(-1, 2)


def diameter(p: np.ndarray) -> tuple[int, int]:
    """The farthest pair of vertices; of equal ones the first."""
    d = ((p[:, None] - p[None]) ** 2).sum(-1)
    i, j = np.unravel_index(int(np.argmax(d)), d.shape)
    return int(min(i, j)), int(max(i, j))


def slice_offset(p: np.ndarray, normal: np.ndarray, share: float) -> float:
    """Where a line across a convex polygon leaves ``share`` of its area behind.

    Along the normal the swept area is quadratic between vertices, so the piece is found first and its quadratic solved.
    """
    whole = abs(signed_area(p))
    knots = np.unique(p @ normal)
    areas = np.array([abs(signed_area(clip(p, normal, k))) for k in knots])
    want = share * whole
    i = int(np.clip(np.searchsorted(areas, want), 1, len(knots) - 1))
    a, b = knots[i - 1], knots[i]
    # Width of the cut grows linearly from w0 to w1 over [a, b].
    mid = abs(signed_area(clip(p, normal, (a + b) / 2))) - areas[i - 1]
    full, h = areas[i] - areas[i - 1], b - a
    if h <= 0 or full <= 0:
        return float(b)
    second, first = (full - 2 * mid) * 2, 4 * mid - full  # full * s = first * s + second * s^2
    rest = want - areas[i - 1]
    if abs(second) < 1e-14 * max(abs(first), 1e-300):
        s = rest / first
    else:
        s = 2 * rest / (first + np.sqrt(max(first * first + 4 * second * rest, 0.0)))
    return float(a + h * min(max(s, 0.0), 1.0))


def slices(p: np.ndarray, shares) -> list[np.ndarray]:
    """Cut a convex polygon into len(shares) parts of the given areas (shares add up to 1), one after another across the diameter of what is left."""
    out, rest, left = [], p, 1.0
    for share in shares[:-1]:
        if len(rest) < 3:
            out.append(rest[:0])
            continue
        i, j = diameter(rest)
        normal = rest[j] - rest[i]
        normal = normal / np.linalg.norm(normal)
        at = slice_offset(rest, normal, min(1.0, share / left) if left > 0 else 1.0)
        out.append(clip(rest, normal, at))
        rest, left = clip(rest, -normal, -at), left - share
    return [*out, rest]


def ring(outer: np.ndarray, inner: np.ndarray):
    """Two triangles for each side of a ring: ((outer point | inner point) index pairs) as rows (is_inner, index) * 3."""
    m = len(outer)
    for i in range(m):
        j = (i + 1) % m
        yield ((0, i), (0, j), (1, i))
        yield ((0, j), (1, j), (1, i))


def landscape(partition, total, height):
    """Polygons and triangles of a nested floor plan.

    partition: (edge, parent, outer vertex, inner vertex, depth), parents first; total: area of an edge with all below it; height: of a vertex. Returns
    ([(edge, polygon)], [(edge, triangle, corner, x, y, z, vertex)]).
    """
    children: dict[int, list[int]] = {}
    for e, parent, *_ in partition:
        children.setdefault(parent, []).append(e)
    ends = {e: (outer, inner) for e, _, outer, inner, _ in partition}
    plans, triangles = [], []
    square = np.array([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])

    def spread(contour, edges):
        whole = sum(total[e] for e in edges)
        return zip(edges, slices(contour, [total[e] / whole for e in edges]), strict=True)

    stack = list(spread(square, children.get(-1, [])))
    while stack:
        e, contour = stack.pop()
        plans.append((e, contour))
        below = children.get(e, [])
        if len(contour) < 3:
            stack += [(c, contour) for c in below]
            continue
        outer, inner = ends[e]
        factor = np.sqrt(sum(total[c] for c in below) / total[e]) if below else 0.5
        rim = scale(contour, factor)
        z0, z1 = height(outer), height(inner)
        zr = z1 if below else (z0 + z1) / 2
        n = 0
        for corners in ring(contour, rim):
            for k, (on_rim, i) in enumerate(corners):
                x, y = (rim if on_rim else contour)[i]
                triangles.append((e, n, k, float(x), float(y), float(zr if on_rim else z0), inner if on_rim else outer))
            n += 1
        if below:
            stack += list(spread(rim, below))
        else:
            c = centroid(rim)
            for i in range(len(rim)):
                for k, (x, y, z) in enumerate(((*rim[i], zr), (*rim[(i + 1) % len(rim)], zr), (*c, z1))):
                    triangles.append((e, n, k, float(x), float(y), float(z), inner))
                n += 1
    return plans, triangles


def split(p: np.ndarray, at: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of a convex polygon on the right and on the left of the line through a point in a direction."""
    normal = np.array([-direction[1], direction[0]], float)
    offset = float(normal @ np.asarray(at, float))
    return clip(p, normal, offset), clip(p, -normal, -offset)


def split_by_segment(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for the line through two points."""
    return split(p, a, np.asarray(b, float) - np.asarray(a, float))
