"""Predicates and intersections between simple shapes (J16, J18) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voxfield.functions.geometry import Vec, cross, dot, norm, safe_div, sub

TINY = 2.2250738585072014e-308


def cross2(a: Vec, b: Vec) -> Column:
    return a[0] * b[1] - a[1] * b[0]


def point_segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Distance to the closest point of segment ab (2-D or 3-D); a point-like segment is a point."""
    ab, ap = sub(b, a), sub(p, a)
    t = F.coalesce(safe_div(dot(ap, ab), dot(ab, ab)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return norm([x - t * y for x, y in zip(ap, ab)])


def line_line_2d(p0: Vec, p1: Vec, q0: Vec, q1: Vec) -> tuple[Column, Column]:
    """Parameters of the crossing on both lines (0 at the first point, 1 at the second); NULL if parallel."""
    u, v, w = sub(p1, p0), sub(q1, q0), sub(q0, p0)
    det = cross2(u, v)
    det = F.when(F.abs(det) > TINY, det)
    return cross2(w, v) / det, cross2(w, u) / det


def line_line_3d(p0: Vec, p1: Vec, q0: Vec, q1: Vec) -> tuple[Column, Column, Column]:
    """Closest points of two 3-D lines: metric distances from the first points, and the gap.

    All NULL if a line is a point or the lines are parallel.
    """
    u, v, w = sub(p1, p0), sub(q1, q0), sub(q0, p0)
    nu, nv = norm(u), norm(v)
    u = [safe_div(c, nu) for c in u]
    v = [safe_div(c, nv) for c in v]
    a, b, d = dot(w, u), dot(u, v), dot(w, v)
    det = F.lit(1.0) - b * b
    det = F.when(F.abs(det) > TINY, det)
    s, t = (a - b * d) / det, (a * b - d) / det
    gap = norm([x + t * y - s * z for x, y, z in zip(w, v, u)])
    return s, t, gap


def ray_line_2d(origin: Vec, direction: Vec, a: Vec, b: Vec) -> tuple[Column, Column]:
    """(fraction of the segment from b towards a, distance along the ray) of the crossing; NULL if parallel."""
    ab, ob = sub(b, a), sub(b, origin)
    det = cross2(ab, direction)
    det = F.when(F.abs(det) > TINY, det)
    return cross2(ob, direction) / det, cross2(ab, ob) / det


def ray_box(origin: Vec, direction: Vec, low: Vec, high: Vec) -> tuple[Column, Column, Column, Column]:
    """Slab test of an endless line against a box (2-D or 3-D): (d1, d2, hit, inside).

    d1 is the first crossing ahead; from inside it is the exit and d2 lies behind; if the box is behind,
    both are negative with d1 the nearer. An origin on a plane crosses it at 0.
    """
    near, far = [], []
    inside = F.lit(True)
    for o, d, lo, hi in zip(origin, direction, low, high):
        # A ray parallel to the slab never leaves it, or never meets it.
        infinite = F.lit(float("inf"))
        t1 = F.when(o == lo, F.lit(0.0)).when(d == 0, F.when(lo > o, infinite).otherwise(-infinite)).otherwise(safe_div(lo - o, d))
        t2 = F.when(o == hi, F.lit(0.0)).when(d == 0, F.when(hi > o, infinite).otherwise(-infinite)).otherwise(safe_div(hi - o, d))
        near.append(F.least(t1, t2))
        far.append(F.greatest(t1, t2))
        inside = inside & (o >= lo) & (o <= hi)
    t_min, t_max = F.greatest(*near), F.least(*far)
    hit = t_max >= t_min
    forward = ~inside & (t_min >= 0)
    d1 = F.when(hit, F.when(forward, t_min).otherwise(t_max))
    d2 = F.when(hit, F.when(forward, t_max).otherwise(t_min))
    return d1, d2, hit, inside


def line_ellipsoid(p0: Vec, p1: Vec, radii: Vec) -> tuple[Column, Column]:
    """Both crossings of a line with an origin-centred ellipse (2-D) or ellipsoid (3-D), as parameters
    from p0 (0) to p1 (1), smaller first; NULL if they miss. Solved on the unit sphere."""
    a = [safe_div(c, r) for c, r in zip(p0, radii)]
    d = [safe_div(c, r) for c, r in zip(sub(p1, p0), radii)]
    dd, ad, aa = dot(d, d), dot(a, d), dot(a, a)
    disc = ad * ad - dd * (aa - F.lit(1.0))
    root = F.sqrt(F.when(disc >= 0, disc))
    return safe_div(-ad - root, dd), safe_div(-ad + root, dd)


def point_triangle_distance(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Distance to a triangle: to its plane if the foot lies inside, else to the nearest edge.

    The foot is inside when it is on the inner side of all three edges; a triangle without area falls
    back to its edges.
    """
    ab, ac = sub(b, a), sub(c, a)
    n = cross(ab, ac)
    nn = dot(n, n)
    side = [dot(cross(sub(t, s), n), sub(p, s)) for s, t in ((a, b), (b, c), (c, a))]
    inside = (nn > 0) & (side[0] <= 0) & (side[1] <= 0) & (side[2] <= 0)
    plane = safe_div(F.abs(dot(n, sub(p, a))), F.sqrt(nn))
    edges = F.least(*[point_segment_distance(p, s, t) for s, t in ((a, b), (b, c), (c, a))])
    return F.when(inside, plane).otherwise(edges)
