"""Row-level geometry: poses, rays, points and gradients as column expressions.

A pose is an ``array<double>`` of 16 values, the row-major 4x4 sensor-to-world matrix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vec = Sequence[Column]


def vec(*names: str) -> list[Column]:
    return [F.col(n) for n in names]


def dot(a: Vec, b: Vec) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:]):
        out = out + p * q
    return out


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def sub(a: Vec, b: Vec) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def cross(a: Vec, b: Vec) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def safe_div(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (in any ANSI mode)."""
    return F.try_divide(a, b)


# -- camera and sensor model (P1, P2, P6) --------------------------------------------------------


def scale_intrinsics(fx, fy, cx, cy, width, height, new_width, new_height):
    """Intrinsics for a resampled image."""
    sx, sy = new_width / width, new_height / height
    return fx * sx, fy * sy, cx * sx, cy * sy


def pixel_ray(u: Column, v: Column, fx, fy, cx, cy) -> list[Column]:
    """Pinhole ray with z = 1 (not unit length)."""
    return [(u - cx) / fx, (v - cy) / fy, F.lit(1.0)]


def back_project(ray: Vec, depth: Column) -> list[Column]:
    """point = ray * depth; depth is measured along z."""
    return [r * depth for r in ray]


def range_and_direction(point: Vec) -> tuple[Column, list[Column]]:
    """Range and unit direction of a LiDAR point."""
    r = norm(point)
    return r, [safe_div(p, r) for p in point]


# -- poses (P3, P4, P5, P7, F2) ------------------------------------------------------------------


def pose_at(pose: Column, row: int, col: int) -> Column:
    return F.get(pose, row * 4 + col)


def rotate(pose: Column, p: Vec) -> list[Column]:
    return [dot([pose_at(pose, r, c) for c in range(3)], p) for r in range(3)]


def translation(pose: Column) -> list[Column]:
    return [pose_at(pose, r, 3) for r in range(3)]


def to_world(pose: Column, p: Vec) -> list[Column]:
    """R p + t."""
    return [a + b for a, b in zip(rotate(pose, p), translation(pose))]


def to_sensor(pose: Column, p: Vec) -> list[Column]:
    """Inverse of P3: R^T (p - t)."""
    d = sub(p, translation(pose))
    return [dot([pose_at(pose, r, c) for r in range(3)], d) for c in range(3)]


def ray_to_world(pose: Column, direction: Vec) -> tuple[list[Column], list[Column]]:
    """Origin t and direction R d."""
    return translation(pose), rotate(pose, direction)


def quaternion_pose(t: Vec, q: Vec) -> Column:
    """Pose from a translation and an (x, y, z, w) quaternion of any length."""
    x, y, z, w = q
    s = safe_div(F.lit(2.0), dot(q, q))
    one = F.lit(1.0)
    rows = [
        [one - s * (y * y + z * z), s * (x * y - z * w), s * (x * z + y * w), t[0]],
        [s * (x * y + z * w), one - s * (x * x + z * z), s * (y * z - x * w), t[1]],
        [s * (x * z - y * w), s * (y * z + x * w), one - s * (x * x + y * y), t[2]],
        [F.lit(0.0), F.lit(0.0), F.lit(0.0), one],
    ]
    return F.array(*[c for row in rows for c in row])


#: Where each message kind keeps its position/orientation struct.
POSE_KINDS = {"pose": "pose", "odometry": "pose.pose", "transform": "transform"}


def message_pose(df: DataFrame, kind: str, message: str = "msg") -> DataFrame:
    """P5: pose column of one of three message kinds; any other kind is an error.

    The message column is a struct: ``pose`` and ``odometry`` hold ``position`` and ``orientation``,
    ``transform`` holds ``translation`` and ``rotation``.
    """
    if kind not in POSE_KINDS:
        raise ValueError(f"unknown pose message kind: {kind}")
    root = f"{message}.{POSE_KINDS[kind]}"
    place, turn = ("translation", "rotation") if kind == "transform" else ("position", "orientation")
    t = [F.col(f"{root}.{place}.{a}") for a in "xyz"]
    q = [F.col(f"{root}.{turn}.{a}") for a in "xyzw"]
    return df.withColumn("pose", quaternion_pose(t, q))


def finite_pose(pose: Column) -> Column:
    """all 16 values are finite numbers."""
    inf = float("inf")
    ok = F.forall(pose, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(inf)))
    return F.coalesce(ok & (F.size(pose) == 16), F.lit(False))


# -- canonical scene frame (P8, P9) --------------------------------------------------------------


def up_axis_rotation(rotation: np.ndarray) -> np.ndarray:
    """``rotation`` has the box axes as columns. Returns the turn that brings the box frame to the
    axes with its most vertical axis pointing to +z.

    That axis is one of the six signed unit vectors, so what is left to do after the box frame is a quarter turn about
    the horizontal axis beside it, a half turn about x, or nothing: a permutation with signs.
    """
    box = np.asarray(rotation, dtype=float).T
    upright = box[:, 2]
    k = int(np.abs(upright).argmax())
    sign = -1.0 if upright[k] < 0 else 1.0
    if k == 2:
        return np.diag([1.0, sign, sign]) @ box
    turn = np.eye(3)
    turn[[k, 2]] = 0.0
    turn[2, k], turn[k, 2] = sign, -sign
    return turn @ box


def canonical_points(p: Vec, rotation: np.ndarray, centre: Sequence[float]) -> list[Column]:
    """R (p - c) with literal R and c."""
    d = [c - F.lit(float(m)) for c, m in zip(p, centre)]
    return [dot([F.lit(float(v)) for v in row], d) for row in np.asarray(rotation)]


def restore_points(p: Vec, rotation: np.ndarray, centre: Sequence[float]) -> list[Column]:
    """Inverse of P8: R^T p + c."""
    back = [dot([F.lit(float(v)) for v in row], p) for row in np.asarray(rotation).T]
    return [b + F.lit(float(m)) for b, m in zip(back, centre)]


def canonical_pose(pose: Column, rotation: np.ndarray, centre: Sequence[float]) -> Column:
    """P8 for poses: rotation R R_cam, translation R (t - c)."""
    cols = [canonical_rotation_column(pose, rotation, c) for c in range(3)]
    t = canonical_points(translation(pose), rotation, centre)
    rows = [[cols[c][r] for c in range(3)] + [t[r]] for r in range(3)]
    return F.array(*[v for row in rows for v in row], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def canonical_rotation_column(pose: Column, rotation: np.ndarray, col: int) -> list[Column]:
    v = [pose_at(pose, r, col) for r in range(3)]
    return [dot([F.lit(float(x)) for x in row], v) for row in np.asarray(rotation)]


# -- boxes (F3, F4, F5, F6) ----------------------------------------------------------------------


def in_box(p: Vec, low: Sequence[float], high: Sequence[float]) -> Column:
    """inside an axis-aligned box, both ends inclusive."""
    out = F.lit(True)
    for c, lo, hi in zip(p, low, high):
        out = out & c.between(float(lo), float(hi))
    return out


def clamp_to_box(origin: Vec, p: Vec, low: Sequence[float], high: Sequence[float]) -> list[Column]:
    """an outside point moves along its sensor ray to just inside the box; others stay."""
    d = sub(p, origin)
    exits = []
    for o, c, lo, hi in zip(origin, d, low, high):
        safe = F.when(F.abs(c) >= 1e-8, c).otherwise(F.when(c < 0, F.lit(-1e-8)).otherwise(F.lit(1e-8)))
        exits.append(F.greatest((F.lit(float(lo)) - o) / safe, (F.lit(float(hi)) - o) / safe))
    t = F.least(*exits) * F.lit(0.9999)
    inside = in_box(p, low, high)
    return [F.when(inside, c).otherwise(o + t * k) for o, c, k in zip(origin, p, d)]


def in_oriented_box(p: Vec, size: Sequence[float], centre: Sequence[float], wxyz: Sequence[float]) -> Column:
    """inside (or on) a box of full edge lengths ``size`` turned by a w, x, y, z quaternion."""
    w, x, y, z = np.asarray(wxyz, dtype=float) / np.linalg.norm(wxyz)
    turn = np.array(
        [
            [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)],
            [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)],
            [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)],
        ]
    )
    half = [float(s) / 2.0 for s in size]
    return in_box(canonical_points(p, turn.T, centre), [-h for h in half], half)


# -- gradients and scalars (P20, P21, P22, P24) --------------------------------------------------


def offset_points(df: DataFrame, eps: float, dims: int = 3) -> DataFrame:
    """P20: six (2*dims) rows per point, +-eps on each axis, tagged ``axis`` (0..) and ``side`` (+1/-1)."""
    axes = "xyz"[:dims]
    options = []
    for i in range(dims):
        for side in (1, -1):
            moved = [(F.col(a) + F.lit(side * eps if j == i else 0.0)).alias(a) for j, a in enumerate(axes)]
            options.append(F.struct(F.lit(i).alias("axis"), F.lit(side).alias("side"), *moved))
    rest = [c for c in df.columns if c not in axes]
    out = df.select(*rest, F.explode(F.array(*options)).alias("_o"))
    return out.select(*rest, "_o.*")


def normalised(g: Vec, floor: float = 0.0) -> list[Column]:
    """Unit gradient; length 0 (mesh) or below ``floor`` (cloud, 1e-6) divides by 1."""
    n = norm(g)
    length = F.when((n == 0) | (n < floor), F.lit(1.0)).otherwise(n)
    return [c / length for c in g]


def gradient_angle(a: Vec, b: Vec) -> Column:
    """Angle between two gradients in radians."""
    na, nb = norm(a) + 1e-8, norm(b) + 1e-8
    cosine = dot([c / na for c in a], [c / nb for c in b])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))


def clip_normalise(v: Column, low: Column | float, high: Column | float) -> Column:
    """Clip to [low, high] and scale to [0, 1]; an empty range gives 0."""
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    scaled = safe_div(F.greatest(low, F.least(high, v)) - low, high - low)
    return F.coalesce(scaled, F.when(v.isNotNull(), F.lit(0.0)))


def signed_error(prediction: Column, truth: Column, clip: float = 0.5) -> Column:
    """P25: prediction - truth, clipped."""
    return F.greatest(F.lit(-clip), F.least(F.lit(clip), prediction - truth))
