"""Frames and trajectories: pose joins, world points, bounds, segments and numbering."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.operators.asof import ID_BLOCK, numbered, with_previous


def join_poses(points: DataFrame, frames: DataFrame, by: Sequence[str] = ("scene", "frame_id")) -> DataFrame:
    """Scan rows with the pose of their frame.

    The pose side is unique per frame, so a frame with very many points only lengthens the stream side,
    which the runtime splits; whether poses are small enough to broadcast is decided from their real size.
    """
    return points.join(frames.select(*by, "pose"), list(by))


def world_points(points: DataFrame, frames: DataFrame, by: Sequence[str] = ("scene", "frame_id")) -> DataFrame:
    """P3 after J1: x, y, z become world coordinates."""
    joined = join_poses(points, frames, by)
    moved = dict(zip("xyz", G.to_world(F.col("pose"), G.vec("x", "y", "z"))))
    return joined.withColumns(moved).drop("pose")


def bounds(points: DataFrame, by: Sequence[str] = ("scene", "frame_id")) -> DataFrame:
    """A2: min/max per frame, per scene and overall in one pass (NULL marks a rolled-up column)."""
    aggs = [f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    return points.rollup(*by).agg(*aggs)


def padded(bounds_df: DataFrame, pad: float = 0.1) -> DataFrame:
    """Bounds widened by ``pad`` on every side."""
    lows = {f"min_{a}": F.col(f"min_{a}") - F.lit(pad) for a in "xyz"}
    highs = {f"max_{a}": F.col(f"max_{a}") + F.lit(pad) for a in "xyz"}
    return bounds_df.withColumns({**lows, **highs})


def segments(traj: DataFrame, keys: Sequence[str] = ("scene",), order: str = "frame_id") -> DataFrame:
    """Each frame's step from the previous frame and its length (first frame of a scene: none)."""
    out = with_previous(traj, keys, order, ("x", "y", "z")).filter(F.col("prev").isNotNull())
    step = [F.col(a) - F.col(f"prev.{a}") for a in "xyz"]
    return out.withColumn("length", G.norm(step))


def trajectory_length(traj: DataFrame, keys: Sequence[str] = ("scene",), order: str = "frame_id") -> DataFrame:
    """Path length per scene."""
    return segments(traj, keys, order).groupBy(*keys).agg(F.sum("length").alias("length"), F.count("*").alias("n_segments"))


def number_frames(frames: DataFrame, keys: Sequence[str] = ("scene",), order: str = "frame_id", name: str = "seq") -> DataFrame:
    """Consecutive numbers (from 0) of accepted frames."""
    block = F.floor(F.col(order) / F.lit(ID_BLOCK)).cast("bigint")
    out = numbered(frames, keys, [order], block, name)
    return out.withColumn(name, F.col(name) - 1)


def stride(points: DataFrame, step: int = 100, key: str = "pt_id") -> DataFrame:
    """Every ``step``-th point."""
    return points.filter(F.pmod(F.col(key), F.lit(step)) == 0)


# Camera axes (x right, y down, z ahead) in the optical-to-body rotation.
CAMERA_TO_BODY = ((0.0, 0.0, 1.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0))


def roll_order(rolls: int) -> list[int]:
    """Indices (into the rolls-1 angles) of the poses added after an insertion frame.

    The camera sways: from the middle down to the first angle, up over the inner ones, and from the last down to the middle.
    With a single angle there is no middle, and only the last sweep is left.
    """
    last, middle = rolls - 2, (rolls - 1) // 2
    stop = last - middle if middle else -1
    return [*range(middle - 1, -1, -1), *range(1, last), *range(last, stop, -1)]


def augment_views(
    frames: DataFrame,
    interval: int,
    rolls: int,
    max_roll: float,
    level_rotation: Sequence[Sequence[float]] | None = None,
    keys: Sequence[str] = ("scene",),
    camera: Sequence[Sequence[float]] = CAMERA_TO_BODY,
) -> DataFrame:
    """After every ``interval``-th frame insert extra views, then renumber the frames.

    One roll inserts a copy with ``level_rotation``; more insert turned copies in a fixed order.
    Frame ids must count 0, 1, 2... per scene; ``source`` keeps the original id.
    """
    pose = F.col("pose")
    if rolls == 1:
        level = np.asarray(level_rotation, dtype=float)
        extra = [[[F.lit(float(level[r, c])) for c in range(3)] for r in range(3)]]
    else:
        cam = np.asarray(camera, dtype=float)
        step = max_roll / rolls
        extra = []
        for i in roll_order(rolls):
            angle = -step * (rolls - 1) / 2 + step * i
            turn = np.array(
                [[math.cos(angle), 0.0, math.sin(angle)], [0.0, 1.0, 0.0], [-math.sin(angle), 0.0, math.cos(angle)]]
            )
            m = cam.T @ turn @ cam
            extra.append(
                [
                    [G.dot([G.pose_at(pose, r, k) for k in range(3)], [F.lit(float(m[k, c])) for k in range(3)]) for c in range(3)]
                    for r in range(3)
                ]
            )
    views = [
        F.array(*[v for r in range(3) for v in (*rot[r], G.pose_at(pose, r, 3))], *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)])
        for rot in extra
    ]
    due = F.pmod(F.col("frame_id") + 1, F.lit(interval)) == 0
    all_views = F.when(due, F.array(pose, *views)).otherwise(F.array(pose))
    out = frames.select(*keys, F.col("frame_id").alias("source"), F.posexplode(all_views).alias("view", "pose"))
    # Ids are dense, so the new number follows from the old one without any sort.
    earlier = F.floor(F.col("source") / F.lit(interval)) * F.lit(len(views))
    return out.withColumn("frame_id", (F.col("source") + earlier + F.col("view")).cast("bigint"))
