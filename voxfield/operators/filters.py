"""Row filters whose exact inequality matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.functions import geometry as G


def depth_range(df: DataFrame, mode: str, low: float = 0.0, high: float = 0.0, depth: str = "depth") -> DataFrame:
    """F1, by the rules of each source.

    ``depth_file``: below low or above high (if high > 0) counts as no return, and returns are > 0;
    ``lidar_file``: >= low if low > 0, <= high if high > 0; ``depth_stream``: strictly between if both
    bounds are positive, else > 0; ``lidar_stream``: unfiltered.
    """
    d = F.col(depth)
    if mode == "depth_file":
        keep = (d > 0) & (d >= low)
        return df.filter(keep & (d <= high) if high > 0 else keep)
    if mode == "lidar_file":
        df = df.filter(d >= low) if low > 0 else df
        return df.filter(d <= high) if high > 0 else df
    if mode == "depth_stream":
        return df.filter((d > low) & (d < high)) if low > 0 and high > 0 else df.filter(d > 0)
    if mode == "lidar_stream":
        return df
    raise ValueError(f"unknown depth mode: {mode}")


def frame_range(df: DataFrame, start: int = 0, end: int = -1) -> DataFrame:
    """Frames [start, end); end -1 means all. A plain range, so it prunes files and row groups."""
    df = df.filter(F.col("frame_id") >= max(start, 0))
    return df if end < 0 else df.filter(F.col("frame_id") < end)


def valid_rays(rays: DataFrame, depth_min: float, depth_max: float, margin: float) -> DataFrame:
    """depth strictly inside (depth_min + margin, depth_max) and finite."""
    d = F.col("depth")
    return rays.filter((d > depth_min + margin) & (d < depth_max) & ~F.isnan(d) & (F.abs(d) < float("inf")))


def finite_poses(frames: DataFrame) -> DataFrame:
    """F2."""
    return frames.filter(G.finite_pose(F.col("pose")))


def sensor_inside(frames: DataFrame, low, high) -> DataFrame:
    """frames whose sensor stands inside the bounds."""
    return frames.filter(G.in_box(G.translation(F.col("pose")), low, high))


def crop_box(points: DataFrame, low, high) -> DataFrame:
    """F3."""
    return points.filter(G.in_box(G.vec("x", "y", "z"), low, high))


def crop_oriented_box(points: DataFrame, size, centre, wxyz) -> DataFrame:
    """F5 for points."""
    return points.filter(G.in_oriented_box(G.vec("x", "y", "z"), size, centre, wxyz))


def crop_triangles(triangles: DataFrame, size, centre, wxyz) -> DataFrame:
    """F5 for meshes (rows from :func:`voxfield.operators.mesh.triangle_corners`): all corners inside."""
    keep = F.lit(True)
    for c in "abc":
        keep = keep & G.in_oriented_box(G.vec(f"{c}x", f"{c}y", f"{c}z"), size, centre, wxyz)
    return triangles.filter(keep)


def region(sdf: Column, near_low: float, near_high: float, extent: float) -> Column:
    """``outlier`` beyond half the largest extent, ``near`` within [low, high], ``far`` above, else NULL."""
    return (
        F.when(F.abs(sdf) > 0.5 * extent, F.lit("outlier"))
        .when((sdf >= near_low) & (sdf <= near_high), F.lit("near"))
        .when(sdf > near_high, F.lit("far"))
    )


def remove_ceiling(triangles: DataFrame, thickness: float) -> DataFrame:
    """drop faces that reach into the top ``thickness`` metres. The only broadcast is one row."""
    top = F.greatest("az", "bz", "cz")
    limit = triangles.agg(F.max(top).alias("_top"))
    kept = triangles.join(F.broadcast(limit), top < F.col("_top") - F.lit(thickness))
    return kept.drop("_top")


def comparable_gradients(df: DataFrame, prediction: Column, truth: Column, angle: Column, limit: float) -> DataFrame:
    """both fields positive, then the angle below the outlier limit."""
    return df.filter((prediction > 0) & (truth > 0) & (angle < limit))


def proper_triangles(triangles: DataFrame) -> DataFrame:
    """no repeated vertex ids."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return triangles.filter((a != b) & (b != c) & (a != c))


def occupied_frames(frames: DataFrame, occupied: DataFrame, by: tuple[str, ...] = ("scene", "frame_id")) -> DataFrame:
    """frames for which at least one voxel passed the threshold."""
    return frames.join(occupied.select(*by).distinct(), list(by), "left_semi")
