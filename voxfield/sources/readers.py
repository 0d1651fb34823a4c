"""Trajectories, poses, depth images, raw sensor buffers and camera files."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.operators.asof import ID_BLOCK, numbered
from voxfield.operators.filters import depth_range, frame_range
from voxfield.sources import clouds
from voxfield.sources.chunks import text_lines

# Numbers per line of each trajectory kind.
TRAJECTORY_WIDTH = {"se3": 16, "se2": 9, "xyz": 3, "xy": 2}


def read_trajectory(spark: SparkSession, path: str, kind: str = "se3", strict: bool = True, skip_other: bool = False) -> DataFrame:
    """(frame_id, pose): one pose or point per line, frame id = line number (from 0).

    ``se3`` lines hold a row-major 4x4 matrix, ``se2`` a 3x3, ``xyz``/``xy`` points. ``skip_other`` drops
    blank lines and lines of another length and numbers the rest consecutively.
    """
    width = TRAJECTORY_WIDTH[kind]
    lines = text_lines(spark, path)
    words = F.filter(F.split(F.trim("value"), r"[\s,]+"), lambda w: w != "")
    rows = lines.select("path", F.col("line").alias("frame_id"), F.transform(words, lambda w: w.cast("double")).alias("pose"))
    if skip_other:
        rows = rows.filter(F.size("pose") == width)
        block = F.floor(F.col("frame_id") / F.lit(ID_BLOCK)).cast("bigint")
        rows = numbered(rows, ("path",), ("frame_id",), block, "_n")
        return rows.select("path", (F.col("_n") - 1).alias("frame_id"), "pose")
    rows = rows.filter(F.size("pose") > 0)
    if strict:
        bad = F.raise_error(F.concat(F.lit(f"expected {width} values in line "), F.col("frame_id")))
        rows = rows.withColumn("pose", F.when(F.size("pose") == width, F.col("pose")).otherwise(bad.cast("array<double>")))
    return rows


def read_pose_csv(spark: SparkSession, path: str) -> DataFrame:
    """(ts, t, x, y, z, qx, qy, qz, qw); ``#`` lines are comments, t = sec + nsec * 1e-9."""
    names = ["sec", "nsec", "x", "y", "z", "qx", "qy", "qz", "qw"]
    schema = ", ".join(f"{n} {'bigint' if n in ('sec', 'nsec') else 'double'}" for n in names)
    rows = spark.read.csv(path, schema=schema, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    ts = F.timestamp_micros(F.col("sec") * 1000000 + F.floor(F.col("nsec") / 1000))
    return rows.select(ts.alias("ts"), (F.col("sec") + F.col("nsec") / 1e9).alias("t"), *names[2:])


def poses_from_csv(rows: DataFrame) -> DataFrame:
    """Pose matrices of S2 rows."""
    return rows.withColumn("pose", G.quaternion_pose(G.vec("x", "y", "z"), G.vec("qx", "qy", "qz", "qw")))


def decode_png16(data: bytes) -> np.ndarray:
    """A 16-bit (or 8-bit) grayscale PNG without interlacing as an (H, W) array."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG image")
    at, body, head = 8, b"", None
    while at < len(data):
        size, name = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = part
        elif name == b"IDAT":
            body += part
        at += size + 12
    w, h, bits, color, _, _, interlace = np.frombuffer(head, ">u4,>u4,u1,u1,u1,u1,u1")[0]
    if color != 0 or bits not in (8, 16) or interlace:
        raise ValueError("expected a plain grayscale image")
    step = int(bits) // 8
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(int(h), int(w) * step + 1)
    out = np.zeros((int(h), int(w) * step), np.uint8)
    prior = np.zeros(int(w) * step, np.uint8)
    for y in range(int(h)):
        kind, line = raw[y, 0], raw[y, 1:]
        if kind == 0:
            row = line.copy()
        elif kind == 1:
            row = np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint64).astype(np.uint8).ravel()
        elif kind == 2:
            row = line + prior
        else:
            row = _png_row(int(kind), line, prior, step)
        out[y] = prior = row
    return out.view(">u2").astype(np.uint16) if step == 2 else out


def _png_row(kind: int, line: np.ndarray, prior: np.ndarray, step: int) -> np.ndarray:
    """Average (3) and Paeth (4) rows depend on the value to the left and go value by value."""
    row, up, diff = [0] * len(line), prior.tolist(), line.tolist()
    for i, d in enumerate(diff):
        a = row[i - step] if i >= step else 0
        b, c = up[i], up[i - step] if i >= step else 0
        if kind == 3:
            guess = (a + b) // 2
        else:
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        row[i] = (d + guess) & 255
    return np.array(row, np.uint8)


def _pixels(frame: int, image: np.ndarray) -> pd.DataFrame:
    v, u = np.divmod(np.arange(image.size), image.shape[1])
    return pd.DataFrame({"frame_id": frame, "u": u.astype(np.int32), "v": v.astype(np.int32), "depth": image.ravel().astype(float)})


PIXELS = "frame_id bigint, u int, v int, depth double"


def read_depth_images(spark: SparkSession, path: str, scale: float = 6553.5, glob: str = "depth*.png", pattern: str = r"(\d+)\.\w+$") -> DataFrame:
    """(frame_id, u, v, depth) in metres from 16-bit images, one frame per file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    files = files.select(F.regexp_extract("path", pattern, 1).cast("bigint").alias("frame_id"), "content")

    def read(batches):
        for pdf in batches:
            for frame, data in zip(pdf["frame_id"], pdf["content"]):
                yield _pixels(frame, decode_png16(data) / scale)

    return files.mapInPandas(read, PIXELS)


# Pixel types of the raw depth encodings.
ENCODINGS = {"8UC1": "u1", "mono8": "u1", "16UC1": "u2", "mono16": "u2", "32FC1": "f4", "64FC1": "f8"}


def decode_depth(frames: DataFrame, depth_scale: float = 1.0) -> DataFrame:
    """Raw depth buffers (frame_id, encoding, is_bigendian, height, width, data) to pixels, times the scale.

    An unknown encoding is an error.
    """

    def read(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                if r.encoding not in ENCODINGS:
                    raise ValueError(f"unsupported depth encoding: {r.encoding}")
                kind = np.dtype((">" if r.is_bigendian else "<") + ENCODINGS[r.encoding])
                image = np.frombuffer(r.data, kind).reshape(r.height, r.width)
                yield _pixels(r.frame_id, image.astype(float) * depth_scale)

    cols = ["frame_id", "encoding", "is_bigendian", "height", "width", "data"]
    return frames.select(*cols).mapInPandas(read, PIXELS)


def decode_cloud(frames: DataFrame) -> DataFrame:
    """Packed clouds (frame_id, point_step, data) to points: the first three float32 of every record."""

    def read(batches):
        for pdf in batches:
            for frame, step, data in zip(pdf["frame_id"], pdf["point_step"], pdf["data"]):
                rows = np.frombuffer(data, np.float32).reshape(-1, int(step) // 4)[:, :3].astype(float)
                yield pd.DataFrame({"frame_id": frame, "pt_id": np.arange(len(rows)), "x": rows[:, 0], "y": rows[:, 1], "z": rows[:, 2]})

    return frames.select("frame_id", "point_step", "data").mapInPandas(read, "frame_id bigint, pt_id bigint, x double, y double, z double")


def read_camera(spark: SparkSession, path: str) -> DataFrame:
    """(fx, fy, cx, cy, scale, w, h) from the ``camera`` object of a JSON file."""
    schema = "camera struct<fx: double, fy: double, cx: double, cy: double, scale: double, w: int, h: int>"
    return spark.read.json(path, schema=schema, multiLine=True).select("camera.*")


# -- S10: datasets by name -----------------------------------------------------------------------

_DATASETS: dict[str, Callable[..., tuple[DataFrame, DataFrame]]] = {}


def register_dataset(name: str):
    """Register ``fn(spark, **args) -> (frames, points)`` under a name (V4)."""

    def keep(fn):
        _DATASETS[name] = fn
        return fn

    return keep


def get_dataset(spark: SparkSession, name: str, **args) -> tuple[DataFrame, DataFrame]:
    if name not in _DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(_DATASETS)}")
    return _DATASETS[name](spark, **args)


@register_dataset("depth_scene")
def depth_scene(spark, path, scene="scene", low=0.0, high=0.0, start=0, end=-1, fx=600.0, fy=600.0, cx=599.5, cy=339.5, scale=6553.5):
    """An indoor scene folder: ``traj.txt`` and ``results/depth%06d.png``."""
    poses = frame_range(read_trajectory(spark, f"{path}/traj.txt"), start, end)
    px = frame_range(read_depth_images(spark, f"{path}/results", scale), start, end)
    px = depth_range(px, "depth_file", low, high)
    ray = G.pixel_ray(F.col("u"), F.col("v"), fx, fy, cx, cy)
    at = [c.alias(a) for a, c in zip("xyz", G.back_project(ray, F.col("depth")))]
    frames = poses.select(F.lit(scene).alias("scene"), "frame_id", "pose")
    return frames, px.select(F.lit(scene).alias("scene"), "frame_id", *at, "depth")


@register_dataset("lidar_sequence")
def lidar_sequence(spark, path, scene="scene", low=0.0, high=0.0, start=0, end=-1):
    """An outdoor folder: ``traj.txt`` and ``ply/%04d.ply``."""
    poses = frame_range(read_trajectory(spark, f"{path}/traj.txt"), start, end)
    points = frame_range(clouds.read_scans(spark, f"{path}/ply"), start, end)
    points = points.withColumn("depth", G.norm(G.vec("x", "y", "z")))
    points = depth_range(points, "lidar_file", low, high)
    frames = poses.select(F.lit(scene).alias("scene"), "frame_id", "pose")
    return frames, points.select(F.lit(scene).alias("scene"), "frame_id", "x", "y", "z", "depth")
