"""Sinks: grids, test sets, metrics, meshes, trajectories, snapshots and published maps."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.operators.grids import odd_cells


def write_grid(grid: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Sparse grid rows, clustered by index so that later box reads skip row groups."""
    grid.repartitionByRange("i").sortWithinPartitions("i", "j", "k").write.mode(mode).parquet(path)


def write_test_set(grid: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Grid points with truth and ``region``, one folder per region."""
    grid.write.mode(mode).partitionBy("region").parquet(path)


def metrics_row(metrics: DataFrame, subject: str = "subject") -> DataFrame:
    """Long metrics (subject, field, region, metric, value) as one row per subject, names joined by dots."""
    name = F.concat_ws(".", "field", "region", "metric")
    return metrics.select(subject, name.alias("name"), "value").groupBy(subject).pivot("name").agg(F.first("value"))


def write_metrics(metrics: DataFrame, path: str, subject: str = "subject", mode: str = "overwrite") -> None:
    metrics_row(metrics, subject).write.mode(mode).csv(path, header=True)


def write_mesh(vertices: DataFrame, triangles: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S15."""
    vertices.write.mode(mode).parquet(f"{path}/vertices")
    triangles.write.mode(mode).parquet(f"{path}/triangles")


def write_points(points: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S15."""
    points.write.mode(mode).parquet(path)


def write_trajectory(frames: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One line of 16 space-separated numbers per frame; part files follow the frame order."""
    line = F.concat_ws(" ", F.transform("pose", lambda v: v.cast("string")))
    frames.orderBy("frame_id").select(line.alias("value")).write.mode(mode).text(path)


# -- S17: snapshots ------------------------------------------------------------------------------


def save_snapshot(
    path: str, epoch: int, vertices: DataFrame, voxels: DataFrame, layers: Sequence[tuple[np.ndarray, np.ndarray]] | None = None
) -> None:
    """Vertices, voxels and network weights of one epoch; a marker file is written last, so a reader
    never sees half a snapshot."""
    spark = vertices.sparkSession
    home = f"{path}/epoch={epoch:06d}"
    vertices.write.mode("overwrite").parquet(f"{home}/vertices")
    voxels.write.mode("overwrite").parquet(f"{home}/voxels")
    weights = json.dumps([[np.asarray(w).tolist(), np.asarray(b).tolist()] for w, b in layers or []])
    spark.createDataFrame([(epoch, weights)], "epoch int, weights string").write.mode("overwrite").json(f"{home}/done")


def due(epoch: int, interval: int, last: bool = False) -> bool:
    """Save every ``interval`` epochs and at the end."""
    return last or (interval > 0 and epoch % interval == 0)


def latest_epoch(spark: SparkSession, path: str) -> int | None:
    """Newest complete snapshot."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/done/_SUCCESS")
    found = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop)
    epochs = [int(str(s.getPath()).split("epoch=")[1].split("/")[0]) for s in found or []]
    return max(epochs, default=None)


def load_snapshot(spark: SparkSession, path: str, epoch: int | None = None):
    """(epoch, vertices, voxels, layers) of the given or newest complete epoch."""
    epoch = latest_epoch(spark, path) if epoch is None else epoch
    if epoch is None:
        raise ValueError(f"no complete snapshot under {path}")
    home = f"{path}/epoch={epoch:06d}"
    raw = json.loads(spark.read.json(f"{home}/done", schema="epoch int, weights string").first()["weights"])
    layers = [(np.array(w), np.array(b)) for w, b in raw] or None
    return epoch, spark.read.parquet(f"{home}/vertices"), spark.read.parquet(f"{home}/voxels"), layers


def append_losses(report: DataFrame, step: int, path: str) -> None:
    """(step, term, value) rows of a one-row loss report."""
    items = F.array(*[F.struct(F.lit(c).alias("term"), F.col(c).cast("double").alias("value")) for c in report.columns])
    long = report.select(F.lit(step).alias("step"), F.explode(items).alias("_i")).select("step", "_i.*")
    long.write.mode("append").parquet(path)


# -- S19, S20: published maps --------------------------------------------------------------------


def grid_map(plane: DataFrame, x_cells: int, y_cells: int, res: float, gradient: bool = True) -> DataFrame:
    """One row (resolution, length_x, length_y, layers map) of a queried plane (G3 order by ``cell``).

    Layers are sdf and, if wanted, gradient_x/y/z. The row is dropped if the plane does not have every cell;
    its size is that of the published message.
    """
    nx, ny = odd_cells(x_cells), odd_cells(y_cells)
    names = {"sdf": "sdf", **({f"gradient_{a}": f"grad_{a}" for a in "xyz"} if gradient else {})}
    layer = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("cell", F.col(c).alias("v")))), lambda s: s["v"])
    row = plane.agg(F.count("*").alias("_n"), *[layer(c).alias(n) for n, c in names.items()]).filter(F.col("_n") == nx * ny)
    layers = F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])
    return row.select(F.lit(res).alias("resolution"), F.lit(nx * res).alias("length_x"), F.lit(ny * res).alias("length_y"), layers.alias("layers"))


def field_cloud(queried: DataFrame) -> DataFrame:
    """X, y, z, sdf (and gradient) without rows that are not finite."""
    cols = [c for c in ("x", "y", "z", "sdf", "grad_x", "grad_y", "grad_z") if c in queried.columns]
    out = queried.select(*cols)
    for c in cols:
        out = out.filter(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return out
