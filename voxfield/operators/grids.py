"""Regular grids: volumes, slices, sensor planes and mask growth."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.functions import geometry as G


def steps(low: float, high: float, res: float) -> int:
    """Entries of arange(low, high, res): the upper end is excluded."""
    return max(0, math.ceil((high - low) / res))


def grid_3d(spark: SparkSession, low: Sequence[float], high: Sequence[float], res: float) -> DataFrame:
    """G1: (i, j, k, x, y, z), k running fastest. Rows are made in parallel, none on the driver."""
    nx, ny, nz = [steps(l, h, res) for l, h in zip(low, high)]
    cells = spark.range(nx * ny * nz)
    i = F.floor(F.col("id") / F.lit(max(ny * nz, 1))).cast("int")
    j = F.pmod(F.floor(F.col("id") / F.lit(max(nz, 1))), F.lit(max(ny, 1))).cast("int")
    k = F.pmod(F.col("id"), F.lit(max(nz, 1))).cast("int")
    at = [(F.lit(float(l)) + n * F.lit(float(res))).alias(a) for a, l, n in zip("xyz", low, (i, j, k))]
    return cells.select(i.alias("i"), j.alias("j"), k.alias("k"), *at)


def slice_grid(
    spark: SparkSession, low: Sequence[float], high: Sequence[float], res: float, axis: int, position: float | None = None
) -> DataFrame:
    """A plane across ``axis`` at ``position`` (default the box centre): (i, j, x, y, z)."""
    at = (low[axis] + high[axis]) / 2.0 if position is None else position
    u, v = [a for a in range(3) if a != axis]
    nu, nv = steps(low[u], high[u], res), steps(low[v], high[v], res)
    rows = spark.range(nu * nv)
    i = F.floor(F.col("id") / F.lit(max(nv, 1))).cast("int")
    j = F.pmod(F.col("id"), F.lit(max(nv, 1))).cast("int")
    coords: list[Column] = [F.lit(float(at))] * 3
    coords[u] = F.lit(float(low[u])) + i * F.lit(float(res))
    coords[v] = F.lit(float(low[v])) + j * F.lit(float(res))
    return rows.select(i.alias("i"), j.alias("j"), *[c.alias(a) for a, c in zip("xyz", coords)])


def odd_cells(cells: int) -> int:
    return cells if cells % 2 else cells + 1


def sensor_plane(
    spark: SparkSession, x_cells: int, y_cells: int, res: float, centre: Sequence[float] = (0.0, 0.0, 0.0), pose: Sequence[float] | None = None
) -> DataFrame:
    """Query plane around a sensor: (cell, x, y, z). Cell counts are made odd; x runs fastest, both axes
    from high to low; ``pose`` (16 values) moves the plane with the sensor."""
    nx, ny = odd_cells(x_cells), odd_cells(y_cells)
    rows = spark.range(nx * ny).withColumnRenamed("id", "cell")
    col = F.pmod(F.col("cell"), F.lit(nx))
    row = F.floor(F.col("cell") / F.lit(nx))
    x = F.lit(float(centre[0])) + (F.lit(nx // 2) - col) * F.lit(float(res))
    y = F.lit(float(centre[1])) + (F.lit(ny // 2) - row) * F.lit(float(res))
    p = [x, y, F.lit(float(centre[2]))]
    if pose is not None:
        p = G.to_world(F.array(*[F.lit(float(v)) for v in pose]), p)
    return rows.select("cell", *[c.alias(a) for a, c in zip("xyz", p)])


def dilate(mask: DataFrame, shape: Sequence[int], iterations: int = 1, cols: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Grow a set of grid cells by one cell in all 26 directions, ``iterations`` times.

    Growing by n cells is a box of 2n+1, which splits by axis: three small explodes with a distinct in
    between instead of n times 27 copies.
    """
    out = mask.select(*cols).distinct()
    for c, n in zip(cols, shape):
        span = F.sequence(F.greatest(F.col(c) - iterations, F.lit(0)), F.least(F.col(c) + iterations, F.lit(n - 1)))
        out = out.withColumn(c, F.explode(span)).distinct()
    return out
