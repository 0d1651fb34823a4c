"""Random and quota-driven selection of points, rays and frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from voxfield.functions import geometry as G
from voxfield.functions.hashing import hash32, uniform
from voxfield.operators.asof import numbered
from voxfield.session import cut

SHUFFLE_BITS = 10  # 1024 hash blocks per group


def _block(draw: Column) -> Column:
    return F.shiftright(draw, 32 - SHUFFLE_BITS)


def _group(df: DataFrame, by: Sequence[str]) -> Column:
    """A number of the row's group, so that ids which repeat in every group are drawn anew in each."""
    values = [F.col(name) if isinstance(df.schema[name].dataType, IntegralType) else F.crc32(F.col(name).cast("string")) for name in by]
    if not values:
        return F.lit(0).cast("bigint")
    # A fold, so that the hash of each column is written once, whatever their number.
    step = lambda out, value: hash32(value, out).bitwiseAND(F.lit(2147483647))
    return F.aggregate(F.array(*[v.cast("bigint") for v in values]), F.lit(0).cast("bigint"), step)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once per row, however often it is used."""
    return F.transform(F.array(value), then)[0]


def take_random(df: DataFrame, k: int | str, by: Sequence[str] = (), key: str = "pt_id", ratio: float = 1.0, seed: int = 0) -> DataFrame:
    """K rows per group without replacement; int(total * ratio) rows if k <= 0; all if fewer. ``k`` may name a column
    that holds each group's own number.

    Rows are ranked by a hash of ``key`` and the group. Block counts come first, so that only rows of the blocks that can
    hold the k smallest hashes are shuffled, and no group, however large, is sorted in one task.
    """
    draw = _let(_group(df, by), lambda group: hash32(F.col(key), group, seed))
    rows = df.withColumn("_draw", draw).withColumn("_block", _block(F.col("_draw")))
    asked = [F.max(k).alias("_k")] if isinstance(k, str) else []
    counts = rows.groupBy(*by, "_block").agg(F.count("*").alias("_n"), *asked)
    run = Window.partitionBy(*by).orderBy("_block") if by else Window.orderBy("_block")
    whole = Window.partitionBy(*by) if by else Window.partitionBy()
    counts = counts.withColumn("_before", F.sum("_n").over(run) - F.col("_n"))
    if isinstance(k, str):
        want = F.max("_k").over(whole)
    else:
        want = F.lit(k) if k > 0 else F.floor(F.sum("_n").over(whole) * F.lit(float(ratio))).cast("bigint")
    counts = counts.withColumn("_k", want).filter(F.col("_before") < F.col("_k")).drop("_n")
    near = rows.join(counts, [*by, "_block"])
    rank = F.row_number().over(Window.partitionBy(*by, "_block").orderBy("_draw", key))
    near = near.withColumn("_rank", rank + F.col("_before"))
    return near.filter(F.col("_rank") <= F.col("_k")).select(*df.columns)


def draw_rays(pixels: DataFrame, k: int, by: Sequence[str] = ("frame_id",), key: str = "pt_id", seed: int = 0) -> DataFrame:
    """K pixels per frame with replacement: adds the draw number ``j``.

    Draws are (frame, j, index) rows that meet the numbered pixels on (frame, index).
    """
    hashed = pixels.withColumn("_draw", _let(_group(pixels, by), lambda group: hash32(F.col(key), group, seed)))
    rows = numbered(hashed, by, ("_draw", key), _block(F.col("_draw")), "_i").drop("_draw")
    sizes = pixels.groupBy(*by).agg(F.count("*").alias("_n"))
    draws = sizes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    pick = _let(_group(sizes, by), lambda group: F.floor(uniform(group, F.col("j") + 1, seed) * F.col("_n")).cast("bigint") + 1)
    return draws.withColumn("_i", pick).drop("_n").join(rows, [*by, "_i"]).drop("_i")


def split_quota(selected: DataFrame, n: int, inverse: bool = False, count: str = "samples", order: str = "frame_id") -> DataFrame:
    """T5: share n samples among the selected frames: adds ``quota``.

    Uniform: equal shares, the remainder to the first frames. Inverse: the less a frame was sampled the more
    it gets, at least 1, then +-1 in turn until the shares add up to n (never below 1).
    """
    # The rows are the frames of one selection window, a handful by definition.
    rows = selected.withColumn("_i", F.row_number().over(Window.orderBy(order)) - 1)
    totals = selected.agg(F.count("*").alias("_m"), F.sum(count).alias("_t"))
    rows = rows.join(F.broadcast(totals))
    i, m, t = F.col("_i"), F.col("_m"), F.coalesce(F.col("_t"), F.lit(0))
    even = F.floor(F.lit(n) / m) + F.when(i < F.pmod(F.lit(n), m), 1).otherwise(0)
    if not inverse:
        return rows.withColumn("quota", even.cast("bigint")).drop("_i", "_m", "_t")
    raw = F.try_divide(F.lit(n) * (t - F.col(count)), t * (m - 1))
    rows = rows.withColumn("_base", F.greatest(F.lit(1), F.floor(raw)).cast("bigint"))
    off = F.lit(n) - F.sum("_base").over(Window.partitionBy())
    rows = rows.withColumn("_off", off)
    size = F.abs("_off")
    turns = F.floor(size / m) + F.when(i < F.pmod(size, m), 1).otherwise(0)
    fixed = F.when(F.col("_off") >= 0, F.col("_base") + turns).otherwise(F.greatest(F.lit(1), F.col("_base") - turns))
    quota = F.when(t == 0, even).when(m == 1, F.lit(n)).otherwise(fixed)
    return rows.withColumn("quota", quota.cast("bigint")).drop("_i", "_m", "_t", "_base", "_off")


def initial_count(selected: DataFrame, count: str = "samples") -> DataFrame:
    """T5: starting sample count of a new frame, sum // (frames + 2), as one row ``initial``."""
    total = F.coalesce(F.sum(count), F.lit(0))
    return selected.agg(F.floor(total / (F.count("*") + 2)).cast("bigint").alias("initial"))


def farthest_points(points: DataFrame, k: int, res: float, key: str = "pt_id") -> DataFrame:
    """K points spread far apart: (step, key, x, y, z), starting at the smallest key.

    Every step scans one representative (smallest key) per ``res`` cell, keeps each one's distance to the
    chosen set, and takes the farthest; res <= 0 uses every point (exact).
    """
    if res > 0:
        cell = [F.floor(F.col(a) / F.lit(res)) for a in "xyz"]
        points = points.groupBy(*[c.alias(f"_{a}") for a, c in zip("xyz", cell)]).agg(
            F.min(F.struct(key, "x", "y", "z")).alias("_p")
        ).select("_p.*")
    pool = cut(points.select(key, "x", "y", "z", F.lit(float("inf")).alias("_d")))
    chosen = []
    for step in range(k):
        best = pool.orderBy(F.col("_d").desc(), key).limit(1).collect()
        if not best or (step and best[0]["_d"] == 0.0):
            break
        row = best[0]
        chosen.append((step, row[key], row["x"], row["y"], row["z"]))
        diff = [F.col(a) - F.lit(float(row[a])) for a in "xyz"]
        pool = pool.withColumn("_d", F.least(F.col("_d"), G.dot(diff, diff)))
        if step % 16 == 15:
            pool = cut(pool)
    return points.sparkSession.createDataFrame(chosen, f"step int, {key} bigint, x double, y double, z double")
