"""Scores: field errors, gradient angles, surface metrics, summaries, histograms and losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.session import cut


def masked_mean(value: Column, mask: Column | None = None) -> Column:
    """sum(v*m) / max(sum(m), 1); the plain mean without a mask."""
    if mask is None:
        return F.avg(value)
    m = F.when(mask, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.sum(F.when(mask, value).otherwise(F.lit(0.0))) / F.greatest(F.sum(m), F.lit(1.0))


def sdf_errors(joined: DataFrame, fields: Sequence[str], truth: str = "truth", absolute: bool = False) -> DataFrame:
    """MAE and RMSE per field and region; region ``all`` is near or far (outliers have no region).

    ``joined`` is J21: predictions and ``truth`` by grid point with a ``region`` column (F9).
    """
    gt = F.abs(truth) if absolute else F.col(truth)
    kept = joined.filter(F.col("region").isin("near", "far"))
    items = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) - gt).alias("e")) for f in fields])
    long = kept.select("region", F.explode(items).alias("_i")).select("region", "_i.*").filter(F.col("e").isNotNull())
    # One pass over the finest groups; "all" is rolled up from two rows per field.
    fine = long.groupBy("field", "region").agg(
        F.count("*").alias("n"), F.sum(F.abs("e")).alias("_a"), F.sum(F.col("e") * F.col("e")).alias("_s")
    )
    names = F.explode(F.array(F.col("region"), F.lit("all")))
    rolled = fine.withColumn("region", names).groupBy("field", "region").agg(*[F.sum(c).alias(c) for c in ("n", "_a", "_s")])
    return rolled.select("field", "region", "n", (F.col("_a") / F.col("n")).alias("mae"), F.sqrt(F.col("_s") / F.col("n")).alias("rmse"))


def gradient_errors(joined: DataFrame) -> DataFrame:
    """A10: mean angle per field and region of rows (field, region, angle) that passed F14."""
    fine = joined.filter(F.col("region").isin("near", "far")).groupBy("field", "region").agg(
        F.count("*").alias("n"), F.sum("angle").alias("_a")
    )
    rolled = fine.withColumn("region", F.explode(F.array(F.col("region"), F.lit("all"))))
    rolled = rolled.groupBy("field", "region").agg(F.sum("n").alias("n"), F.sum("_a").alias("_a"))
    return rolled.select("field", "region", "n", (F.col("_a") / F.col("n")).alias("angle"))


def surface_metrics(distances: DataFrame, threshold: float) -> DataFrame:
    """A11 over J12 rows: side ``a_to_b`` is prediction to truth, ``b_to_a`` truth to prediction."""
    pred, true = F.col("side") == "a_to_b", F.col("side") == "b_to_a"
    share = lambda side: F.avg(F.when(side, F.when(F.col("dist") < threshold, 1.0).otherwise(0.0)))
    out = distances.agg(
        F.avg(F.when(pred, F.col("dist"))).alias("accuracy"),
        F.avg(F.when(true, F.col("dist"))).alias("completion"),
        share(pred).alias("precision"),
        share(true).alias("recall"),
    )
    both = F.col("precision") + F.col("recall")
    return out.select(
        "accuracy",
        "completion",
        ((F.col("accuracy") + F.col("completion")) / 2.0).alias("chamfer"),
        F.col("recall").alias("completion_ratio"),
        "precision",
        "recall",
        F.coalesce(F.try_divide(2.0 * F.col("precision") * F.col("recall"), both), F.lit(0.0)).alias("f1"),
    )


def exact_median(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Exact median per group (the mean of the two middle values), without sorting or collecting a group.

    Each pass counts the values of the current range in 1024 bins and keeps the bin that holds the middle
    rank; the range shrinks to a single value in a few passes whatever the distribution. NaN and NULL do not count,
    infinities do.
    """
    keys = list(by) or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    # Every pass reads these two columns again, not the plan behind them.
    rows = cut(rows.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v")))
    state = rows.groupBy(*keys).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count("*").alias("n"))
    n = F.col("n")
    ranks = F.array(*[F.struct(F.lit(i).alias("half"), F.floor(r / F.lit(2)).cast("bigint").alias("k")) for i, r in ((0, n - 1), (1, n))])
    state = cut(state.select(*keys, "lo", "hi", F.explode(ranks).alias("_r")).select(*keys, "lo", "hi", "_r.*"))
    settled = state.filter("lo = hi")
    while True:
        wide = state.filter("lo < hi")
        if wide.isEmpty():
            break
        inside = rows.join(wide, keys).filter(F.col("_v").between(F.col("lo"), F.col("hi")))
        v, lo, hi, inf = F.col("_v"), F.col("lo"), F.col("hi"), F.lit(float("inf"))
        # Infinite values get the outer bins; a range wider than a double is measured in halves.
        at = F.when((lo == -inf) | (hi == inf), F.when(v == -inf, 0).when(v == inf, 1023).otherwise(512))
        at = at.when(hi - lo == inf, F.floor((v / 2 - lo / 2) / (hi / 2 - lo / 2) * 1024))
        at = at.otherwise(F.floor((v - lo) / (hi - lo) * 1024))
        bins = inside.groupBy(*keys, "half", "k", F.least(at, F.lit(1023)).alias("bin")).agg(
            F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi")
        )
        run = F.sum("c").over(Window.partitionBy(*keys, "half").orderBy("bin"))
        bins = bins.withColumn("_to", run).withColumn("_from", F.col("_to") - F.col("c"))
        hit = bins.filter((F.col("_from") <= F.col("k")) & (F.col("k") < F.col("_to")))
        state = cut(hit.select(*keys, "lo", "hi", "half", (F.col("k") - F.col("_from")).alias("k")))
        settled = settled.unionByName(state.filter("lo = hi"))
    return settled.groupBy(*keys).agg(F.avg("lo").alias("median")).drop("_all")


def error_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Min, max, mean, median and population standard deviation."""
    v = F.col(value)
    stats = df.groupBy(*by).agg(
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("n")
    )
    median = exact_median(df, value, by)
    if by:
        return stats.join(median, list(by))
    # Both sides are one row.
    return stats.withColumn("_k", F.lit(0)).join(median.withColumn("_k", F.lit(0)), "_k").drop("_k")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Counts in equal bins from the minimum to the maximum (the last bin includes it): (bin, low, high, n)."""
    row = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    lo, hi = row["lo"], row["hi"]
    if lo is None:
        lo, hi = 0.0, 0.0
    width = (float(hi) - float(lo)) / bins
    at = F.least(F.floor((F.col(value) - F.lit(float(lo))) / F.lit(width or 1.0)), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return counted.select(
        "bin", (F.lit(float(lo)) + F.col("bin") * F.lit(width)).alias("low"), (F.lit(float(lo)) + (F.col("bin") + 1) * F.lit(width)).alias("high"), "n"
    )


def region_counts(df: DataFrame) -> DataFrame:
    """Near, far and total rows."""
    count = lambda r: F.sum(F.when(F.col("region") == r, 1).otherwise(0))
    return df.agg(count("near").alias("near"), count("far").alias("far"), F.count("*").alias("total"))


def join_truth(prediction: DataFrame, truth: DataFrame, on: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """J21."""
    return prediction.join(truth, list(on))
