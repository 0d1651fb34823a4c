"""Key frames: overlap, coverage, selection.

``frame_voxels`` is the long table (scene, frame_id, node) of the voxels each frame saw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxfield.operators.asof import ID_BLOCK, asof_bracket, numbered
from voxfield.session import cut


def seen_counts(frame_voxels: DataFrame, by: Sequence[str] = ("scene", "frame_id")) -> DataFrame:
    """A5: voxels seen per frame."""
    return frame_voxels.groupBy(*by).agg(F.count("*").alias("n"))


def pair_iou(pairs: DataFrame, frame_voxels: DataFrame, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """Intersection over union of the given frame pairs (f1, f2). Only the asked pairs are formed."""
    one = frame_voxels.select(*keys, F.col("frame_id").alias("f1"), "node")
    two = frame_voxels.select(*keys, F.col("frame_id").alias("f2"), "node")
    met = pairs.select(*keys, "f1", "f2").join(one, [*keys, "f1"]).join(two, [*keys, "f2", "node"])
    common = met.groupBy(*keys, "f1", "f2").agg(F.count("*").alias("common"))
    n = seen_counts(frame_voxels, (*keys, "frame_id"))
    out = pairs.join(common, [*keys, "f1", "f2"], "left")
    for f in ("f1", "f2"):
        out = out.join(n.select(*keys, F.col("frame_id").alias(f), F.col("n").alias(f"n_{f}")), [*keys, f])
    inter = F.coalesce("common", F.lit(0))
    iou = inter / (F.col("n_f1") + F.col("n_f2") - inter)
    return out.select(*keys, "f1", "f2", inter.alias("common"), iou.alias("iou"))


def coverage_gain(frame_voxels: DataFrame, open_voxels: DataFrame, by: Sequence[str] = ("scene", "frame_id")) -> DataFrame:
    """Voxels of each frame that are still uncovered."""
    return seen_counts(frame_voxels.join(open_voxels.select("node").distinct(), "node", "left_semi"), by)


def follow(nexts: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All positions reached from ``starts`` (keys, f) by repeated steps of ``nexts`` (keys, f, nxt).

    Steps are doubled each round, so a chain of n links takes log2(n) rounds and no chain is walked in a task.
    """
    reached = cut(starts.select(*keys, "f"))
    jump = cut(nexts.select(*keys, "f", "nxt"))
    while True:
        ahead = reached.join(jump, [*keys, "f"]).select(*keys, F.col("nxt").alias("f"))
        reached = cut(reached.unionByName(ahead).distinct())
        second = jump.select(*keys, F.col("f").alias("nxt"), F.col("nxt").alias("_to"))
        jump = cut(jump.join(second, [*keys, "nxt"]).select(*keys, "f", F.col("_to").alias("nxt")))
        if jump.isEmpty():
            return reached


def interval_key_frames(frames: DataFrame, interval: int, keys: Sequence[str] = ("scene",)) -> DataFrame:
    """The first frame, then every first frame at least ``interval`` after the last key frame."""
    ids = frames.select(*keys, F.col("frame_id").alias("t")).distinct()
    wanted = ids.select(*keys, F.col("t").alias("f"), (F.col("t") + interval).alias("t"))
    nexts = asof_bracket(wanted, ids, keys, "t", (), ID_BLOCK).filter(F.col("next").isNotNull())
    nexts = nexts.select(*keys, "f", F.col("next.t").alias("nxt"))
    starts = ids.groupBy(*keys).agg(F.min("t").alias("f"))
    return follow(nexts, starts, keys).withColumnRenamed("f", "frame_id")


def iou_key_frames(frame_voxels: DataFrame, ratio: float, keys: Sequence[str] = ("scene",), width: int = 32) -> DataFrame:
    """The first frame, then every frame whose IoU with the last key frame is below ``ratio``.

    For all frames at once the next key frame within its own and the following block of ``width`` frames is
    found from the pairs that are still similar; the chain from the first frame is then followed by doubling.
    A chain that stops at a frame whose whole horizon is similar is carried on by widening that one frame's
    horizon, so long still stretches cost no more pairs than frames. Voxels meet as words: the 64 codes that differ
    in their last 6 bits are one row with a bit per voxel, so pairs of frames make a row per shared word.
    """
    sets = cut(frame_voxels.select(*keys, "frame_id", "node").distinct())
    sizes = sets.groupBy(*keys, "frame_id").agg(F.count("*").alias("n"))
    block = F.floor(F.col("frame_id") / F.lit(ID_BLOCK)).cast("bigint")
    frames = numbered(sizes, keys, ("frame_id",), block, "f")
    frames = cut(frames)
    sets = sets.join(frames.select(*keys, "frame_id", "f"), [*keys, "frame_id"])
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("node").bitwiseAND(F.lit(63)).cast("int"))
    words = cut(sets.groupBy(*keys, "f", F.shiftright("node", 6).alias("word")).agg(F.bit_or(bit).alias("bits")))
    last = frames.groupBy(*keys).agg(F.max("f").alias("last"))
    n_of = lambda name, at: frames.select(*keys, F.col("f").alias(at), F.col("n").alias(name))
    blk = lambda c: F.floor((F.col(c) - 1) / F.lit(width)).cast("bigint")

    def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """Number of common voxels of the pairs (f, g) that have any."""
        both = F.col("bits").bitwiseAND(F.col("bits2"))
        pairs = left.join(right.withColumnRenamed("bits", "bits2"), on).filter((F.col("g") > F.col("f")) & (both != 0))
        return pairs.groupBy(*keys, "f", "g").agg(F.sum(F.bit_count(both)).alias("c"))

    def similar(common: DataFrame) -> DataFrame:
        """Pairs (f, g) at or above the ratio from counts of common voxels."""
        both = common.join(n_of("nf", "f"), [*keys, "f"]).join(n_of("ng", "g"), [*keys, "g"])
        return both.filter(F.col("c") / (F.col("nf") + F.col("ng") - F.col("c")) >= ratio).select(*keys, "f", "g")

    def first_gap(asked: DataFrame, same: DataFrame, start: str, end: str) -> DataFrame:
        """For asked (keys, f, start, end): the first g in (start, end] that is not similar, or NULL."""
        run = Window.partitionBy(*keys, "f").orderBy("g")
        run = same.join(asked, [*keys, "f"]).withColumn("_r", F.row_number().over(run))
        run = run.filter(F.col("g") == F.col(start) + F.col("_r")).groupBy(*keys, "f").agg(F.count("*").alias("_n"))
        out = asked.join(run, [*keys, "f"], "left")
        nxt = F.col(start) + 1 + F.coalesce("_n", F.lit(0))
        return out.withColumn("nxt", F.when(nxt <= F.col(end), nxt)).drop("_n")

    left = words.select(*keys, "f", "word", "bits", F.explode(F.array(blk("f"), blk("f") + 1)).alias("_b"))
    right = words.select(*keys, F.col("f").alias("g"), "word", "bits", blk("f").alias("_b"))
    same = similar(met(left, right, [*keys, "_b", "word"]))
    asked = frames.select(*keys, "f").join(last, list(keys))
    horizon = F.least((blk("f") + 2) * F.lit(width), F.col("last"))
    asked = asked.select(*keys, "f", F.col("f").alias("lo"), horizon.alias("hi"), "last")
    table = cut(first_gap(asked, same, "lo", "hi"))
    nexts = table.filter(F.col("nxt").isNotNull())
    reached = follow(nexts, frames.groupBy(*keys).agg(F.min("f").alias("f")), keys)
    waiting = table.filter(F.col("nxt").isNull() & (F.col("hi") < F.col("last"))).select(*keys, "f", "hi", "last")
    stuck = cut(reached.join(waiting, [*keys, "f"]))
    reach = width
    while not stuck.isEmpty():
        reach *= 2
        asked = stuck.select(*keys, "f", F.col("hi").alias("lo"), F.least(F.col("hi") + reach, F.col("last")).alias("hi"), "last")
        mine = words.join(asked.select(*keys, "f"), [*keys, "f"])
        near = words.select(*keys, F.col("f").alias("g"), "word", "bits").join(asked.select(*keys, "lo", "hi"), list(keys))
        near = near.filter((F.col("g") > F.col("lo")) & (F.col("g") <= F.col("hi"))).drop("lo", "hi")
        found = cut(first_gap(asked, similar(met(mine, near, [*keys, "word"])), "lo", "hi"))
        starts = found.filter(F.col("nxt").isNotNull()).select(*keys, F.col("nxt").alias("f"))
        more = follow(nexts, starts, keys)
        reached = cut(reached.unionByName(more).distinct())
        on = found.filter(F.col("nxt").isNull() & (F.col("hi") < F.col("last"))).select(*keys, "f", "hi", "last")
        stuck = cut(on.unionByName(more.join(waiting, [*keys, "f"]).select(*keys, "f", "hi", "last")))
        if not starts.isEmpty():
            reach = width
    return reached.join(frames.select(*keys, "f", "frame_id"), [*keys, "f"]).select(*keys, "frame_id")


def greedy_cover(frame_voxels: DataFrame, window: int, open_pairs: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """T4: select ``window`` frames that cover the voxels, each the one that sees most uncovered voxels.

    Returns the picks (step, frame_id, gain) and the uncovered part of ``frame_voxels`` to hand to the next
    call. The first call starts from the frame with most voxels. Ties go to the lowest frame id and a frame may
    be picked again; once everything is covered, all but the last pick's voxels are open again. With no more
    frames than ``window`` all are returned and the state is unchanged. One small job per pick, each over
    the still uncovered rows only.
    """
    pairs = cut(frame_voxels.select("frame_id", "node").distinct())
    spark = pairs.sparkSession
    schema = "step int, frame_id bigint, gain bigint"
    counts = pairs.groupBy("frame_id").agg(F.count("*").alias("n"))
    few = counts.orderBy("frame_id").limit(window + 1).collect()
    if len(few) <= window:
        return spark.createDataFrame([(i, r["frame_id"], r["n"]) for i, r in enumerate(few)], schema), open_pairs
    still = pairs if open_pairs is None else open_pairs
    picks: list[tuple[int, int, int]] = []
    while len(picks) < window:
        gains = still.groupBy("frame_id").agg(F.count("*").alias("n"))
        best = gains.orderBy(F.col("n").desc(), "frame_id").limit(1).collect()
        if not best:
            best = [{"frame_id": few[0]["frame_id"], "n": 0}]
        frame, gain = best[0]["frame_id"], best[0]["n"]
        picks.append((len(picks), frame, gain))
        covered = pairs.filter(F.col("frame_id") == frame).select("node")
        still = cut(still.join(covered, "node", "left_anti").select("frame_id", "node"))
        opening = open_pairs is None and len(picks) == 1
        if not opening and still.isEmpty():
            still = cut(pairs.join(covered, "node", "left_anti").select("frame_id", "node"))
    return spark.createDataFrame(picks, schema), still


def reopen(open_pairs: DataFrame | None, frame_voxels: DataFrame, new_frames: DataFrame) -> DataFrame | None:
    """T4: a new key frame makes its voxels uncovered again, for every frame that sees them."""
    if open_pairs is None:
        return None
    fresh = frame_voxels.join(new_frames.select("frame_id"), "frame_id", "left_semi").select("node").distinct()
    again = frame_voxels.join(fresh, "node", "left_semi").select("frame_id", "node")
    return open_pairs.unionByName(again).distinct()


def with_current(selected: DataFrame, current: DataFrame) -> DataFrame:
    """The selected key frames and the current frame, once."""
    return selected.unionByName(current.select(selected.columns)).dropDuplicates(["frame_id"])


def refill(all_voxels: DataFrame, last_selected: DataFrame) -> DataFrame:
    """All voxels except those of the last selection."""
    return all_voxels.join(last_selected.select("node"), "node", "left_anti")


def voxel_union(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4."""
    return a.select("node").union(b.select("node")).distinct()


def voxel_intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """U4."""
    return a.select("node").intersect(b.select("node"))
