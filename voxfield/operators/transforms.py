"""The pose of one frame in another through a tree of moving frames.

``edges`` (parent, child, t, x, y, z, qx, qy, qz, qw) hold stamped transforms, ``fixed`` (parent, child, x .. qw) those that hold at any time. A request (source,
target, t) follows the tree from the source up to the nearest common ancestor and down to the target. Every edge on the way is
looked up between its two neighbours in time, and the transforms are multiplied in order. A request fails, and its row is dropped, if a
frame is unknown or missing, if the two have no common ancestor, or if a moving edge has no transform on both sides of t.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.operators.asof import asof_bracket, lerp_transform
from voxfield.session import cut, free

PLACE = ("x", "y", "z", "qx", "qy", "qz", "qw")
#: Steps up from the source come after all steps down to the target.
UP = 1 << 20

_CELL = " + ".join(f"element_at(a, CAST(i DIV 4 * 4 + {k + 1} AS INT)) * element_at(b, {4 * k + 1} + i % 4)" for k in range(4))
#: Product of a list of 4 x 4 matrices in row order, in the order of the list.
PRODUCT = f"""aggregate(_all, transform(sequence(0, 15), i -> if(i % 5 = 0, 1.0D, 0.0D)),
    (a, m) -> transform(array(m.pose), b -> transform(sequence(0, 15), i -> {_CELL}))[0])"""


def parents_of(edges: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """(child, parent): the parent that the latest message of each child names (ties: the greater name); fixed edges are the earliest."""
    rows = edges.select("child", "parent", F.col("t").cast("bigint").alias("t"))
    if fixed is not None:
        rows = rows.unionByName(fixed.select("child", "parent", F.lit(None).cast("bigint").alias("t")))
    rows = rows.where("child IS NOT NULL AND parent IS NOT NULL AND child <> parent")
    return rows.groupBy("child").agg(F.max(F.struct("t", "parent")).alias("m")).select("child", "m.parent")


def ancestors(parents: DataFrame) -> DataFrame:
    """(frame, ancestor, steps) of every frame, itself included, whose way up ends at a frame without a parent.

    Ways are doubled in every round, so a chain of n edges takes log2(n) rounds. Frames on or below a ring have no such end.
    """
    parents = cut(parents)
    names = parents.select(F.col("child").alias("frame")).union(parents.select("parent")).distinct()
    ways = names.select("frame", F.col("frame").alias("ancestor"), F.lit(0).alias("steps"))
    ways = cut(ways.unionByName(parents.select(F.col("child").alias("frame"), F.col("parent").alias("ancestor"), F.lit(1).alias("steps"))))
    n, before = ways.count(), 0
    while n > before:
        on = ways.where("steps > 0").select(F.col("frame").alias("ancestor"), F.col("ancestor").alias("_to"), F.col("steps").alias("_more"))
        longer = ways.where("steps > 0").join(on, "ancestor").select("frame", F.col("_to").alias("ancestor"), (F.col("steps") + F.col("_more")).alias("steps"))
        after = cut(ways.unionByName(longer).groupBy("frame", "ancestor").agg(F.min("steps").alias("steps")))
        free(ways)
        ways, before, n = after, n, after.count()
    roots = names.join(parents.select(F.col("child").alias("frame")), "frame", "left_anti")
    ends = ways.join(roots.select(F.col("frame").alias("ancestor")), "ancestor", "left_semi").select("frame").distinct()
    return ways.join(ends, "frame", "left_semi")


def ways_between(pairs: DataFrame, up: DataFrame) -> DataFrame:
    """(source, target, child, back, place): the edges (by their child) of each pair's way, in the order of their product; ``back`` ones are inverted."""
    s = up.select(F.col("frame").alias("source"), "ancestor", F.col("steps").alias("_s"))
    t = up.select(F.col("frame").alias("target"), "ancestor", F.col("steps").alias("_t"))
    met = pairs.select("source", "target").distinct().join(s, "source").join(t, ["target", "ancestor"])
    met = met.groupBy("source", "target").agg(F.min(F.struct((F.col("_s") + F.col("_t")).alias("far"), "_s", "_t")).alias("m"))
    met = met.select("source", "target", "m._s", "m._t")
    rise = met.join(s.select("source", "ancestor", F.col("_s").alias("_at")), "source").where("_at < _s")
    fall = met.join(t.select("target", "ancestor", F.col("_t").alias("_at")), "target").where("_at < _t")
    rise = rise.select("source", "target", F.col("ancestor").alias("child"), F.lit(False).alias("back"), (F.lit(UP) - F.col("_at")).alias("place"))
    fall = fall.select("source", "target", F.col("ancestor").alias("child"), F.lit(True).alias("back"), F.col("_at").alias("place"))
    same = met.where("_s = 0 AND _t = 0").select("source", "target", F.lit(None).cast("string").alias("child"), F.lit(False).alias("back"), F.lit(-1).alias("place"))
    return rise.unionByName(fall).unionByName(same)


def _inverse() -> F.Column:
    """Inverse of the rigid ``pose``."""
    at = lambda r, c: G.pose_at(F.col("pose"), r, c)
    rows = []
    for r in range(3):
        rows += [at(c, r) for c in range(3)] + [-(at(0, r) * at(0, 3) + at(1, r) * at(1, 3) + at(2, r) * at(2, 3))]
    return F.array(*rows, *[F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)])


def chain_transforms(requests: DataFrame, edges: DataFrame, fixed: DataFrame | None = None, key: str = "id") -> DataFrame:
    """``requests`` (key, source, target, t, ...) with the ``pose`` of the source frame in the target frame at t, 16 values in row order.

    Work on a request is as long as its way through the tree; an edge that very many requests or messages share is met by the block-wise
    nearest-in-time join.
    """
    up = cut(ancestors(parents_of(edges, fixed)))
    steps = requests.select(F.col(key).alias("_id"), "source", "target", "t").join(ways_between(requests, up), ["source", "target"])
    steps = steps.select("_id", "child", "t", "back", "place")
    # An edge counts with the parent that the tree has.
    tree = up.where("steps = 1").select(F.col("frame").alias("child"), F.col("ancestor").alias("parent"))
    moving = edges.join(tree, ["child", "parent"])
    found = lerp_transform(asof_bracket(steps.where("child IS NOT NULL"), moving.select("child", "t", *PLACE), ["child"], "t", PLACE))
    if fixed is not None:
        # A frame that also moves is taken from its messages.
        still = fixed.join(tree, ["child", "parent"]).join(moving.select("child").distinct(), "child", "left_anti").dropDuplicates(["child"])
        found = found.unionByName(steps.join(still.select("child", *PLACE), "child").select(found.columns))
    found = found.withColumn("pose", G.quaternion_pose(G.vec("x", "y", "z"), G.vec("qx", "qy", "qz", "qw")))
    found = found.select("_id", "place", F.when(F.col("back"), _inverse()).otherwise(F.col("pose")).alias("pose"))
    wanted = steps.groupBy("_id").agg(F.count("child").alias("_n"))
    # As many matrices as the way has edges.
    whole = found.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("place", "pose"))).alias("_all"))
    whole = wanted.join(whole, "_id", "left").withColumn("_all", F.coalesce("_all", F.expr("cast(array() AS array<struct<place: int, pose: array<double>>>)")))
    whole = whole.where(F.size("_all") == F.col("_n")).select("_id", F.expr(PRODUCT).alias("pose"))
    return requests.join(whole.withColumnRenamed("_id", key), key)
