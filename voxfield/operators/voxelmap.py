"""The multi-level voxel table: building, completing, searching, pruning and deleting nodes.

A voxel table is a DataFrame with a ``node`` location code (see :mod:`voxfield.functions.keys`). Because a
node names its whole ancestry, building and searching the hierarchy are equi-joins and set operations;
points are always reduced to distinct leaf codes first, so a voxel that holds a third of all points costs
one row, not one shuffle partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.functions import keys as K
from voxfield.session import cut

AXES = K.AXES


# -- A1, J15: occupied voxels -------------------------------------------------------------------


def voxel_counts(points: DataFrame, res: float, depth: int, by: tuple[str, ...] = (), dims: int = 3) -> DataFrame:
    """Points per voxel key, optionally per scene/frame; counts combine before the shuffle."""
    keyed = K.with_keys(points, res, depth, dims)
    names = [f"k{a}" for a in AXES[:dims]]
    return keyed.groupBy(*by, *names).agg(F.count("*").alias("n"))


def occupied_voxels(
    points: DataFrame, res: float, depth: int, threshold: int = 0, by: tuple[str, ...] = (), dims: int = 3
) -> DataFrame:
    """A1: voxels with strictly more than ``threshold`` points, with their leaf code."""
    counts = voxel_counts(points, res, depth, by, dims).filter(F.col("n") > threshold)
    return counts.withColumn("node", K.location_code(K.key_columns(dims), depth))


def leaf_codes(points: DataFrame, res: float, depth: int, dims: int = 3) -> DataFrame:
    """Points with their leaf location code as ``leaf`` (out-of-range points get NULL)."""
    keyed = K.with_keys(points, res, depth, dims, checked=False)
    names = [f"k{a}" for a in AXES[:dims]]
    inside = F.lit(True)
    for name in names:
        inside = inside & F.col(name).between(0, (1 << depth) - 1)
    return keyed.withColumn("leaf", F.when(inside, K.location_code(K.key_columns(dims), depth))).drop(*names)


def missing_voxels(new: DataFrame, voxels: DataFrame) -> DataFrame:
    """The voxels of ``new`` that the table does not have yet."""
    return new.join(voxels.select("node"), "node", "left_anti")


# -- O1, O2: hierarchy ---------------------------------------------------------------------------


def with_ancestors(nodes: DataFrame, top: int = 0, dims: int = 3) -> DataFrame:
    """Each node and every ancestor down to depth ``top``; other columns are kept (not distinct)."""
    up = F.sequence(F.lit(0), (K.node_depth(F.col("node"), dims) - F.lit(top)).cast("int"))
    out = nodes.withColumn("_up", F.explode(up))
    return out.withColumn("node", K.ancestor(F.col("node"), F.col("_up"), dims)).drop("_up")


def build_nodes(leaves: DataFrame, depth: int, dims: int = 3) -> DataFrame:
    """O1: all nodes on the paths to the given leaves: (node, level)."""
    paths = with_ancestors(leaves.select("node").distinct(), dims=dims).distinct()
    return paths.withColumn("level", F.lit(depth) - K.node_depth(F.col("node"), dims))


def semi_sparse(nodes: DataFrame, depth: int, full_depth: int, dims: int = 3) -> DataFrame:
    """O2: every node above ``full_depth`` that has a child gets all its children."""
    inner = nodes.filter(F.col("node") > 1).select(K.ancestor(F.col("node"), 1, dims).alias("node")).distinct()
    added = inner.filter(K.node_depth(F.col("node"), dims) < full_depth)
    added = added.select(F.explode(K.children(F.col("node"), dims)).alias("node"))
    out = nodes.select("node").union(added).distinct()
    return out.withColumn("level", F.lit(depth) - K.node_depth(F.col("node"), dims))


def describe_nodes(nodes: DataFrame, res: float, depth: int, dims: int = 3) -> DataFrame:
    """Lowest key, discrete size, centre and half size of every node."""
    names = AXES[:dims]
    out = nodes.withColumn("level", (F.lit(depth) - K.node_depth(F.col("node"), dims)).cast("int"))
    out = out.select("*", *[k.alias(f"k{a}") for a, k in zip(names, K.node_keys(F.col("node"), depth, dims))])
    out = out.withColumn("size", K.discrete_size(F.col("level")))
    half = F.col("size") * F.lit(res / 2.0)
    out = out.select(
        "*",
        *[(K.corner_coord(F.col(f"k{a}"), res, depth) + half).alias(f"c{a}") for a in names],
        half.alias("half"),
    )
    return out


# -- O3: vertices --------------------------------------------------------------------------------


def voxel_corners(
    nodes: DataFrame, depth: int, dims: int = 3, separate_leaves: bool = False
) -> DataFrame:
    """The 2^dims corners of every voxel: (node, corner, ns, vx, vy(, vz)).

    With ``separate_leaves`` the corners of level-0 voxels live in their own namespace and are shared
    only with other leaves; otherwise corners are shared across all levels.
    """
    names = AXES[:dims]
    out = nodes.select("node")
    out = out.withColumn("_level", (F.lit(depth) - K.node_depth(F.col("node"), dims)).cast("int"))
    out = out.select("node", "_level", *[k.alias(f"_k{a}") for a, k in zip(names, K.node_keys(F.col("node"), depth, dims))])
    out = out.withColumn("_size", K.discrete_size(F.col("_level")))
    out = out.withColumn("corner", F.explode(F.sequence(F.lit(0), F.lit((1 << dims) - 1))))
    ns = F.when(F.col("_level") == 0, F.lit("leaf")).otherwise(F.lit("shared")) if separate_leaves else F.lit("shared")
    bit = lambda i: F.shiftright(F.col("corner"), i).bitwiseAND(F.lit(1))
    return out.select(
        "node",
        "corner",
        ns.alias("ns"),
        *[(F.col(f"_k{a}") + bit(i) * F.col("_size")).alias(f"v{a}") for i, a in enumerate(names)],
    )


def vertex_table(nodes: DataFrame, depth: int, dims: int = 3, separate_leaves: bool = False) -> DataFrame:
    """O3: the distinct corners."""
    corners = voxel_corners(nodes, depth, dims, separate_leaves)
    return corners.select("ns", *[f"v{a}" for a in AXES[:dims]]).distinct()


# -- J7, J8, O4: lookups -------------------------------------------------------------------------


def deepest_of(leaves: DataFrame, nodes: DataFrame, dims: int = 3) -> DataFrame:
    """Deepest existing node on the path to each distinct leaf code: (leaf, node).

    A node's ancestors are in the table too, so the deepest hit is the largest code on the path.
    """
    paths = leaves.select(F.col("leaf"), F.col("leaf").alias("node"))
    hits = with_ancestors(paths, dims=dims).join(nodes.select("node"), "node")
    return hits.groupBy("leaf").agg(F.max("node").alias("node"))


def deepest_voxel(points: DataFrame, nodes: DataFrame, dims: int = 3) -> DataFrame:
    """Points (with ``leaf``) plus the deepest voxel that holds them; NULL if there is none.

    Only the distinct leaf codes meet the voxel table; the points take part in one join against a side
    that is unique per leaf, which a hot voxel cannot multiply and the runtime can split or broadcast.
    """
    leaves = points.select("leaf").filter(F.col("leaf").isNotNull()).distinct()
    return points.join(deepest_of(leaves, nodes, dims), "leaf", "left")


def ancestor_voxel(points: DataFrame, nodes: DataFrame, level: int, dims: int = 3) -> DataFrame:
    """Points (with ``leaf``) plus their voxel at a feature level n (1 = the leaf level); NULL if absent."""
    keyed = points.withColumn("node", K.ancestor(F.col("leaf"), level - 1, dims))
    found = nodes.select("node", F.lit(True).alias("_hit"))
    out = keyed.join(found, "node", "left")
    return out.withColumn("node", F.when(F.col("_hit"), F.col("node"))).drop("_hit")


def search_nodes(queries: DataFrame, nodes: DataFrame, depth: int, dims: int = 3) -> DataFrame:
    """For each ``query`` node code the node itself, or the pruned leaf above it, else NULL."""
    wanted = queries.select(F.col("query"), F.col("query").alias("node")).distinct()
    hits = with_ancestors(wanted, dims=dims).join(nodes.select("node"), "node")
    inner = nodes.filter(F.col("node") > 1).select(K.ancestor(F.col("node"), 1, dims).alias("node")).distinct()
    hits = hits.groupBy("query").agg(F.max("node").alias("node"))
    hits = hits.join(inner.withColumn("_inner", F.lit(True)), "node", "left")
    found = hits.filter((F.col("node") == F.col("query")) | F.col("_inner").isNull()).select("query", "node")
    return queries.join(found, "query", "left")


def node_path(queries: DataFrame, nodes: DataFrame, dims: int = 3) -> DataFrame:
    """The existing nodes from the root to each ``query`` node, one row each."""
    wanted = queries.select(F.col("query"), F.col("query").alias("node")).distinct()
    return with_ancestors(wanted, dims=dims).join(nodes.select("node"), "node")


# -- F15, F16, F12: scans ------------------------------------------------------------------------


def leaf_nodes(nodes: DataFrame, dims: int = 3) -> DataFrame:
    """F16: nodes without children."""
    parents = nodes.filter(F.col("node") > 1).select(K.ancestor(F.col("node"), 1, dims).alias("node")).distinct()
    return nodes.join(parents, "node", "left_anti")


def scan_nodes(nodes: DataFrame, max_depth: int, dims: int = 3) -> DataFrame:
    """F16: all nodes down to ``max_depth``; codes grow with depth, so this is a range on ``node``."""
    return nodes.filter(F.col("node") < F.lit(1 << (dims * (max_depth + 1))))


def subtree(nodes: DataFrame, root: int, dims: int = 3) -> DataFrame:
    """F16: the nodes under (and including) one node."""
    up = (K.node_depth(F.col("node"), dims) - F.lit((root.bit_length() - 1) // dims)).cast("int")
    return nodes.filter((up >= 0) & (K.ancestor(F.col("node"), F.greatest(up, F.lit(0)), dims) == root))


def nodes_in_box(
    nodes: DataFrame,
    low: tuple[float, ...],
    high: tuple[float, ...],
    res: float,
    depth: int,
    max_depth: int | None = None,
    leaves_only: bool = False,
) -> DataFrame:
    """nodes whose box meets the metric box [low, high] (both ends inclusive)."""
    dims = len(low)
    if max_depth is not None:
        nodes = scan_nodes(nodes, max_depth, dims)
    if leaves_only:
        nodes = leaf_nodes(nodes, dims)
    out = describe_nodes(nodes, res, depth, dims)
    for a, lo, hi in zip(AXES, low, high):
        out = out.filter((F.col(f"c{a}") + F.col("half") >= lo) & (F.col(f"c{a}") - F.col("half") <= hi))
    return out


def nodes_in_key_box(nodes: DataFrame, low: tuple[int, ...], high: tuple[int, ...], depth: int) -> DataFrame:
    """F15 by keys: nodes that cover any leaf key of the inclusive key box."""
    dims = len(low)
    out = nodes.withColumn("level", (F.lit(depth) - K.node_depth(F.col("node"), dims)).cast("int"))
    out = out.select("*", *[k.alias(f"k{a}") for a, k in zip(AXES, K.node_keys(F.col("node"), depth, dims))])
    out = out.withColumn("size", K.discrete_size(F.col("level")))
    for a, lo, hi in zip(AXES, low, high):
        out = out.filter((F.col(f"k{a}") + F.col("size") > lo) & (F.col(f"k{a}") <= hi))
    return out


def display_voxels(nodes: DataFrame, depth: int, min_size: int, dims: int = 3) -> DataFrame:
    """voxels of at least ``min_size`` leaves that do not have all their children."""
    kids = nodes.filter(F.col("node") > 1).groupBy(K.ancestor(F.col("node"), 1, dims).alias("node"))
    full = kids.agg(F.count("*").alias("n")).filter(F.col("n") == 1 << dims)
    level = F.lit(depth) - K.node_depth(F.col("node"), dims)
    big = nodes.withColumn("size", K.discrete_size(level)).filter(F.col("size") >= min_size)
    return big.join(full, "node", "left_anti")


# -- A3, A4: statistics --------------------------------------------------------------------------


def map_bounds(nodes: DataFrame, res: float, depth: int, dims: int = 3) -> DataFrame:
    """A3: metric bounds and size of the map over its leaf voxels."""
    leaves = describe_nodes(leaf_nodes(nodes, dims), res, depth, dims)
    lows = [F.min(F.col(f"c{a}") - F.col("half")).alias(f"min_{a}") for a in AXES[:dims]]
    highs = [F.max(F.col(f"c{a}") + F.col("half")).alias(f"max_{a}") for a in AXES[:dims]]
    out = leaves.agg(*lows, *highs)
    return out.select("*", *[(F.col(f"max_{a}") - F.col(f"min_{a}")).alias(f"size_{a}") for a in AXES[:dims]])


def node_statistics(nodes: DataFrame, depth: int, dims: int = 3) -> DataFrame:
    """A4: nodes and leaves per level."""
    kids = nodes.filter(F.col("node") > 1).select(K.ancestor(F.col("node"), 1, dims).alias("node")).distinct()
    flagged = nodes.select("node").join(kids.withColumn("_inner", F.lit(1)), "node", "left")
    level = (F.lit(depth) - K.node_depth(F.col("node"), dims)).cast("int")
    return flagged.groupBy(level.alias("level")).agg(
        F.count("*").alias("n_nodes"), F.sum(F.when(F.col("_inner").isNull(), 1).otherwise(0)).alias("n_leaves")
    )


# -- A16, O5: prune, expand, delete --------------------------------------------------------------


def prune(leaves: DataFrame, value: Column, depth: int, dims: int = 3) -> DataFrame:
    """Collapse complete groups of equal-valued sibling leaves into their parent, bottom-up.

    One aggregation per level, each over the leaves that are left at that level only.
    """
    rows = cut(leaves.select("node", value.alias("value")))
    done: DataFrame | None = None
    at = K.node_depth(F.col("node"), dims)
    current = rows.filter(at == depth)
    for d in range(depth, 0, -1):
        parent = K.ancestor(F.col("node"), 1, dims)
        merged = (
            current.groupBy(parent.alias("node"))
            .agg(F.count("*").alias("n"), F.min("value").alias("value"), F.max("value").alias("_high"))
            .filter((F.col("n") == 1 << dims) & F.col("value").eqNullSafe(F.col("_high")))
            .select("node", "value")
        )
        merged = cut(merged)
        kept = current.withColumn("_p", parent).join(merged.select(F.col("node").alias("_p")), "_p", "left_anti")
        kept = kept.select("node", "value")
        done = kept if done is None else done.unionByName(kept)
        current = merged.unionByName(rows.filter(at == d - 1))
    return done.unionByName(current)


def expand(leaves: DataFrame, depth: int, dims: int = 3) -> DataFrame:
    """Inverse of :func:`prune`: every leaf voxel replaced by its cells at the finest level.

    One doubling per level keeps each generated row list at 2^dims entries.
    """
    out = leaves
    for d in range(depth):
        kids = F.when(K.node_depth(F.col("node"), dims) == d, K.children(F.col("node"), dims))
        out = out.withColumn("node", F.explode(F.coalesce(kids, F.array("node"))))
    return out


def delete_nodes(nodes: DataFrame, doomed: DataFrame, dims: int = 3) -> DataFrame:
    """Remove the subtrees of ``doomed`` and every node that is then left without children.

    A node survives exactly if a leaf of the old table that is not under a doomed node lies below it.
    """
    leaves = leaf_nodes(nodes.select("node"), dims).select(F.col("node").alias("leaf"), "node")
    hit = with_ancestors(leaves, dims=dims).join(doomed.select("node").distinct(), "node", "left_semi")
    alive = leaves.join(hit.select("leaf").distinct(), "leaf", "left_anti").select("node")
    return nodes.join(with_ancestors(alive, dims=dims).distinct(), "node", "left_semi")


# -- J20: adjacency ------------------------------------------------------------------------------


def face_adjacent_leaves(leaves: DataFrame, depth: int, dims: int = 3) -> DataFrame:
    """Pairs (node, neighbour) of leaves of any sizes that share (part of) a face.

    Each pair is found from its smaller side: the same-size cell across a face, or one of that cell's
    ancestors, is the larger leaf. Pairs of unequal size are then mirrored.
    """
    names = AXES[:dims]
    base = leaves.select("node").withColumn("_level", (F.lit(depth) - K.node_depth(F.col("node"), dims)).cast("int"))
    base = base.select("*", *[k.alias(f"k{a}") for a, k in zip(names, K.node_keys(F.col("node"), depth, dims))])
    base = base.withColumn("_size", K.discrete_size(F.col("_level")))
    moved = K.explode_neighbours(base, depth, dims, size=F.col("_size"))
    code = K.location_code([F.col(f"n{a}") for a in names], depth)
    moved = moved.select(F.col("node").alias("small"), K.ancestor(code, F.col("_level"), dims).alias("node"))
    pairs = with_ancestors(moved, dims=dims).join(leaves.select("node"), "node").distinct()
    pairs = pairs.select(F.col("small").alias("node"), F.col("node").alias("neighbour"))
    larger = K.node_depth(F.col("neighbour"), dims) < K.node_depth(F.col("node"), dims)
    mirrored = pairs.filter(larger).select(F.col("neighbour").alias("node"), F.col("node").alias("neighbour"))
    return pairs.unionByName(mirrored)
