"""The distance field on the voxel table: vertices, interpolation, residual model and queries.

The vertex table ``(ns, vx, vy, vz, sdf, gx, gy, gz[, feat])`` is denormalised once per voxel into one row
with all eight corners; a query then costs one lookup of the deepest voxel and one join.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.functions import keys as K
from voxfield.operators import voxelmap as V
from voxfield.operators.grids import dilate
from voxfield.session import spread

AXES = "xyz"
PARAMS = ("sdf", "gx", "gy", "gz")


def corner_rows(
    nodes: DataFrame, vertices: DataFrame, res: float, depth: int, separate_leaves: bool = False, features: int = 0
) -> DataFrame:
    """One row per voxel: node, centre cx, cy, cz, half size and <param><corner> for the eight corners.

    Voxels with a missing vertex are left out.
    """
    boxes = voxel_boxes(nodes, res, depth)
    return join_corner_values(V.voxel_corners(nodes, depth, separate_leaves=separate_leaves), vertices, features).join(boxes, "node")


def voxel_boxes(nodes: DataFrame, res: float, depth: int) -> DataFrame:
    """(node, cx, cy, cz, half)."""
    return V.describe_nodes(nodes.select("node"), res, depth).select("node", "cx", "cy", "cz", "half")


def join_corner_values(corners: DataFrame, vertices: DataFrame, features: int = 0) -> DataFrame:
    """The <param><corner> columns of each voxel from its corner list (node, corner, ns, vx, vy, vz)."""
    extra = [F.get("feat", k).alias(f"f{k}_") for k in range(features)]
    names = [*PARAMS, *[f"f{k}_" for k in range(features)]]
    params = vertices.select("ns", "vx", "vy", "vz", *PARAMS, *extra)
    met = corners.join(params, ["ns", "vx", "vy", "vz"])
    picks = [F.max(F.when(F.col("corner") == i, F.col(n))).alias(f"{n}{i}") for n in names for i in range(8)]
    return met.groupBy("node").agg(F.count("*").alias("_n"), *picks).filter(F.col("_n") == 8).drop("_n")


# -- interpolation (G5, G6, G12) -----------------------------------------------------------------


# These formulas are SQL text: a few hundred terms build as one expression instead of one call per term.


def blend(v: Sequence[str]) -> str:
    """Trilinear blend over px, py, pz of eight corner terms; corner i has bits x, y, z."""
    for a in ("px", "py", "pz"):
        v = [f"((1 - {a}) * {v[i]} + {a} * {v[i + 1]})" for i in range(0, len(v), 2)]
    return v[0]


def slope(v: Sequence[str], axis: int) -> str:
    """Derivative of the blend by the unit coordinate of one axis."""
    for b, a in enumerate(("px", "py", "pz")):
        v = [
            f"({v[i + 1]} - {v[i]})" if b == axis else f"((1 - {a}) * {v[i]} + {a} * {v[i + 1]})" for i in range(0, len(v), 2)
        ]
    return v[0]


def unit_coords() -> dict[str, Column]:
    """p = (x - centre) / edge + 0.5, in [0, 1] inside the voxel."""
    return {f"p{a}": F.expr(f"({a} - c{a}) / (half * 2.0D) + 0.5D") for a in AXES}


def interpolate(rows: DataFrame, augmented: bool = True, gradient: bool = True) -> DataFrame:
    """G5 (plain) or G6 (gradient-augmented) value ``sdf_prior`` and its exact gradient (G12) grad_x..z.

    Augmented corner values are v_i + g_i . (x - corner_i), so an affine field is reproduced from any corner.
    """
    rows = rows.withColumns(unit_coords())
    values = [f"sdf{i}" for i in range(8)]
    if augmented:
        # x - corner = edge * (p - bit).
        near = {
            f"_v{i}": F.expr(f"sdf{i} + half * 2.0D * (" + " + ".join(f"g{a}{i} * (p{a} - {i >> b & 1})" for b, a in enumerate(AXES)) + ")")
            for i in range(8)
        }
        rows = rows.withColumns(near)
        values = list(near)
    out = {"sdf_prior": F.expr(blend(values))}
    if gradient:
        for n, a in enumerate(AXES):
            own = " + " + blend([f"g{a}{i}" for i in range(8)]) if augmented else ""
            out[f"grad_{a}"] = F.expr(f"{slope(values, n)} / (half * 2.0D){own}")
    return rows.withColumns(out).drop("px", "py", "pz", *[f"_v{i}" for i in range(8)])


# -- queries (G10, G11, G13, G14, V1, V2) --------------------------------------------------------


def locate(points: DataFrame, nodes: DataFrame, res: float, depth: int) -> DataFrame:
    """Points with the deepest voxel that holds them."""
    return V.deepest_voxel(V.leaf_codes(points, res, depth), nodes).drop("leaf")


def valid_samples(samples: DataFrame, nodes: DataFrame, res: float, depth: int, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """F8: samples inside the bounds and inside an existing voxel, with that voxel as ``node``."""
    inside = samples.filter(G.in_box(G.vec(*AXES), low, high))
    return locate(inside, nodes, res, depth).filter(F.col("node").isNotNull())


def query_sdf(
    points: DataFrame, corners: DataFrame, res: float, depth: int, augmented: bool = True, gradient: bool = True
) -> DataFrame:
    """Value and gradient of the prior field at arbitrary points; NULL where no voxel holds them."""
    located = locate(spread(points), corners.select("node"), res, depth)
    joined = located.join(corners, "node", "left")
    out = interpolate(joined, augmented, gradient)
    added = ["sdf_prior", *([f"grad_{a}" for a in AXES] if gradient else [])]
    return out.select(*points.columns, "node", *added)


def central_gradient(points: DataFrame, field: Callable[[DataFrame], DataFrame], eps: float, key: str, value: str = "sdf_prior") -> DataFrame:
    """(key, grad_x..z) by central differences of any field function over the six offset points."""
    moved = G.offset_points(points.select(key, *AXES), eps)
    at = field(moved).select(key, "axis", "side", value)
    terms = [
        (F.sum(F.when(F.col("axis") == n, F.col(value) * F.col("side"))) / F.lit(2.0 * eps)).alias(f"grad_{a}")
        for n, a in enumerate(AXES)
    ]
    whole = [F.count(F.when(F.col("axis") == n, F.col(value))) == 2 for n in range(3)]
    out = at.groupBy(key).agg(*terms, *[w.alias(f"_w{n}") for n, w in enumerate(whole)])
    return out.select(key, *[F.when(F.col(f"_w{n}"), F.col(f"grad_{a}")).alias(f"grad_{a}") for n, a in enumerate(AXES)])


def vertex_filter(points: DataFrame, nodes: DataFrame, res: float, depth: int, low: int, high: int) -> DataFrame:
    """grid points whose voxel has a discrete size in [low, high]."""
    at = locate(points, nodes, res, depth)
    size = K.discrete_size(F.lit(depth) - K.node_depth(F.col("node")))
    return at.filter(F.col("node").isNotNull()).filter(size.between(low, high)).select(*points.columns)


def filtered_grid(
    grid: DataFrame, nodes: DataFrame, res: float, depth: int, low: int, high: int, shape: Sequence[int], iterations: int = 1
) -> DataFrame:
    """The grid points that F13 keeps, grown by G4 so that surface cells keep all corners."""
    kept = vertex_filter(grid, nodes, res, depth, low, high)
    return grid.join(dilate(kept, shape, iterations), ["i", "j", "k"], "left_semi")


def extract_grid(grid: DataFrame, field: Callable[[DataFrame], DataFrame], keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """A field function over a grid or slice, after an optional point filter (V1, V2)."""
    return field(keep(grid) if keep else grid)


# -- features and residual model (G7-G9) ---------------------------------------------------------


def level_features(points: DataFrame, corners: DataFrame, res: float, depth: int, levels: int, features: int, key: str) -> DataFrame:
    """Feature vector ``feat`` per point: trilinear features of its voxel at levels 1..levels, in order.

    A level without a voxel gives zeros. ``corners`` holds the feature columns f<k>_<corner> (J9).
    """
    coded = V.leaf_codes(points, res, depth)
    cols = [f"f{k}_{i}" for k in range(features) for i in range(8)]
    table = corners.select("node", "cx", "cy", "cz", "half", *cols)
    feats = []
    for level in range(1, levels + 1):
        coded = V.ancestor_voxel(coded, table.select("node"), level).join(table, "node", "left").withColumns(unit_coords())
        one = [F.expr(f"coalesce({blend([f'f{k}_{i}' for i in range(8)])}, 0.0D)") for k in range(features)]
        coded = coded.withColumns({f"_l{level}_{k}": c for k, c in enumerate(one)})
        coded = coded.drop("node", "cx", "cy", "cz", "half", "px", "py", "pz", *cols)
        feats += [F.col(f"_l{level}_{k}") for k in range(features)]
    return coded.select(*points.columns, F.array(*feats).alias("feat"))


def residual(weights: Sequence[tuple[np.ndarray, np.ndarray]], scale: float = 0.1, slope: float = 0.01):
    """An Arrow function (prior, feat) -> residual: linear layers with leaky ReLU, then ``scale``.

    ``weights`` is (W (out, in), b (out)) per layer, about a thousand numbers, shipped with the function.
    """
    layers = [(np.asarray(w, dtype=float), np.asarray(b, dtype=float)) for w, b in weights]

    @F.pandas_udf("double")
    def score(prior: pd.Series, feat: pd.Series) -> pd.Series:
        ok = prior.notna().to_numpy() & feat.notna().to_numpy()
        out = np.full(len(prior), np.nan)
        if ok.any():
            h = np.column_stack([prior.to_numpy(float)[ok], np.stack(feat.to_numpy()[ok])])
            for n, (w, b) in enumerate(layers):
                h = h @ w.T + b
                if n + 1 < len(layers):
                    h = np.where(h >= 0, h, slope * h)
            out[ok] = h[:, 0] * scale
        return pd.Series(out)

    return score


def compose(df: DataFrame, weights: Sequence[tuple[np.ndarray, np.ndarray]] | None = None, prior_only: bool = False, scale: float = 0.1) -> DataFrame:
    """sdf = prior + residual; with ``prior_only`` (or no weights) the residual is NULL and sdf = prior."""
    if prior_only or weights is None:
        return df.withColumn("sdf_residual", F.lit(None).cast("double")).withColumn("sdf", F.col("sdf_prior"))
    r = residual(weights, scale)(F.col("sdf_prior"), F.col("feat"))
    df = df.withColumn("sdf_residual", F.when(F.col("sdf_prior").isNotNull(), r))
    return df.withColumn("sdf", F.col("sdf_prior") + F.col("sdf_residual"))


def service_query(points: DataFrame, corners: DataFrame, res: float, depth: int, return_grad: bool = False) -> DataFrame:
    """The on-demand query: sdf (and gradient) per requested point."""
    return query_sdf(points, corners, res, depth, gradient=return_grad).withColumnRenamed("sdf_prior", "sdf")
