"""L3 with G7-G9: the residual network and the features of the vertices, fitted together with the prior.

The prediction is prior + scale * network(prior, features), the features being the trilinear features of a sample's voxel and of its next
``levels - 1`` ancestors. As in the model, the prior enters the prediction as a constant: its own parameters are pulled by the prior's losses
only (L1), features and weights by those of the prediction. The losses (L2) see value and gradient, so besides the value three tangents
run through the network; its slopes are constant around a sample, so both go back through the same layers.

A step joins each sample with one row of its voxel that holds the corner features of all levels, sums pulls per voxel and weight gradients per Arrow batch,
and spreads the former to vertices by the corner list. Only sums leave a task.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.functions import keys as K
from voxfield.operators import field as FD
from voxfield.operators import voxelmap as V
from voxfield.plans import fit
from voxfield.session import cut, free

AXES = "xyz"
VERTEX = ["ns", "vx", "vy", "vz"]
Layers = list[tuple[np.ndarray, np.ndarray]]


def initial_features(vertices: DataFrame, features: int, size: float = 0.1, seed: int = 0) -> DataFrame:
    """Vertices with ``feat``: small numbers drawn by a hash of the vertex."""
    at = [F.xxhash64("ns", "vx", "vy", "vz", F.lit(seed), F.lit(k)) for k in range(features)]
    draw = [(F.pmod(h, F.lit(1 << 20)) / float(1 << 19) - 1.0) * size for h in at]
    return vertices.withColumn("feat", F.array(*draw))


def level_corners(nodes: DataFrame, res: float, depth: int, levels: int, separate_leaves: bool = False) -> DataFrame:
    """(node, slot, corner, ns, vx, vy, vz, cx, cy, cz, half): the corners of each voxel and of its next ancestors; slot 0 is the voxel."""
    up = nodes.select("node", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("slot"))
    up = up.where(F.col("slot") <= K.node_depth(F.col("node"))).withColumn("_a", K.ancestor(F.col("node"), F.col("slot")))
    each = cut(up.select(F.col("_a").alias("node")).distinct())
    corners = V.voxel_corners(each, depth, separate_leaves=separate_leaves).join(FD.voxel_boxes(each, res, depth), "node")
    return up.join(corners.withColumnRenamed("node", "_a"), "_a").drop("_a")


def blocks_of(corners: DataFrame, state: DataFrame) -> DataFrame:
    """(node, boxes, feats): centre and half size per level, and corner features by level and corner, both flat. Missing vertices count as zeros."""
    met = corners.join(state.select(*VERTEX, "feat"), VERTEX, "left")
    # Eight corners for each of the levels.
    rows = met.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("slot", "corner", "cx", "cy", "cz", "half", "feat"))).alias("_r"))
    boxes = F.expr("flatten(transform(filter(_r, r -> r.corner = 0), r -> array(r.cx, r.cy, r.cz, r.half)))")
    return rows.select("node", boxes.alias("boxes"), F.col("_r.feat").alias("feats"))


def _forward(layers: Layers, h: np.ndarray, t: np.ndarray, slope: float):
    """Values and tangents of every layer's input, the slopes of its output, and the network's value (n) and tangents (n, 3)."""
    values, tangents, bends = [], [], []
    for n, (w, b) in enumerate(layers):
        values.append(h)
        tangents.append(t)
        h, t = h @ w.T + b, t @ w.T
        bend = np.where(h >= 0, 1.0, slope) if n + 1 < len(layers) else np.ones_like(h)
        bends.append(bend)
        h, t = h * bend, t * bend[:, None, :]
    return values, tangents, bends, h[:, 0], t[:, :, 0]


def pulls_of(cfg: fit.Losses, n: dict[str, int], kind, behind, label, f, g):
    """Loss of each sample in the weighted total, and its sub-gradients by value (n) and gradient (n, 3), as ``fit.term_columns`` states the terms."""
    s, size = np.where(behind, -1.0, 1.0), np.sqrt((g * g).sum(1))
    rate = lambda w, k: w / max(n.get(k, 0), 1)
    loss, p, factor = np.zeros(len(f)), np.zeros(len(f)), np.zeros(len(f))
    value = (lambda c: c * c) if cfg.squared else np.abs
    step = (lambda c: 2.0 * c) if cfg.squared else np.sign
    unit = np.divide(1.0, size, out=np.zeros_like(size), where=size > 0)
    for k, name in fit.KIND.items():
        on = kind == k
        w = rate(cfg.eikonal[name], k)
        loss[on] += w * value(size[on] - 1.0)
        factor[on] += w * step(size[on] - 1.0) * unit[on]
    on = kind == "surface"
    loss[on] += rate(cfg.boundary, "surface") * value(f[on])
    p[on] += rate(cfg.boundary, "surface") * step(f[on])
    on = kind == "perturbed"
    below = cfg.eta - s * f
    bend = np.exp(cfg.exp_penalty * np.maximum(below, 0.0))
    w = rate(cfg.perturbation, "perturbed")
    loss[on] += w * (np.maximum(s * f - s * label, 0.0) + bend - 1.0)[on]
    p[on] += w * (s * ((s * f > s * label) - np.where(below > 0, cfg.exp_penalty * bend, 0.0)))[on]
    on = kind == "stratified"
    w, heat = rate(cfg.heat, "stratified"), np.exp(-2.0 * cfg.heat_lambda * np.abs(f))
    loss[on] += (rate(cfg.projection, "stratified") * value(f - label) + w * 0.5 * heat * (size * size + 1.0))[on]
    p[on] += (rate(cfg.projection, "stratified") * step(f - label) - w * cfg.heat_lambda * np.sign(f) * heat * (size * size + 1.0))[on]
    factor[on] += w * heat[on]
    return loss, p, factor[:, None] * g


def _inputs(pdf: pd.DataFrame, levels: int, features: int):
    """Corner weights (rows, levels, 8), their slopes, and the network's inputs with their tangents."""
    rows = len(pdf)
    boxes, feats = np.zeros((rows, levels, 4)), np.zeros((rows, levels, 8, features))
    boxes[:, :, 3] = 1.0
    for i, (b, fs) in enumerate(zip(pdf["boxes"], pdf["feats"])):
        b = np.asarray(b, float).reshape(-1, 4)
        boxes[i, : len(b)] = b
        for k, v in enumerate(fs):
            if v is not None:
                feats[i, k // 8, k % 8] = v
    edge = 2.0 * boxes[:, :, 3]
    at = (pdf[list(AXES)].to_numpy(float)[:, None, :] - boxes[:, :, :3]) / edge[:, :, None] + 0.5
    bits = (np.arange(8)[:, None] >> np.arange(3)) & 1
    part = np.where(bits, at[:, :, None, :], 1.0 - at[:, :, None, :])  # (rows, levels, 8, 3)
    weight, turn = part.prod(3), np.empty_like(part)
    for a in range(3):
        turn[..., a] = np.where(bits[:, a], 1.0, -1.0) * part[..., (a + 1) % 3] * part[..., (a + 2) % 3] / edge[:, :, None]
    prior, slopes = pdf["sdf_prior"].to_numpy(float), pdf[[f"grad_{a}" for a in AXES]].to_numpy(float)
    h = np.column_stack([prior, np.einsum("rlc,rlcf->rlf", weight, feats).reshape(rows, -1)])
    t = np.concatenate([slopes[:, :, None], np.einsum("rlca,rlcf->ralf", turn, feats).reshape(rows, 3, -1)], axis=2)
    return weight, turn, prior, slopes, h, t


def batch_pulls(pdf: pd.DataFrame, layers: Layers, cfg: fit.Losses, n: dict[str, int], levels: int, features: int, scale: float, slope: float):
    """Total loss, weight gradients and the pulls on the corner features (rows, levels * 8 * features) of a batch of samples."""
    rows = len(pdf)
    weight, turn, prior, slopes, h, t = _inputs(pdf, levels, features)
    values, tangents, bends, out, moved = _forward(layers, h, t, slope)
    loss, p, q = pulls_of(cfg, n, pdf["kind"].to_numpy(), pdf["behind"].to_numpy(bool), pdf["label"].to_numpy(float), prior + scale * out, slopes + scale * moved)
    back, tback, grads = scale * p[:, None], scale * q[:, :, None], []
    for k in range(len(layers) - 1, -1, -1):
        back, tback = back * bends[k], tback * bends[k][:, None, :]
        grads = [back.T @ values[k] + np.einsum("rao,rai->oi", tback, tangents[k]), back.sum(0), *grads]
        back, tback = back @ layers[k][0], tback @ layers[k][0]
    own = back[:, 1:].reshape(rows, levels, features)
    along = tback[:, :, 1:].reshape(rows, 3, levels, features)
    pulls = weight[..., None] * own[:, :, None, :] + np.einsum("rlca,ralf->rlcf", turn, along)
    return float(loss.sum()), grads, pulls.reshape(rows, -1)


def joint_pulls(rows: DataFrame, layers: Layers, cfg: fit.Losses, n: dict[str, int], levels: int, features: int, scale: float = 0.1, slope: float = 0.01) -> DataFrame:
    """(node, i, v): summed feature pulls per voxel, by place in its block; at node 0 the loss and the weight gradients."""

    def run(batches):
        for pdf in batches:
            if len(pdf):
                loss, grads, pulls = batch_pulls(pdf, layers, cfg, n, levels, features, scale, slope)
                nodes, inverse = np.unique(pdf["node"].to_numpy(), return_inverse=True)
                sums = np.zeros((len(nodes), pulls.shape[1]))
                np.add.at(sums, inverse, pulls)
                flat = np.concatenate([[loss], *[g.ravel() for g in grads]])
                yield pd.DataFrame({"node": np.append(nodes, 0), "v": [*sums, flat]})

    cols = ["node", *AXES, "kind", "behind", "label", "sdf_prior", *[f"grad_{a}" for a in AXES], "boxes", "feats"]
    sums = rows.select(*cols).mapInPandas(run, "node bigint, v array<double>").select("node", F.posexplode("v").alias("i", "v"))
    return sums.groupBy("node", "i").agg(F.sum("v").alias("v"))


def feature_pulls(sums: DataFrame, corners: DataFrame, features: int) -> DataFrame:
    """(vertex, d_feat): the voxels' pulls added up at their vertices."""
    each = sums.where("node <> 0").select("node", F.expr(f"CAST(i DIV {8 * features} AS INT)").alias("slot"), F.expr(f"CAST(i DIV {features} % 8 AS INT)").alias("corner"), F.expr(f"i % {features}").alias("k"), "v")
    met = each.join(corners.select("node", "slot", "corner", *VERTEX), ["node", "slot", "corner"])
    return met.groupBy(*VERTEX).agg(F.array(*[F.sum(F.when(F.col("k") == k, F.col("v")).otherwise(0.0)) for k in range(features)]).alias("d_feat"))


def _adam(c: str, rate: float, step: int, b1: float = 0.9, b2: float = 0.999) -> dict[str, F.Column]:
    """One Adam step of an array column ``c`` with pull ``d_<c>`` and moments ``m_<c>``, ``v_<c>``."""
    m = f"zip_with(m_{c}, d_{c}, (m, d) -> {b1}D * m + {1 - b1!r}D * coalesce(d, 0D))"
    v = f"zip_with(v_{c}, d_{c}, (v, d) -> {b2}D * v + {1 - b2!r}D * coalesce(d, 0D) * coalesce(d, 0D))"
    move = f"zip_with({m}, {v}, (m, v) -> {rate}D * (m / {1 - b1**step!r}D) / (sqrt(v / {1 - b2**step!r}D) + 1e-8D))"
    return {c: F.expr(f"zip_with({c}, {move}, (x, d) -> x - d)"), f"m_{c}": F.expr(m), f"v_{c}": F.expr(v)}


def fit_joint(
    samples: DataFrame, nodes: DataFrame, vertices: DataFrame, layers: Layers, res: float, depth: int, steps: int = 10, rate: float = 0.01,
    cfg: fit.Losses | None = None, levels: int = 2, scale: float = 0.1, separate_leaves: bool = False, on_step: Callable[[int, float], None] | None = None,
) -> tuple[DataFrame, Layers]:
    """L1 and L3 in one: Adam on the prior's vertex parameters, on the vertex features and on the network: (vertices with ``feat``, layers).

    ``vertices`` hold sdf, gx, gy, gz and ``feat`` (``initial_features``). ``on_step(step, loss)`` gets the weighted loss of the prediction. The weights, about a
    thousand numbers, are the only thing that passes through the driver.
    """
    cfg = cfg or fit.Losses()
    features = (layers[0][0].shape[1] - 1) // levels
    placed = cut(FD.locate(samples, nodes, res, depth).filter(F.col("node").isNotNull()).select("node", *AXES, "kind", "behind", "label"))
    n = {r["kind"]: r["n"] for r in placed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    used = cut(placed.select("node").distinct())
    corners = cut(level_corners(used, res, depth, levels, separate_leaves))
    boxed = cut(placed.join(FD.voxel_boxes(used, res, depth), "node"))
    names = ["sdf", *[f"g{a}" for a in AXES]]
    zeros = F.transform("feat", lambda x: F.lit(0.0))
    state = vertices.select(*VERTEX, *names, "feat").withColumns({f"{m}_{c}": F.lit(0.0) for c in names for m in "mv"} | {"m_feat": zeros, "v_feat": zeros})
    state = cut(state)
    m, v = ([(np.zeros_like(w), np.zeros_like(b)) for w, b in layers] for _ in range(2))
    own = corners.where("slot = 0").select("node", "corner", *VERTEX)
    for step in range(1, steps + 1):
        rows = cut(FD.interpolate(boxed.join(FD.join_corner_values(own, state), "node")))
        sums = cut(joint_pulls(rows.join(blocks_of(corners, state), "node"), layers, cfg, n, levels, features, scale))
        flat = np.array([r["v"] for r in sums.where("node = 0").orderBy("i").collect()])
        if on_step:
            on_step(step, float(flat[0]))
        joined = state.join(fit.vertex_pulls(fit.corner_pulls(rows, cfg, n), own), VERTEX, "left").join(feature_pulls(sums, corners, features), VERTEX, "left")
        joined = joined.withColumn("d_feat", F.coalesce("d_feat", zeros))
        new = _adam("feat", rate, step)
        for c in names:
            d = F.coalesce(F.col(f"d_{c}"), F.lit(0.0))
            new[f"m_{c}"], new[f"v_{c}"] = F.col(f"m_{c}") * 0.9 + d * 0.1, F.col(f"v_{c}") * 0.999 + d * d * 0.001
            new[c] = F.col(c) - F.lit(rate) * (new[f"m_{c}"] / (1 - 0.9**step)) / (F.sqrt(new[f"v_{c}"] / (1 - 0.999**step)) + 1e-8)
        before, state = state, cut(joined.withColumns(new).select(*state.columns))
        free(before, rows, sums)
        fresh, at = [], 1
        for k, pair in enumerate(layers):
            moved = []
            for j, x in enumerate(pair):
                g = flat[at : at + x.size].reshape(x.shape)
                at += x.size
                m[k][j][...] = 0.9 * m[k][j] + 0.1 * g
                v[k][j][...] = 0.999 * v[k][j] + 0.001 * g * g
                moved.append(x - rate * (m[k][j] / (1 - 0.9**step)) / (np.sqrt(v[k][j] / (1 - 0.999**step)) + 1e-8))
            fresh.append(tuple(moved))
        layers = fresh
    free(placed, used, corners, boxed)
    return state.select(*VERTEX, *names, "feat"), layers


def predict(points: DataFrame, nodes: DataFrame, vertices: DataFrame, layers: Layers, res: float, depth: int, levels: int = 2, scale: float = 0.1, slope: float = 0.01, separate_leaves: bool = False) -> DataFrame:
    """G7-G10 with the fitted model: points with node, sdf_prior, sdf_residual, sdf and the prediction's gradient; NULL where no voxel holds them."""
    features = (layers[0][0].shape[1] - 1) // levels
    found = FD.locate(points, nodes, res, depth)
    used = cut(found.where("node IS NOT NULL").select("node").distinct())
    corners = cut(level_corners(used, res, depth, levels, separate_leaves))
    own = corners.where("slot = 0").select("node", "corner", *VERTEX)
    table = FD.join_corner_values(own, vertices).join(FD.voxel_boxes(used, res, depth), "node").join(blocks_of(corners, vertices), "node")
    rows = FD.interpolate(found.join(table, "node", "left"))

    @F.pandas_udf("struct<r: double, x: double, y: double, z: double>")
    def residual(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((len(pdf), 4), np.nan)
        ok = pdf["feats"].notna().to_numpy() & pdf["sdf_prior"].notna().to_numpy()
        if ok.any():
            *_, h, t = _inputs(pdf[ok], levels, features)
            *_, value, moved = _forward(layers, h, t, slope)
            out[ok] = scale * np.column_stack([value, moved])
        return pd.DataFrame(out, columns=["r", *AXES])

    cols = [*AXES, "sdf_prior", *[f"grad_{a}" for a in AXES], "boxes", "feats"]
    rows = rows.withColumn("_r", F.when(F.col("sdf_prior").isNotNull(), residual(F.struct(*cols))))
    rows = rows.withColumn("sdf_residual", F.col("_r.r")).withColumn("sdf", F.col("sdf_prior") + F.col("sdf_residual"))
    rows = rows.withColumns({f"grad_{a}": F.col(f"grad_{a}") + F.col(f"_r.{a}") for a in AXES})
    return rows.select(*points.columns, "node", "sdf_prior", "sdf_residual", "sdf", *[f"grad_{a}" for a in AXES])
