"""Losses of the distance field and its iterative fit.

The field is linear in the vertex parameters, so every loss term has a closed sub-gradient: with weight w_i of
corner i, slope dw_i and offset o_i = x - corner_i, a pull of P on the value and Q on the gradient adds
A_i = P w_i + Q . dw_i to the corner's value and A_i o_i + w_i Q to its gradient.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.operators import field as FD
from voxfield.operators import voxelmap as V
from voxfield.operators.metrics import masked_mean
from voxfield.session import cut, free

AXES = "xyz"
KIND = {"surface": "surface", "perturbed": "perturbation", "stratified": "space"}


@dataclass
class Losses:
    """Weights and shapes of the loss terms; the report covers terms of weight 0 as well."""

    boundary: float = 1.0
    perturbation: float = 1.0
    eikonal: dict[str, float] = field(default_factory=lambda: {"surface": 1.0, "perturbation": 1.0, "space": 1.0})
    projection: float = 1.0
    heat: float = 0.0
    squared: bool = False
    exp_penalty: float = 1.0
    eta: float = 0.1
    heat_lambda: float = 0.0
    temperature: float = 100.0


def _sign(cond: Column) -> Column:
    return F.when(cond, F.lit(-1.0)).otherwise(F.lit(1.0))


def term_columns(cfg: Losses, value: str, grad: list[str]) -> dict[str, tuple[str, Column]]:
    """L2: per-sample loss terms as name -> (sample kind, value)."""
    f, y = F.col(value), F.col("label")
    g = G.norm(G.vec(*grad))
    size = (lambda c: c * c) if cfg.squared else F.abs
    s = _sign(F.col("behind"))
    below = F.greatest(F.lit(cfg.eta) - s * f, F.lit(0.0))
    terms = {
        "boundary": ("surface", size(f)),
        "perturbation": ("perturbed", F.greatest(s * f - s * y, F.lit(0.0)) + F.exp(F.lit(cfg.exp_penalty) * below) - 1.0),
        "projection": ("stratified", size(f - y)),
        "heat": ("stratified", 0.5 * F.exp(F.lit(-2.0 * cfg.heat_lambda) * F.abs(f)) * (g * g + 1.0)),
        "sign_free": ("perturbed+", F.abs(F.tanh(F.lit(cfg.temperature) * f) - 1.0)),
        "sign_occ": ("perturbed-", F.abs(F.tanh(F.lit(cfg.temperature) * f) + 1.0)),
    }
    for kind, name in KIND.items():
        terms[f"eikonal_{name}"] = (kind, size(g - 1.0))
    return terms


def _mask(kind: str) -> Column:
    if kind == "perturbed+":
        return (F.col("kind") != "surface") & ~F.col("behind")
    if kind == "perturbed-":
        return (F.col("kind") != "surface") & F.col("behind")
    return F.col("kind") == kind


def _weight(cfg: Losses, name: str) -> float:
    if name.startswith("eikonal_"):
        return cfg.eikonal[name.removeprefix("eikonal_")]
    return {"boundary": cfg.boundary, "perturbation": cfg.perturbation, "projection": cfg.projection, "heat": cfg.heat}.get(name, 0.0)


def loss_report(samples: DataFrame, cfg: Losses, fields: dict[str, tuple[str, list[str]]]) -> DataFrame:
    """One row of masked means, ``<term>_<field>``, and their weighted ``total``.

    ``fields`` maps a name (sdf, prior) to its value and gradient columns. Sign terms are report-only. All
    terms come from one aggregation of the samples.
    """
    aggs, total = [], None
    for name, (value, grad) in fields.items():
        for term, (kind, per_row) in term_columns(cfg, value, grad).items():
            mean = masked_mean(per_row, _mask(kind) & F.col(value).isNotNull())
            aggs.append(mean.alias(f"{term}_{name}"))
            weight = _weight(cfg, term)
            if weight:
                part = F.col(f"{term}_{name}") * F.lit(weight)
                total = part if total is None else total + part
    out = samples.agg(*aggs)
    return out.withColumn("total", total if total is not None else F.lit(0.0))


def _pulls(cfg: Losses, n: dict[str, int]) -> tuple[Column, list[Column]]:
    """Sub-gradients of the weighted total by the sample's value (P) and gradient (Q)."""
    f, y = F.col("sdf_prior"), F.col("label")
    g = [F.col(f"grad_{a}") for a in AXES]
    size = G.norm(g)
    kind = F.col("kind")
    scale = lambda w, k: F.lit(w / max(n.get(k, 0), 1))
    step = (lambda c: 2.0 * c) if cfg.squared else F.signum
    s = _sign(F.col("behind"))
    below = F.lit(cfg.eta) - s * f
    hinge = F.when(s * f - s * y > 0, F.lit(1.0)).otherwise(F.lit(0.0))
    bend = F.when(below > 0, F.lit(cfg.exp_penalty) * F.exp(F.lit(cfg.exp_penalty) * below)).otherwise(F.lit(0.0))
    heat = F.exp(F.lit(-2.0 * cfg.heat_lambda) * F.abs(f))
    p = (
        F.when(kind == "surface", scale(cfg.boundary, "surface") * step(f))
        .when(kind == "perturbed", scale(cfg.perturbation, "perturbed") * s * (hinge - bend))
        .otherwise(
            scale(cfg.projection, "stratified") * step(f - y)
            - scale(cfg.heat, "stratified") * F.lit(cfg.heat_lambda) * F.signum(f) * heat * (size * size + 1.0)
        )
    )
    slope = F.when(kind == "surface", scale(cfg.eikonal["surface"], "surface")).when(
        kind == "perturbed", scale(cfg.eikonal["perturbation"], "perturbed")
    ).otherwise(scale(cfg.eikonal["space"], "stratified"))
    unit = F.coalesce(G.safe_div(F.lit(1.0), size), F.lit(0.0))
    warm = F.when(kind == "stratified", scale(cfg.heat, "stratified") * heat).otherwise(F.lit(0.0))
    factor = slope * step(size - 1.0) * unit + warm
    return p, [factor * c for c in g]


def pull_sums() -> tuple[dict[str, Column], list[Column]]:
    """Per-corner pulls A_i and weights w_i of a sample, and the sums a<i>, bx<i>.. over a voxel."""
    parts, sums = {}, []
    for i in range(8):
        bits = [i >> b & 1 for b in range(3)]
        w = [f"p{a}" if bit else f"(1 - p{a})" for a, bit in zip(AXES, bits)]
        turn = " + ".join(
            f"{'' if bits[b] else '-'}_q{a} * {w[(b + 1) % 3]} * {w[(b + 2) % 3]}" for b, a in enumerate(AXES)
        )
        parts[f"_w{i}"] = F.expr(" * ".join(w))
        parts[f"_a{i}"] = F.expr(f"_p * {' * '.join(w)} + ({turn}) / (half * 2.0D)")
        sums.append(F.sum(f"_a{i}").alias(f"a{i}"))
        sums += [
            F.expr(f"sum(_a{i} * half * 2.0D * (p{a} - {bit}) + _w{i} * _q{a})").alias(f"b{a}{i}") for a, bit in zip(AXES, bits)
        ]
    return parts, sums


def corner_pulls(rows: DataFrame, cfg: Losses, n: dict[str, int]) -> DataFrame:
    """Summed parameter sub-gradients per voxel: (node, a0..a7, bx0..bz7). Combined before any shuffle."""
    p, q = _pulls(cfg, n)
    parts, sums = pull_sums()
    rows = rows.withColumns({"_p": p, **{f"_q{a}": c for a, c in zip(AXES, q)}, **FD.unit_coords()})
    return rows.withColumns(parts).groupBy("node").agg(*sums)


def vertex_pulls(pulls: DataFrame, corners: DataFrame) -> DataFrame:
    """Sub-gradients per vertex from those per voxel, over the corner list (node, corner, ns, vx, vy, vz)."""
    met = corners.join(pulls, "node")
    pick = lambda stem: F.expr("element_at(array(" + ", ".join(f"{stem}{i}" for i in range(8)) + "), corner + 1)")
    met = met.select("ns", "vx", "vy", "vz", pick("a").alias("d_sdf"), *[pick(f"b{a}").alias(f"d_g{a}") for a in AXES])
    names = ["d_sdf", *[f"d_g{a}" for a in AXES]]
    return met.groupBy("ns", "vx", "vy", "vz").agg(*[F.sum(c).alias(c) for c in names])


def initial_vertices(nodes: DataFrame, depth: int, separate_leaves: bool = False, sdf: float = 0.0) -> DataFrame:
    """A fresh vertex table: every corner at ``sdf`` with no slope."""
    table = V.vertex_table(nodes, depth, separate_leaves=separate_leaves)
    return table.select("*", F.lit(float(sdf)).alias("sdf"), *[F.lit(0.0).alias(f"g{a}") for a in AXES])


def fit_vertices(
    samples: DataFrame,
    nodes: DataFrame,
    vertices: DataFrame,
    res: float,
    depth: int,
    steps: int = 10,
    rate: float = 0.01,
    cfg: Losses | None = None,
    betas: tuple[float, float] = (0.9, 0.999),
    separate_leaves: bool = False,
    on_step: Callable[[int, DataFrame], None] | None = None,
    done: int = 0,
    moments: bool = False,
) -> DataFrame:
    """L1: Adam on the vertex parameters from labelled samples (x, y, z, kind, behind, label).

    Sample voxels are looked up once. A step joins samples with corner rows, sums sub-gradients per voxel in
    the map side, spreads them to vertices and updates the parameters and both Adam moments, which are columns of
    the vertex table. Each step's table is written to the shared folder, so the plan does not grow.
    ``on_step(step, losses)`` gets the loss row of every step (V3). ``done`` steps came before; moments that the vertices
    bring are carried on, and returned with ``moments``. Rows of other columns keep them.
    """
    cfg = cfg or Losses()
    placed = FD.locate(samples, nodes, res, depth).filter(F.col("node").isNotNull())
    placed = cut(placed.select("node", *AXES, "kind", "behind", "label"))
    n = {r["kind"]: r["n"] for r in placed.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    used = placed.select("node").distinct()
    names = ["sdf", *[f"g{a}" for a in AXES]]
    held = [f"{m}_{c}" for c in names for m in "mv"]
    state = vertices.withColumns({c: F.lit(0.0) for c in held if c not in vertices.columns})
    state = cut(state.select("ns", "vx", "vy", "vz", *names, *held))
    # What does not change over the steps is laid out once.
    used = cut(used)
    corners = cut(V.voxel_corners(used, depth, separate_leaves=separate_leaves))
    placed = cut(placed.join(FD.voxel_boxes(used, res, depth), "node"))
    for step in range(done + 1, done + steps + 1):
        rows = FD.interpolate(placed.join(FD.join_corner_values(corners, state), "node"))
        if on_step:
            on_step(step, loss_report(rows, cfg, {"prior": ("sdf_prior", [f"grad_{a}" for a in AXES])}))
        pulls = vertex_pulls(corner_pulls(rows, cfg, n), corners)
        joined = state.join(pulls, ["ns", "vx", "vy", "vz"], "left")
        new = {}
        for c in names:
            d = F.coalesce(F.col(f"d_{c}"), F.lit(0.0))
            m = F.col(f"m_{c}") * betas[0] + d * (1 - betas[0])
            v = F.col(f"v_{c}") * betas[1] + d * d * (1 - betas[1])
            new[f"m_{c}"], new[f"v_{c}"] = m, v
            new[c] = F.col(c) - F.lit(rate) * (m / (1 - betas[0] ** step)) / (F.sqrt(v / (1 - betas[1] ** step)) + 1e-8)
        before, state = state, cut(joined.withColumns(new).select(*state.columns))
        free(before)
    free(placed, used, corners)
    return state if moments else state.select("ns", "vx", "vy", "vz", *names)


def idle_steps(vertices: DataFrame, upto: int, rate: float, betas: tuple[float, float] = (0.9, 0.999), last: str = "at") -> DataFrame:
    """Adam steps without a pull, from step ``last`` of each vertex to ``upto``: what the moments still move is added in one go.

    Steps after the 400th add less than the last digit of a double (0.9^400 < 1e-18) and only shrink the moments.
    """
    names = ["sdf", *[f"g{a}" for a in AXES]]
    k, b1, b2 = f"({upto} - {last})", betas[0], betas[1]
    out = {}
    for c in names:
        term = (
            f"(m_{c} * pow({b1}D, j) / (1 - pow({b1}D, {last} + j))) / (sqrt(v_{c} * pow({b2}D, j) / (1 - pow({b2}D, {last} + j))) + 1e-8D)"
        )
        moved = f"aggregate(sequence(1, least({k}, 400)), 0D, (s, j) -> s + {term})"
        out[c] = F.expr(f"if({k} <= 0 OR m_{c} = 0, {c}, {c} - {rate}D * {moved})")
        out[f"m_{c}"] = F.expr(f"m_{c} * pow({b1}D, {k})")
        out[f"v_{c}"] = F.expr(f"v_{c} * pow({b2}D, {k})")
    return vertices.select(*[out[c].alias(c) if c in out else F.lit(upto).alias(c) if c == last else F.col(c) for c in vertices.columns])


# -- L3: the residual network ----------------------------------------------------------------------


def random_layers(inputs: int, hidden: tuple[int, ...] = (32, 32), seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    sizes = [inputs, *hidden, 1]
    return [
        (rng.uniform(-1, 1, (o, i)) / np.sqrt(i), rng.uniform(-1, 1, o) / np.sqrt(i)) for i, o in zip(sizes, sizes[1:])
    ]


def residual_gradient(rows: DataFrame, layers: list[tuple[np.ndarray, np.ndarray]], scale: float = 0.1, slope: float = 0.01) -> tuple[float, list]:
    """Mean squared residual error and its gradient over rows (sdf_prior, feat, label).

    Each Arrow batch gives one partial sum of about a thousand numbers; the sums are added up on Spark.
    """
    sizes = [(w.shape, b.shape) for w, b in layers]

    def partial(batches):
        total = None
        for pdf in batches:
            if not len(pdf):
                continue
            h = np.column_stack([pdf["sdf_prior"].to_numpy(float), np.stack(pdf["feat"].to_numpy())])
            inputs, pre = [], []
            for n, (w, b) in enumerate(layers):
                inputs.append(h)
                z = h @ w.T + b
                pre.append(z)
                h = np.where(z >= 0, z, slope * z) if n + 1 < len(layers) else z
            err = pdf["sdf_prior"].to_numpy(float) + scale * h[:, 0] - pdf["label"].to_numpy(float)
            back = (2.0 * scale * err)[:, None]
            grads = []
            for n in range(len(layers) - 1, -1, -1):
                if n + 1 < len(layers):
                    back = back * np.where(pre[n] >= 0, 1.0, slope)
                grads = [back.T @ inputs[n], back.sum(0), *grads]
                back = back @ layers[n][0]
            flat = np.concatenate([[len(pdf), float(err @ err)], *[g.ravel() for g in grads]])
            total = flat if total is None else total + flat
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    sums = rows.select("sdf_prior", "feat", "label").mapInPandas(partial, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.array([r["v"] for r in sums.orderBy("i").collect()])
    n, loss, rest = max(flat[0], 1.0), flat[1], flat[2:]
    out, at = [], 0
    for w_shape, b_shape in sizes:
        w_size, b_size = int(np.prod(w_shape)), int(np.prod(b_shape))
        out.append((rest[at : at + w_size].reshape(w_shape) / n, rest[at + w_size : at + w_size + b_size].reshape(b_shape) / n))
        at += w_size + b_size
    return loss / n, out


def fit_residual(rows: DataFrame, layers, steps: int = 10, rate: float = 0.01, scale: float = 0.1):
    """L3: Adam on the network weights, one data-parallel gradient pass per step: (layers, losses)."""
    rows = cut(rows.select("sdf_prior", "feat", "label").filter(F.col("sdf_prior").isNotNull()))
    m = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    v = [(np.zeros_like(w), np.zeros_like(b)) for w, b in layers]
    losses = []
    for step in range(1, steps + 1):
        loss, grads = residual_gradient(rows, layers, scale)
        losses.append(loss)
        fresh = []
        for n, pair in enumerate(grads):
            moved = []
            for k, g in enumerate(pair):
                m[n][k][...] = 0.9 * m[n][k] + 0.1 * g
                v[n][k][...] = 0.999 * v[n][k] + 0.001 * g * g
                moved.append(layers[n][k] - rate * (m[n][k] / (1 - 0.9**step)) / (np.sqrt(v[n][k] / (1 - 0.999**step)) + 1e-8))
            fresh.append(tuple(moved))
        layers = fresh
    return layers, losses


def iteration_schedule(seen_frames: int, first: int = 3, first_steps: int = 10, later_steps: int = 1) -> int:
    """L4: fit steps for the next frame: more for the first few."""
    return first_steps if seen_frames < first else later_steps
