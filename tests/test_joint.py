"""The joint fit of prior, features and network: gradients against finite differences, and a fit that learns."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.plans import fit, joint

LEVELS, FEATURES = 2, 3


def batch(rng, rows=40):
    kind = rng.choice(["surface", "perturbed", "stratified"], rows)
    boxes = np.concatenate([np.zeros((rows, 1, 3)), np.full((rows, 1, 1), 1.0), np.full((rows, 1, 3), 0.5), np.full((rows, 1, 1), 2.0)], axis=2).reshape(rows, -1)
    data = {a: rng.uniform(-0.9, 0.9, rows) for a in "xyz"} | {f"grad_{a}": rng.normal(size=rows) for a in "xyz"}
    feats = [list(rng.normal(size=(LEVELS * 8, FEATURES))) for _ in range(rows)]
    return pd.DataFrame(data | {"kind": kind, "behind": rng.uniform(size=rows) < 0.4, "label": rng.normal(size=rows), "sdf_prior": rng.normal(size=rows), "boxes": list(boxes), "feats": feats})


@pytest.mark.parametrize("squared", [False, True])
def test_gradients_against_differences(squared):
    rng = np.random.default_rng(12)
    pdf, layers = batch(rng), fit.random_layers(1 + LEVELS * FEATURES, (6, 5))
    cfg = fit.Losses(heat=0.3, heat_lambda=0.7, exp_penalty=1.5, eta=0.3, squared=squared)
    n = pdf.groupby("kind").size().to_dict()
    run = lambda p, ls: joint.batch_pulls(p, ls, cfg, n, LEVELS, FEATURES, 0.5, 0.01)
    _, grads, pulls = run(pdf, layers)
    eps, flat = 1e-6, [x for pair in layers for x in pair]
    for k in range(len(flat)):
        for at in [tuple(rng.integers(0, s) for s in flat[k].shape) for _ in range(4)]:
            ends = []
            for sign in (1, -1):
                moved = [x.copy() for x in flat]
                moved[k][at] += sign * eps
                ends.append(run(pdf, list(zip(moved[::2], moved[1::2])))[0])
            assert abs((ends[0] - ends[1]) / (2 * eps) - grads[k][at]) < 1e-4 * max(1, abs(grads[k][at]))
    for row, place in zip(rng.integers(0, len(pdf), 25), rng.integers(0, LEVELS * 8 * FEATURES, 25)):
        ends = []
        for sign in (1, -1):
            feats = [[np.array(v) for v in r] for r in pdf["feats"]]
            feats[row][place // FEATURES][place % FEATURES] += sign * eps
            ends.append(run(pdf.assign(feats=feats), layers)[0])
        assert abs((ends[0] - ends[1]) / (2 * eps) - pulls[row, place]) < 1e-4 * max(1, abs(pulls[row, place]))


def test_joint_fit_learns_and_moves_features(spark):
    rng = np.random.default_rng(13)
    nodes = spark.createDataFrame([(n,) for n in [1, *range(8, 16)]], "node bigint")
    p = rng.uniform(-0.95, 0.95, (80, 3))
    rows = [(*map(float, x), k, bool(d < 0), 0.0 if k == "surface" else float(d)) for x, k, d in zip(p, rng.choice(["stratified", "surface", "perturbed"], 80, p=[0.6, 0.2, 0.2]), np.linalg.norm(p, axis=1) - 0.8)]
    samples = spark.createDataFrame(rows + [(9.0, 9.0, 9.0, "stratified", False, 1.0)], "x double, y double, z double, kind string, behind boolean, label double")
    start = joint.initial_features(fit.initial_vertices(nodes, 1), FEATURES).cache()
    losses, cfg = [], fit.Losses(heat=0.1, eikonal={"surface": 0.1, "perturbation": 0.1, "space": 0.1}, perturbation=0.2)
    layers = fit.random_layers(1 + LEVELS * FEATURES, (6,))
    vertices, after = joint.fit_joint(samples, nodes, start, layers, 1.0, 1, steps=4, rate=0.05, cfg=cfg, levels=LEVELS, scale=0.5, on_step=lambda i, x: losses.append(x))
    assert len(losses) == 4 and losses[-1] < losses[0]
    moved = vertices.join(start.select(*joint.VERTEX, F.col("feat").alias("old")), joint.VERTEX).select("feat", "old", "sdf").collect()
    assert len(moved) == 27 and sum(r.feat != r.old for r in moved) == 27 and any(r.sdf for r in moved)
    assert not np.allclose(after[0][0], layers[0][0])
    # The prediction is prior plus residual, and its gradient the slope of that.
    eps = 1e-5
    asked = [(0, 0.31, -0.42, 0.17)] + [(1 + 2 * a + s, *(np.array([0.31, -0.42, 0.17]) + np.eye(3)[a] * (1, -1)[s] * eps)) for a in range(3) for s in (0, 1)] + [(9, 5.0, 5.0, 5.0)]
    points = spark.createDataFrame([(i, *map(float, q)) for i, *q in asked], "i int, x double, y double, z double")
    got = {r.i: r for r in joint.predict(points, nodes, vertices, after, 1.0, 1, LEVELS, 0.5).collect()}
    assert got[9].sdf is None and abs(got[0].sdf - got[0].sdf_prior - got[0].sdf_residual) < 1e-12 and got[0].sdf_residual != 0
    for a in range(3):
        assert abs((got[1 + 2 * a].sdf - got[2 + 2 * a].sdf) / (2 * eps) - got[0][f"grad_{'xyz'[a]}"]) < 1e-5
