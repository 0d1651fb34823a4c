"""The map that remembers: batches against the whole run, resumed Adam, losses over batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.plans import fit, incremental, mapping
from voxfield.session import exists


@pytest.fixture(scope="module")
def scans(spark):
    """Two rooms; a sensor inside a ball of radius 2 at five places, frames with the same numbers in both."""
    rng = np.random.default_rng(31)
    rows, poses = [], []
    for scene, reach in (("ball", 2.0), ("cave", 1.5)):
        for f, s in enumerate(np.array([[0.0, 0, 0], [0.6, 0.2, 0], [0.6, 0.2, 0.05], [-0.5, 0.4, 0.3], [0.1, -0.6, 0.2]]) * reach / 2):
            d = rng.normal(size=(500, 3))
            d /= np.linalg.norm(d, axis=1, keepdims=True)
            b = d @ s
            rows += [(scene, f, i, *p) for i, p in enumerate(d * (-b + np.sqrt(b * b - s @ s + reach * reach))[:, None])]
            pose = np.eye(4)
            pose[:3, 3] = s
            poses.append((scene, f, pose.ravel().tolist()))
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["scene", "frame_id", "pt_id", "x", "y", "z"]))
    return points, spark.createDataFrame(poses, "scene string, frame_id bigint, pose array<double>")


def config(**kw):
    losses = fit.Losses(eikonal={"surface": 0.1, "perturbation": 0.1, "space": 0.1}, eta=0.05)
    return mapping.MapConfig(**{"res": 0.4, "depth": 5, "full_depth": 3, "insert_ratio": 0.9, "rays": 300, "sigma": 0.15, "rate": 0.1, "steps": 3, "losses": losses, **kw})


def keys_of(state):
    return sorted((r.scene, r.frame_id) for r in state.keys.collect())


def test_batches_give_the_key_frames_and_voxels_of_the_whole_run(spark, scans):
    points, poses = scans
    cfg = config()
    ends = []
    for cuts in ([[0, 1, 2, 3, 4]], [[0, 1], [2], [3, 4]], [[0], [1], [1], [2, 0], [3], [4]]):
        state = incremental.empty_state(spark)
        for frames in cuts:
            state, _ = incremental.insert(state, points.where(F.col("frame_id").isin(frames)), poses, cfg)
        replayed = sorted((r.scene, r.frame_id) for r in state.replay.select("scene", "frame_id").distinct().collect())
        assert replayed == keys_of(state)
        ends.append((keys_of(state), sorted(map(tuple, state.voxels.collect())), state.known.count()))
    assert ends[0] == ends[1] == ends[2] and ends[0][2] == 10
    scenes = [k[0] for k in ends[0][0]]
    assert 2 <= scenes.count("ball") <= 5 and scenes.count("cave") >= 2


def test_start_counts_of_new_key_frames(spark):
    keys = spark.createDataFrame([("a", 1, 10), ("a", 2, 11)], "scene string, frame_id bigint, samples bigint")
    picked = spark.createDataFrame([("a", 9), ("a", 5), ("b", 1), ("b", 2)], "scene string, frame_id bigint")
    got = {(r.scene, r.frame_id): r.samples for r in incremental._with_start_counts(keys, picked).collect()}
    assert got == {("a", 5): 21 // 4, ("a", 9): 26 // 5, ("b", 1): 0, ("b", 2): 0}


def test_losses_fall_over_batches_and_parts_stay(spark, scans):
    points, poses = scans
    cfg, losses, marks = config(steps=4), [], []
    state = incremental.empty_state(spark)
    hooks = {"on_step": lambda n, r: losses.append((n, r.first()["total"])), "on_end": lambda s, scene: marks.append((scene, s.steps[scene]))}
    ball = points.where("scene = 'ball'")
    for f in range(2):
        state = incremental.update(state, ball.where(F.col("frame_id") == f), poses, cfg, **hooks)
    steps = [n for n, _ in losses]
    assert steps == list(range(1, 9)) and marks == [("ball", 4), ("ball", 8)]
    assert losses[-1][1] < 0.85 * losses[0][1]
    counts = {r.frame_id: r.samples for r in state.keys.collect()}
    assert sum(counts.values()) > 300 and counts[0] > 0
    # A batch that is refused at its start stays inserted but is not fitted.
    before = state.steps["ball"]
    state = incremental.update(state, ball.where("frame_id = 2"), poses, cfg, on_start=lambda s, scene: False)
    assert state.steps["ball"] == before and state.known.count() == 3
    m = incremental.snapshot(state, "ball", cfg)
    got = mapping.field_of(m, cfg)(spark.createDataFrame([(1, 0.0, 1.9, 0.0)], "i int, x double, y double, z double")).first()
    assert got.sdf is not None
    assert m.vertices.select("ns", "vx", "vy", "vz").distinct().count() == m.vertices.count()


def test_idle_steps_are_those_of_adam(spark):
    row = dict(ns="shared", vx=1, vy=2, vz=3, at=4)
    rng = np.random.default_rng(2)
    want = {}
    for c in incremental.PARAMS:
        p, m, v = rng.normal(), rng.normal(), abs(rng.normal())
        row |= {c: p, f"m_{c}": m, f"v_{c}": v}
        for t in range(5, 31):
            m, v = 0.9 * m, 0.999 * v
            p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        want |= {c: p, f"m_{c}": m, f"v_{c}": v}
    df = spark.createDataFrame([tuple(row[n] for n in ("ns", "vx", "vy", "vz", "at", *want))], "ns string, vx int, vy int, vz int, at int, " + ", ".join(f"{c} double" for c in want))
    got = fit.idle_steps(df, 30, 0.05).first()
    assert got["at"] == 30 and all(abs(got[c] - want[c]) < 1e-12 for c in want)
    assert fit.idle_steps(df, 4, 0.05).first()["sdf"] == row["sdf"]


def test_resumed_fit_is_one_fit(spark):
    nodes = spark.createDataFrame([(n,) for n in [1, *range(8, 16)]], "node bigint")
    rng = np.random.default_rng(4)
    rows = [(*map(float, p), "stratified", False, float(p.sum())) for p in rng.uniform(-0.9, 0.9, (60, 3))]
    samples = spark.createDataFrame(rows, "x double, y double, z double, kind string, behind boolean, label double")
    start = fit.initial_vertices(nodes, 1)
    order = ["ns", "vx", "vy", "vz"]
    whole = fit.fit_vertices(samples, nodes, start, 1.0, 1, steps=4, rate=0.1).orderBy(*order).collect()
    half = fit.fit_vertices(samples, nodes, start, 1.0, 1, steps=2, rate=0.1, moments=True)
    both = fit.fit_vertices(samples, nodes, half, 1.0, 1, steps=2, rate=0.1, done=2).orderBy(*order).collect()
    assert [r[:4] for r in whole] == [r[:4] for r in both] and np.allclose([r[4:] for r in whole], [r[4:] for r in both])
    assert max(abs(r.sdf) for r in whole) > 0.2


def test_parts_rewrite_only_what_they_are_given(spark):
    table = incremental.Parts(spark, f"{incremental.shared_dir(spark)}/parts-test-{np.random.default_rng().integers(1 << 60)}", "v int")
    rows = lambda data: spark.createDataFrame(data, "v int, part bigint")
    assert table.get().count() == 0
    table.put(rows([(1, 1), (2, 2), (3, 2)]))
    table.put(rows([(4, 2)]))
    assert sorted(map(tuple, table.get().select("v", "part").collect())) == [(1, 1), (4, 2)]
    assert [r.v for r in table.get(spark.createDataFrame([(1,)], "part bigint")).collect()] == [1]
    table.put(rows([(5, 1)]))
    assert sorted(map(tuple, table.get().select("v", "part").collect())) == [(4, 2), (5, 1)]
    assert not exists(spark, f"{table.path}/version=0") and exists(spark, f"{table.path}/version=1")
