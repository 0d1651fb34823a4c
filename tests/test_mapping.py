import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.operators import mesh
from voxfield.plans import fit, mapping


@pytest.fixture(scope="module")
def room(spark):
    """A sensor inside a ball of radius 2 at three places."""
    rng = np.random.default_rng(25)
    spots = np.array([[0.0, 0, 0], [0.6, 0.2, 0], [-0.5, 0.4, 0.3]])
    rows, poses = [], []
    for f, s in enumerate(spots):
        d = rng.normal(size=(700, 3))
        d /= np.linalg.norm(d, axis=1, keepdims=True)
        b = d @ s
        t = -b + np.sqrt(b * b - s @ s + 4.0)
        rows += [("room", f, i, *p) for i, p in enumerate(d * t[:, None])]
        pose = np.eye(4)
        pose[:3, 3] = s
        poses.append(("room", f, pose.ravel().tolist()))
    poses.append(("room", 3, [float("nan")] * 16))
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["scene", "frame_id", "pt_id", "x", "y", "z"]))
    return points, spark.createDataFrame(poses, "scene string, frame_id bigint, pose array<double>")


def config(**kw):
    losses = fit.Losses(eikonal={"surface": 0.1, "perturbation": 0.1, "space": 0.1}, eta=0.05)
    return mapping.MapConfig(res=0.4, depth=5, full_depth=4, insert_ratio=0.95, rays=900, sigma=0.15, rate=0.12, steps=8, losses=losses, **kw)


def test_batch_mapping_learns_the_ball(spark, room):
    points, poses = room
    cfg = config()
    seen = []
    m = mapping.build_map(points, poses, cfg, lambda n, r: seen.append(r.first()["total"]))
    assert len(seen) == cfg.steps and seen[-1] < 0.75 * seen[0]
    assert 1 <= m.key_frames.count() <= 3
    rng = np.random.default_rng(26)
    d = rng.normal(size=(200, 3))
    p = d / np.linalg.norm(d, axis=1, keepdims=True) * rng.uniform(1.6, 2.1, (200, 1))
    test = pd.DataFrame(p, columns=list("xyz")).assign(i=np.arange(200))
    test["truth"] = 2.0 - np.linalg.norm(p, axis=1)
    for a, c in zip("xyz", (-p / np.linalg.norm(p, axis=1, keepdims=True)).T):
        test[f"t{a}"] = c
    test["region"] = np.where(test.truth.abs() < 0.2, "near", "far")
    got = mapping.evaluate_field(spark.createDataFrame(test), mapping.field_of(m, cfg)).toPandas()
    mae = got[(got.field == "sdf") & (got.region == "all") & (got.metric == "mae")].value.iloc[0]
    assert mae < 0.15, got


def test_surface_scores_of_equal_and_moved_meshes(spark):
    v = [(0.0 if not i & 1 else 1.0, 0.0 if not i & 2 else 1.0, 0.0 if not i & 4 else 1.0) for i in range(8)]
    f = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    vertices = spark.createDataFrame([(i, *p) for i, p in enumerate(v)], "vid int, x double, y double, z double")
    faces = spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid int, a int, b int, c int")
    cube = mesh.triangle_corners(faces, vertices)
    far = mesh.triangle_corners(faces, vertices.withColumn("x", F.col("x") + 10))
    same = mapping.evaluate_surface(cube, cube, 2000, 0.1).first()
    assert same.f1 > 0.99 and same.chamfer < 0.05
    apart = mapping.evaluate_surface(cube, far, 500, 0.1).first()
    assert apart.f1 == 0.0 and apart.chamfer > 8

    grid = spark.createDataFrame([(i, 0.5, 0.5, -0.5 + 0.25 * i) for i in range(9)], "id int, x double, y double, z double")
    rows = mapping.make_test_set(grid, cube, 0.001, (-0.1, 0.1), 3.0).orderBy("id").collect()
    assert np.allclose([r.truth for r in rows], [0.5, 0.25, 0.0, -0.25, -0.5, -0.25, 0.0, 0.25, 0.5])
    assert abs(rows[0].tz + 1.0) < 1e-6 and abs(rows[8].tz - 1.0) < 1e-6
    assert rows[0].region == "far" and rows[2].region == "near"
