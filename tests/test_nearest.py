import numpy as np
import pandas as pd
import pytest

from voxfield.operators import mesh
from voxfield.operators import nearest as N
from voxfield.session import cut


def frame(points, name):
    return pd.DataFrame({name: np.arange(len(points)), "x": points[:, 0], "y": points[:, 1], "z": points[:, 2]})


def brute(src, dst):
    out_d, out_i = [], []
    for part in np.array_split(src, max(1, len(src) // 200)):
        d = ((part[:, None, :] - dst[None]) ** 2).sum(-1)
        best = d.min(1)
        out_d += list(np.sqrt(best))
        out_i += list((d == best[:, None]).argmax(1))
    return np.array(out_d), np.array(out_i)


RNG = np.random.default_rng(6)
CASES = {
    "uniform": (RNG.random((500, 3)), RNG.random((400, 3))),
    "far away": (RNG.random((100, 3)) * 50 - 20, RNG.random((300, 3))),
    # A third of both sides in one tiny spot, a third in copies of one point.
    "hot spot and copies": (
        np.concatenate([RNG.random((300, 3)), 0.3 + 1e-5 * RNG.random((300, 3)), np.full((300, 3), 0.7)]),
        np.concatenate([RNG.random((300, 3)), 0.3 + 1e-5 * RNG.random((300, 3)), np.full((300, 3), 0.70001)]),
    ),
    "one target": (RNG.random((50, 3)), np.array([[0.5, 0.5, 0.5]])),
    "flat": (np.c_[RNG.random((200, 2)), np.zeros(200)], np.c_[RNG.random((200, 2)), np.zeros(200)]),
    "integer ties": (RNG.integers(0, 6, (200, 3)) + 0.5, RNG.integers(0, 6, (150, 3)).astype(float)),
}


@pytest.mark.parametrize("case", CASES)
def test_nearest_points_is_exact(spark, case):
    src, dst = CASES[case]
    got = N.nearest_points(spark.createDataFrame(frame(src, "s")), spark.createDataFrame(frame(dst, "d")), "s", "d")
    got = got.toPandas().set_index("s").loc[np.arange(len(src))]
    d, i = brute(src, dst)
    assert np.allclose(got.dist, d, rtol=0, atol=1e-12)
    assert (got.d.to_numpy() == i).all()


@pytest.mark.parametrize("case", ["far away", "hot spot and copies", "integer ties"])
def test_many_points_are_searched_by_leaves(spark, case, monkeypatch):
    """Large trees: leaves that fill up, queries of one leaf in several parts, distances in several blocks, no walk by shuffled levels."""
    for name, value in (("MANY", 0), ("PER_LEAF", 8), ("GROUP", 40), ("PAIRS", 100), ("_descend", None)):
        monkeypatch.setattr(N, name, value)
    test_nearest_points_is_exact(spark, case)


def test_slices_of_queries_walk_boxes_as_brute_force(monkeypatch):
    """Every size of tree, slices that are halved for want of room, bounds from outside, queries far away, and ties."""
    rng = np.random.default_rng(21)
    monkeypatch.setattr(N, "PAIRS", 300)
    for n in (1, 2, 15, 17, 64, 65, 900):
        dst = np.concatenate([rng.random((n, 3)), rng.integers(0, 3, (n // 2, 3)).astype(float)])
        src = np.concatenate([rng.random((120, 3)), rng.integers(0, 3, (60, 3)) + 0.5, 1e6 + rng.random((20, 3)), dst[:5]])
        d = ((src[:, None] - dst[None]) ** 2).sum(-1)
        bound = np.where(np.arange(len(src)) % 3 == 0, d.min(1), np.where(np.arange(len(src)) % 3 == 1, np.inf, d.min(1) * 0.9))
        got, at = N._closest(src.T.copy(), bound, dst)
        on = at >= 0
        assert np.allclose(got[on], d.min(1)[on], rtol=1e-12, atol=0) and (on | (np.arange(len(src)) % 3 == 2)).all()
        assert all(d[i, at[i]] == got[i] and at[i] == np.flatnonzero(d[i] == got[i])[0] for i in np.flatnonzero(on))


def test_cuts_reach_every_point_and_balance(monkeypatch):
    rng = np.random.default_rng(22)
    # Far outliers, a dense spot, and one axis with few values.
    p = np.concatenate([rng.random((4000, 3)), 0.5 + 1e-12 * rng.random((4000, 3)), [[1e12, 0, 0]], np.c_[rng.integers(0, 2, 2000), rng.random((2000, 2))]])
    cuts = N._cuts(p, 100)
    size = np.bincount(N._leaf_of(cuts, p))
    assert size.max() <= 100 and len(size) < 4 * len(p) / 100
    assert (N._leaf_of(N._cuts(np.zeros((50, 3)), 10), np.zeros((3, 3))) == 0).all()


def test_many_points_take_two_shuffles_of_the_queries(spark, monkeypatch):
    """Queries of few distinct places and a target far off: no step multiplies the queries by the targets."""
    monkeypatch.setattr(N, "MANY", 100)
    monkeypatch.setattr(N, "PER_LEAF", 64)
    tables = []
    monkeypatch.setattr(N, "cut", lambda df: (tables.append(out := cut(df)), out)[1])
    rng = np.random.default_rng(23)
    src, dst = np.repeat(rng.random((300, 3)), 5, axis=0), np.concatenate([rng.random((1500, 3)), [[1e9, 0, 0]]])
    got = N.nearest_points(spark.createDataFrame(frame(src, "s")), spark.createDataFrame(frame(dst, "d")), "s", "d").toPandas().set_index("s").loc[np.arange(len(src))]
    assert np.allclose(got.dist, brute(src, dst)[0], rtol=0, atol=1e-12) and (got.d == brute(src, dst)[1]).all()
    first = next(t for t in tables if "others" in t.columns)
    others = first.selectExpr("sum(size(others))").first()[0]
    assert first.count() == len(src) and others < 3 * len(src)


def test_empty_target_gives_no_rows(spark):
    src = spark.createDataFrame(frame(np.random.rand(5, 3), "s"))
    dst = spark.createDataFrame(frame(np.random.rand(1, 3), "d")).filter("d < 0")
    assert N.nearest_points(src, dst, "s", "d").count() == 0


def cube(spark, low=0.0, high=1.0):
    """A closed cube with outward triangles."""
    v = [(low if not i & 1 else high, low if not i & 2 else high, low if not i & 4 else high) for i in range(8)]
    f = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    vertices = spark.createDataFrame([(i, *p) for i, p in enumerate(v)], "vid bigint, x double, y double, z double")
    triangles = spark.createDataFrame([(i, *t) for i, t in enumerate(f)], "fid bigint, a bigint, b bigint, c bigint")
    return mesh.triangle_corners(triangles, vertices)


def test_a_small_tree_is_walked_in_one_job(spark, monkeypatch):
    rng = np.random.default_rng(9)
    src, dst = rng.random((400, 3)), rng.random((600, 3))
    tables = []
    monkeypatch.setattr(N, "cut", lambda df: (tables.append(df), cut(df))[1])
    near = N.nearest_points(spark.createDataFrame(frame(src, "s")), spark.createDataFrame(frame(dst, "d")), "s", "d")
    # No table of queries between the levels of the tree, and no shuffle of them after the first by query.
    assert not any("ub2" in t.columns for t in tables)
    assert near._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(qid") == 1
    got = near.toPandas().set_index("s").loc[np.arange(len(src))]
    assert np.allclose(got.dist, brute(src, dst)[0], rtol=0, atol=1e-12)


def test_corner_lookup_sends_no_table_through_the_driver(spark):
    # Rows multiply after the scan, which the planner's size of them does not show.
    plan = cube(spark)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_cube_signed_distance_and_area(spark):
    corners = cube(spark)
    assert abs(mesh.with_area(corners).agg({"area": "sum"}).first()[0] - 6.0) < 1e-12
    p = RNG.random((300, 3)) * 3 - 1
    got = mesh.mesh_sdf(spark.createDataFrame(frame(p, "q")), corners, "q").toPandas().set_index("q").loc[np.arange(len(p))]
    q = np.abs(p - 0.5) - 0.5
    want = np.linalg.norm(np.maximum(q, 0), axis=1) + np.minimum(q.max(1), 0)
    assert np.allclose(got.sdf, want)
    assert mesh.outward_sign(corners, samples=200) == 1.0


def test_surface_samples_follow_the_area(spark):
    # One triangle has 99 % of the area.
    v = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 99.0, 0.0, 0.0), (2, 0.0, 2.0, 0.0), (3, 0.0, 0.0, 5.0), (4, 1.0, 0.0, 5.0), (5, 0.0, 2.0, 5.0)], "vid int, x double, y double, z double")
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 3, 4, 5)], "fid int, a int, b int, c int")
    s = mesh.sample_surface(mesh.triangle_corners(t, v), 10000).toPandas()
    assert sorted(s.sample_id) == list(range(10000))
    assert abs((s.fid == 1).sum() - 100) <= 2
    big = s[s.fid == 0]
    assert (big.x / 99 + big.y / 2 <= 1 + 1e-9).all() and abs(big.x.mean() - 33) < 1


def test_polygon_with_a_hole(spark):
    ring = lambda pts: [(*pts[i], *pts[(i + 1) % len(pts)]) for i in range(len(pts))]
    outer = ring([(0, 0), (10, 0), (10, 10), (0, 10)])
    inner = ring([(4, 4), (4, 6), (6, 6), (6, 4)])
    edges = spark.createDataFrame([(i, *map(float, e)) for i, e in enumerate(outer + inner)], "eid int, ax double, ay double, bx double, by double")
    p = spark.createDataFrame([(0, 1.0, 2.0), (1, 5.0, 5.0), (2, -3.0, -4.0), (3, 5.0, 8.5)], "pid int, x double, y double")
    got = {r.pid: r.sdf for r in mesh.polygon_sdf(p, edges, "pid", "eid").collect()}
    assert {k: round(v, 9) for k, v in got.items()} == {0: -1.0, 1: 1.0, 2: 5.0, 3: -1.5}


def test_cloud_labels_of_many_points_are_searched_by_leaves(spark, monkeypatch):
    """All seven probes of a grid point, none by the levels of a tree."""
    for name, value in (("MANY", 100), ("PER_LEAF", 64), ("_descend", None)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(24)
    grid, cloud = rng.random((40, 3)), rng.random((2500, 3))
    got = N.cloud_labels(spark.createDataFrame(frame(grid, "g")), spark.createDataFrame(frame(cloud, "c")), 0.01, "g", "c").toPandas().set_index("g").loc[np.arange(len(grid))]
    near = lambda p: brute(p, cloud)[0]
    slope = np.stack([(near(grid + e) - near(grid - e)) / 0.02 for e in 0.01 * np.eye(3)], axis=1)
    slope /= np.linalg.norm(slope, axis=1, keepdims=True)
    assert np.allclose(got.sdf, near(grid)) and np.allclose(got[["gx", "gy", "gz"]], slope)
