import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.operators import field as FD
from voxfield.operators import grids, metrics, surface
from voxfield.operators import voxelmap as V
from voxfield.plans import fit

RES, DEPTH = 0.5, 4


@pytest.fixture(scope="module")
def setup(spark):
    rng = np.random.default_rng(16)
    p = pd.DataFrame(rng.random((150, 3)) * 7.9 - 3.95, columns=list("xyz")).assign(pt_id=np.arange(150))
    pts = spark.createDataFrame(p)
    few = pts.filter("pt_id < 30")
    nodes = V.semi_sparse(V.build_nodes(V.occupied_voxels(few, RES, DEPTH), DEPTH), DEPTH, 3)
    v = V.vertex_table(nodes, DEPTH)
    at = [(F.col(f"v{a}") - 8) * RES for a in "xyz"]
    affine = 0.3 + 2.0 * at[0] - 1.5 * at[1] + 0.5 * at[2]
    v = v.select("*", affine.alias("sdf"), F.lit(2.0).alias("gx"), F.lit(-1.5).alias("gy"), F.lit(0.5).alias("gz"))
    return p, pts, nodes, v


@pytest.mark.parametrize("augmented", [False, True])
def test_affine_field_is_reproduced(spark, setup, augmented):
    p, pts, nodes, v = setup
    if not augmented:
        # The plain form must not look at the slopes.
        v = v.withColumns({"gx": F.lit(9.0), "gy": F.lit(9.0), "gz": F.lit(9.0)})
    corners = FD.corner_rows(nodes, v, RES, DEPTH)
    got = FD.query_sdf(pts, corners, RES, DEPTH, augmented).toPandas().set_index("pt_id").loc[p.pt_id]
    want = 0.3 + 2.0 * p.x - 1.5 * p.y + 0.5 * p.z
    assert got.node.notna().all()
    assert np.allclose(got.sdf_prior, want)
    assert np.allclose(got[["grad_x", "grad_y", "grad_z"]], [2.0, -1.5, 0.5])


def test_exact_gradient_matches_central_differences(spark, setup):
    _, pts, nodes, v = setup
    v = v.withColumn("sdf", F.sin(F.col("vx")) + F.cos(F.col("vy") * F.col("vz")))
    corners = FD.corner_rows(nodes, v, RES, DEPTH)
    exact = FD.query_sdf(pts, corners, RES, DEPTH).select("pt_id", "node", "grad_x", "grad_y", "grad_z")
    diff = FD.central_gradient(pts, lambda q: FD.query_sdf(q, corners, RES, DEPTH, gradient=False), 1e-6, "pt_id")
    both = exact.join(diff.withColumnsRenamed({f"grad_{a}": f"c{a}" for a in "xyz"}), "pt_id").toPandas()
    err = np.abs(both[["grad_x", "grad_y", "grad_z"]].to_numpy() - both[["cx", "cy", "cz"]].to_numpy())
    assert (err < 1e-5).mean() > 0.98


def test_valid_samples_are_in_the_box_and_the_map(spark, setup):
    p, pts, nodes, _ = setup
    got = {r.pt_id for r in FD.valid_samples(pts, nodes, RES, DEPTH, (-2, -2, -2), (2, 2, 2)).collect()}
    assert got == set(p[(p[["x", "y", "z"]].abs() <= 2).all(axis=1)].pt_id)


def test_points_outside_have_no_value(spark, setup):
    _, _, nodes, v = setup
    far = spark.createDataFrame([(0, 100.0, 0.0, 0.0)], "pt_id int, x double, y double, z double")
    row = FD.compose(FD.query_sdf(far, FD.corner_rows(nodes, v, RES, DEPTH), RES, DEPTH)).first()
    assert row.node is None and row.sdf is None and row.sdf_residual is None


def test_residual_network_matches_numpy(spark):
    layers = fit.random_layers(3, (5, 4), seed=1)
    rows = [(float(i) / 10, [float(i % 3), float(i % 5)]) for i in range(20)] + [(None, None)]
    df = spark.createDataFrame(rows, "sdf_prior double, feat array<double>")
    got = [r.sdf_residual for r in FD.compose(df, layers).collect()]
    h = np.array([[p, *f] for p, f in rows[:-1]])
    for n, (w, b) in enumerate(layers):
        h = h @ w.T + b
        h = np.where(h >= 0, h, 0.01 * h) if n < 2 else h
    assert np.allclose(got[:-1], 0.1 * h[:, 0]) and got[-1] is None


def test_vertex_fit_lowers_the_loss(spark, setup):
    p, pts, nodes, _ = setup
    samples = pts.select("x", "y", "z", F.lit("stratified").alias("kind"), F.lit(False).alias("behind"), (F.col("x") + 1.0).alias("label"))
    cfg = fit.Losses(eikonal={"surface": 0.0, "perturbation": 0.0, "space": 0.1})
    seen = []
    fit.fit_vertices(samples, nodes, fit.initial_vertices(nodes, DEPTH), RES, DEPTH, 4, 0.25, cfg, on_step=lambda s, r: seen.append(r.first()["total"]))
    assert len(seen) == 4 and seen[-1] < 0.75 * seen[0]


def test_pulls_are_the_slopes_of_the_loss(spark, setup):
    """Moving one vertex parameter a little changes the total by its sub-gradient."""
    _, pts, nodes, v = setup
    v = v.withColumn("sdf", F.sin(F.col("vx") * 1.3) + 0.2 * F.col("vy"))
    kinds = F.when(F.col("pt_id") % 3 == 0, "surface").when(F.col("pt_id") % 3 == 1, "perturbed").otherwise("stratified")
    s = pts.select("x", "y", "z", kinds.alias("kind"), (F.col("pt_id") % 2 == 0).alias("behind"), F.lit(0.37).alias("label"))
    cfg = fit.Losses(heat=0.5, heat_lambda=0.7, exp_penalty=0.8, eta=0.3)
    n = {r["kind"]: r["count"] for r in s.groupBy("kind").count().collect()}

    def rows(vertices):
        return FD.interpolate(FD.locate(s, nodes, RES, DEPTH).join(FD.corner_rows(nodes, vertices, RES, DEPTH), "node"))

    total = lambda vertices: fit.loss_report(rows(vertices), cfg, {"p": ("sdf_prior", ["grad_x", "grad_y", "grad_z"])}).first()["total"]
    pulls = fit.vertex_pulls(fit.corner_pulls(rows(v), cfg, n), V.voxel_corners(nodes, DEPTH)).orderBy(F.abs("d_gy").desc()).first()
    at = (F.col("vx") == pulls.vx) & (F.col("vy") == pulls.vy) & (F.col("vz") == pulls.vz)
    for name in ("sdf", "gy"):
        bump = lambda e: v.withColumn(name, F.when(at, F.col(name) + e).otherwise(F.col(name)))
        slope = (total(bump(1e-6)) - total(bump(-1e-6))) / 2e-6
        assert abs(slope - pulls[f"d_{name}"]) < 1e-4


def test_network_fit_lowers_the_loss(spark):
    df = spark.range(500).selectExpr("rand(1) AS sdf_prior", "array(rand(2), rand(3)) AS feat").withColumn("label", F.col("sdf_prior") + 0.05)
    _, losses = fit.fit_residual(df, fit.random_layers(3, (8,)), steps=15, rate=0.05)
    assert losses[-1] < 0.3 * losses[0]


def sphere(spark, res=0.2):
    low, high = (-1.5,) * 3, (1.5,) * 3
    g = grids.grid_3d(spark, low, high, res)
    return low, [grids.steps(a, b, res) for a, b in zip(low, high)], g.withColumn("sdf", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) - 1.0)


def test_iso_surface_of_a_sphere_is_closed(spark):
    low, shape, g = sphere(spark)
    v, t = surface.iso_surface(g, low, 0.2, shape)
    v, t = v.toPandas().set_index("vid"), t.toPandas()
    assert np.allclose(np.linalg.norm(v[["x", "y", "z"]], axis=1), 1.0, atol=0.02)
    edges = pd.concat([t[[p, q]].set_axis(["p", "q"], axis=1) for p, q in ("ab", "bc", "ca")])
    # Every directed edge has its reverse exactly once: closed and consistently turned.
    assert edges.duplicated().sum() == 0
    assert set(map(tuple, edges.to_numpy())) == {(q, p) for p, q in edges.to_numpy()}
    a, b, c = [v.loc[t[k], ["x", "y", "z"]].to_numpy() for k in "abc"]
    n = np.cross(b - a, c - a)
    assert abs(np.linalg.norm(n, axis=1).sum() / 2 - 4 * math.pi) < 0.3
    assert ((n * a).sum(1) > 0).all()
    # Euler number of a sphere.
    assert len(v) - len(edges) // 2 + len(t) == 2


def test_every_sign_pattern_makes_rings(spark):
    cases = surface.triangle_cases()
    assert len(cases) == 256 and cases[0] == cases[255] == []
    edges = surface.cell_edges(3)
    for pattern, tris in enumerate(cases):
        crossed = {n for n, (_, lo, hi) in enumerate(edges) if (pattern >> lo & 1) != (pattern >> hi & 1)}
        assert {e for t in tris for e in t} == crossed


def test_iso_lines_of_a_circle_close(spark):
    g = grids.slice_grid(spark, (-1.5,) * 3, (1.5,) * 3, 0.1, 2, 0.0).withColumn("sdf", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2) - 1.0)
    v, s = surface.iso_lines(g, (-1.5, -1.5), 0.1, (30, 30))
    s, v = s.toPandas(), v.toPandas().set_index("vid")
    ends = pd.concat([s.a, s.b]).value_counts()
    assert (ends == 2).all()
    a, b = v.loc[s.a].to_numpy(), v.loc[s.b].to_numpy()
    assert abs(np.linalg.norm(a - b, axis=1).sum() - 2 * math.pi) < 0.05


def test_sensor_plane_order(spark):
    rows = grids.sensor_plane(spark, 4, 2, 0.5).orderBy("cell").collect()
    assert len(rows) == 15
    assert [r.x for r in rows[:5]] == [1.0, 0.5, 0.0, -0.5, -1.0]
    assert rows[0].y == 0.5 and rows[-1].y == -0.5


def test_exact_median_of_a_heavy_tail(spark):
    rng = np.random.default_rng(17)
    v = np.concatenate([np.full(300, 2.5), rng.pareto(0.4, 400), [1e12]])
    pdf = pd.DataFrame({"g": np.arange(len(v)) % 2, "v": v})
    got = metrics.exact_median(spark.createDataFrame(pdf), "v", ("g",)).toPandas().set_index("g")["median"]
    want = pdf.groupby("g").v.median()
    assert np.allclose(got.sort_index(), want.sort_index(), rtol=0, atol=0)
    assert metrics.exact_median(spark.createDataFrame(pdf), "v").first()["median"] == np.median(v)


def test_median_with_infinities(spark):
    inf = float("inf")
    groups = {"a": [1.0, 2.0, inf], "b": [-inf, 1.0, 3.0, inf], "c": [-1.7e308, 5.0, 1.7e308], "d": [inf, inf], "e": [-inf, -inf, 7.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("a", float("nan")), ("a", None)]
    got = {r["g"]: r["median"] for r in metrics.exact_median(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    assert got == {"a": 2.0, "b": 2.0, "c": 5.0, "d": inf, "e": -inf}
