import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxfield.functions import keys as K
from voxfield.operators import rays as R
from voxfield.operators import voxelmap as V
from voxfield.session import cut


def table(spark, n=120, seed=13):
    rng = np.random.default_rng(seed)
    d = rng.normal(size=(n, 3))
    d[:10, 1] = 0.0  # along a slab
    d[10:15] = [1.0, 0.0, 0.0]
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    o = rng.random((n, 3)) * 6 - 3
    pdf = pd.DataFrame(np.c_[o, d], columns=["ox", "oy", "oz", "dx", "dy", "dz"])
    pdf.insert(0, "ray_id", np.arange(n))
    pdf["frame_id"] = pdf.ray_id % 7
    pdf["depth"] = rng.random(n) * 12
    return pdf, spark.createDataFrame(pdf)


def walk(r, res, depth):
    """Cell by cell: always cross the nearest plane, x before y before z."""
    off, top = 1 << (depth - 1), (1 << depth) - 1
    s = [r.ox, r.oy, r.oz]
    e = [r.ox + r.depth * r.dx, r.oy + r.depth * r.dy, r.oz + r.depth * r.dz]
    k = [math.floor(v / res) + off for v in s]
    end = [math.floor(v / res) + off for v in e]
    if not all(0 <= v <= top for v in k + end):
        return []
    out = []
    while k != end:
        out.append(tuple(k))
        t = []
        for a in range(3):
            if k[a] == end[a]:
                t.append(math.inf)
            else:
                plane = k[a] + 1 if end[a] > k[a] else k[a]
                t.append(((plane - off) * res - s[a]) / (e[a] - s[a]))
        a = t.index(min(t))
        k[a] += 1 if end[a] > k[a] else -1
    return out


def test_traversal(spark):
    pdf, df = table(spark)
    got = R.traverse(df, 0.5, 5).toPandas().sort_values(["ray_id", "pos"])
    got = {k: list(zip(g.kx, g.ky, g.kz)) for k, g in got.groupby("ray_id")}
    assert any(got)
    for r in pdf.itertuples():
        assert got.get(r.ray_id, []) == walk(r, 0.5, 5)


def test_ray_nodes_against_every_leaf(spark):
    pdf, df = table(spark, 60)
    rng = np.random.default_rng(14)
    cells = np.unique(rng.integers(8, 24, (80, 3)), axis=0)
    leaf = spark.createDataFrame(pd.DataFrame(cells, columns=["kx", "ky", "kz"])).select(K.location_code(K.key_columns(), 5).alias("node"))
    for both in (False, True):
        got = R.ray_nodes(df, V.build_nodes(leaf, 5), 0.5, 5, bidirectional=both, max_range=6.0)
        got = R.order_on_ray(got).toPandas()
        boxes = V.describe_nodes(leaf, 0.5, 5).toPandas()
        want = {}
        for r in pdf.itertuples():
            o, d = np.array([r.ox, r.oy, r.oz]), np.array([r.dx, r.dy, r.dz])
            for b in boxes.itertuples():
                lo, hi = np.array([b.cx, b.cy, b.cz]) - b.half, np.array([b.cx, b.cy, b.cz]) + b.half
                with np.errstate(divide="ignore", invalid="ignore"):
                    t1, t2 = (lo - o) / d, (hi - o) / d
                near, far = np.fmin(t1, t2).max(), np.fmax(t1, t2).min()
                if far < near:
                    continue
                inside = ((o >= lo) & (o <= hi)).all()
                d1 = near if not inside and near >= 0 else far
                if (both or d1 >= 0) and abs(d1) <= 6.0:
                    want[(r.ray_id, b.node)] = d1
        have = {(r.ray_id, r.node): r.d1 for r in got.itertuples()}
        assert have.keys() == want.keys()
        assert all(abs(have[k] - want[k]) < 1e-9 for k in want)
        for _, g in got.sort_values("rank").groupby("ray_id"):
            order = [(x < 0, abs(x)) for x in g.d1]
            assert order == sorted(order)


def test_a_whole_tree_is_walked_without_tables_and_as_by_levels(spark, monkeypatch):
    """Leaves of several depths, lines along slabs and from their planes, shared and missing ids, missing coordinates, slices in halves."""
    rng = np.random.default_rng(16)
    cells = np.unique(rng.integers(10, 22, (400, 3)), axis=0)
    leaf = spark.createDataFrame(pd.DataFrame(cells, columns=["kx", "ky", "kz"])).select(K.location_code(K.key_columns(), 5).alias("node"))
    nodes = V.build_nodes(leaf, 5)
    block = nodes.filter(K.node_depth(F.col("node")) == 3).select(F.col("node").alias("up")).orderBy("up").limit(2)
    nodes = nodes.join(F.broadcast(block), (K.node_depth(F.col("node")) > 3) & (F.expr("shiftright(node, 3) = up or shiftright(node, 6) = up")), "left_anti")
    pdf, _ = table(spark, 60)
    pdf.loc[20:24, ["ox", "oy", "oz"]] = np.round(pdf.loc[20:24, ["ox", "oy", "oz"]] * 2) / 2
    rows = [tuple(None if v != v else v for v in r) for r in pdf[["ray_id", "ox", "oy", "oz", "dx", "dy", "dz"]].astype(object).itertuples(index=False)]
    rows += [(3, *rows[30][1:]), (None, *rows[31][1:]), (90, 0.1, None, 0.1, 0.6, 0.8, 0.0), (91, 0.1, 0.1, 0.1, 0.0, 0.0, 0.0), (92, 0.1, 0.1, 0.1, 0.6, None, 0.8), (93, None, None, None, 0.6, 0.0, 0.8)]
    rays = spark.createDataFrame(rows, "ray_id bigint, ox double, oy double, oz double, dx double, dy double, dz double")

    def hits(both, reach):
        got = R.ray_nodes(rays, nodes, 0.5, 5, bidirectional=both, max_range=reach)
        return sorted(((r.ray_id is None, r.ray_id, r.node, r.d1, r.d2) for r in got.collect()), key=str)

    tables = []
    for both, reach in ((False, 0.0), (True, 3.0)):
        monkeypatch.setattr(R, "cut", lambda df: (tables.append(df.columns), cut(df))[1])
        whole = hits(both, reach)
        # The boxes and the rays; no step of the walk, and no hits.
        assert len(tables) == 2 and not any("d1" in t or "ix" in t for t in tables)
        monkeypatch.setattr(R, "PAIRS", 50)
        assert hits(both, reach) == whole
        monkeypatch.setattr(R, "SENT", 0)
        tables.clear()
        assert hits(both, reach) == whole and len(tables) > 3 and len(whole) > 100
        monkeypatch.undo()
        tables.clear()


def test_updates_fold_in_order_over_many_blocks(spark):
    rng = np.random.default_rng(15)
    frames = np.concatenate([rng.choice(3_000_000, 3000, replace=False), [5, 6, 7]])
    pdf = pd.DataFrame({"node": [1] * 3000 + [2] * 3, "frame_id": frames, "delta": np.where(rng.random(3003) < 0.45, 0.85, -0.4)})
    got = {r.node: r.value for r in R.fuse_updates(spark.createDataFrame(pdf), -2.0, 3.5).collect()}
    for node, g in pdf.sort_values("frame_id").groupby("node"):
        v = 0.0
        for d in g.delta:
            v = min(3.5, max(-2.0, v + d))
        assert abs(got[node] - v) < 1e-9


def test_samples_lie_where_they_should(spark):
    _, df = table(spark)
    s = R.ray_samples(df, 3, 5, 0.5, 10.0, 0.2, 0.1).join(df.select("ray_id", "depth"), "ray_id").toPandas()
    assert (s.groupby("ray_id").size() == 9).all()
    assert ((s.depth > 0.7) & (s.depth < 10)).all()
    a = s[s.kind == "stratified"]
    width = (a.depth - 0.2 - 0.5) / 3
    assert ((a.t >= 0.5 + a.s_idx * width - 1e-9) & (a.t < 0.5 + (a.s_idx + 1) * width)).all()
    p = s[s.kind == "perturbed"]
    off = (p.t - p.depth).abs()
    assert ((off >= 0.1 - 1e-9) & (off <= 0.3 + 1e-9)).all() and (p.behind == (p.t > p.depth)).all()
    assert (p.behind.groupby(p.ray_id).sum() == 3).all()


def test_labels_are_distances_to_the_surface_samples(spark):
    _, df = table(spark, 60)
    s = R.sdf_labels(R.ray_samples(df, 2, 2, 0.0, 20.0, 0.1, 0.2)).toPandas()
    hits = s[s.kind == "surface"][["x", "y", "z"]].to_numpy()
    d = np.sqrt(((s[["x", "y", "z"]].to_numpy()[:, None] - hits[None]) ** 2).sum(-1)).min(1)
    want = np.where(s.kind == "surface", 0.0, np.where(s.behind, -d, d))
    assert np.allclose(s.label, want)


def test_labels_keep_rays_of_many_samples_apart(spark):
    rows = [(1, i, "perturbed", False, float(i), 0.0, 0.0) for i in (0, 4095, 4096)] + [(1, 5000, "surface", False, 0.0, 0.0, 0.0)]
    rows += [(2, 0, "perturbed", False, 0.0, 0.5, 0.0), (2, 1, "surface", False, 0.0, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "ray_id bigint, s_idx int, kind string, behind boolean, x double, y double, z double")
    got = {(r.ray_id, r.s_idx): r.label for r in R.sdf_labels(df).collect()}
    assert len(got) == 6 and got[2, 0] == 0.5 and got[1, 4095] == 4095.0 and abs(got[1, 4096] - 4096.0) < 0.02


def test_ray_walk_of_a_table_in_one_file_uses_all_cores(spark, tmp_path, monkeypatch):
    rays = pd.DataFrame({"ray_id": np.arange(64), **{f"o{a}": 0.1 for a in "xyz"}, **{f"d{a}": 0.5 + np.arange(64) / 100 for a in "xyz"}})
    spark.createDataFrame(rays).coalesce(1).write.parquet(str(tmp_path / "rays"))
    parts = []
    monkeypatch.setattr(R, "cut", lambda df: (parts.append(df.rdd.getNumPartitions()), cut(df))[1])
    leaf = spark.createDataFrame([(k,) for k in (512, 519, 575)], "node bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = R.ray_nodes(spark.read.parquet(str(tmp_path / "rays")), V.build_nodes(leaf, 3), 0.5, 3, bidirectional=True)
        assert hits.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The first table holds the boxes; the others are steps of the walk.
    assert min(parts[1:]) >= spark.sparkContext.defaultParallelism
