import json
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.operators import mesh
from voxfield.sources import chunks, clouds, readers, writers


def test_lines_are_numbered_across_ranges(spark, tmp_path):
    rng = np.random.default_rng(18)
    texts = {"a.txt": ["x" * rng.integers(0, 40) for _ in range(300)], "b.txt": ["only"], "c.txt": ["", "", "end"]}
    for name, lines in texts.items():
        (tmp_path / name).write_text("\n".join(lines) + ("" if name == "b.txt" else "\n"))
    for size in (7, 64, 1 << 20):
        got = chunks.text_lines(spark, str(tmp_path), size=size).toPandas().sort_values(["path", "line"])
        for name, lines in texts.items():
            part = got[got.path.str.endswith(name)]
            assert list(part.value) == lines and list(part.line) == list(range(len(lines)))


def pose_lines(n):
    return [" ".join(str(float(i * 16 + j)) for j in range(16)) for i in range(n)]


def test_trajectory(spark, tmp_path):
    path = tmp_path / "traj.txt"
    lines = pose_lines(5)
    path.write_text("\n".join(lines))
    got = readers.read_trajectory(spark, str(path)).orderBy("frame_id").collect()
    assert [r.frame_id for r in got] == list(range(5)) and got[2].pose[0] == 32.0
    path.write_text("\n".join([lines[0], "", "1 2 3", lines[1], lines[2]]))
    got = readers.read_trajectory(spark, str(path), skip_other=True).orderBy("frame_id").collect()
    assert [(r.frame_id, r.pose[0]) for r in got] == [(0, 0.0), (1, 16.0), (2, 32.0)]
    with pytest.raises(Exception, match="expected 16 values"):
        readers.read_trajectory(spark, str(path)).collect()
    (tmp_path / "p.txt").write_text("1 2 3\n4 5 6\n")
    assert [r.pose for r in readers.read_trajectory(spark, str(tmp_path / "p.txt"), "xyz").orderBy("frame_id").collect()] == [[1, 2, 3], [4, 5, 6]]


def test_trajectory_round_trip(spark, tmp_path):
    frames = spark.createDataFrame([(i, [float(i + j) for j in range(16)]) for i in range(20)], "frame_id bigint, pose array<double>")
    writers.write_trajectory(frames.coalesce(1), str(tmp_path / "t"))
    back = readers.read_trajectory(spark, str(tmp_path / "t")).orderBy("path", "frame_id").collect()
    assert [r.pose for r in back] == [r.pose for r in frames.orderBy("frame_id").collect()]


def test_pose_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text("# sec,nsec\n10,500000000,1,2,3,0,0,0.6,0.8\n11, 1000,1,2,3,0,0,0,1\n")
    rows = readers.poses_from_csv(readers.read_pose_csv(spark, str(tmp_path / "p.csv"))).orderBy("t").collect()
    assert rows[0].t == 10.5 and rows[0].ts.microsecond == 500000 and rows[1].ts.microsecond == 1
    assert np.allclose(np.array(rows[0].pose).reshape(4, 4), [[0.28, -0.96, 0, 1], [0.96, 0.28, 0, 2], [0, 0, 1, 3], [0, 0, 0, 1]])


def ply(points, kind, faces=()):
    head = f"ply\nformat {kind} 1.0\ncomment made by a test\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty uchar tag\nproperty float z\n"
    head += f"element face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n" if len(faces) else "end_header\n"
    if kind == "ascii":
        body = "".join(f"{x} {y} 7 {z}\n" for x, y, z in points) + "".join(f"3 {a} {b} {c}\n" for a, b, c in faces)
        return (head + body).encode()
    sign = "<" if "little" in kind else ">"
    body = b"".join(struct.pack(f"{sign}ffBf", x, y, 7, z) for x, y, z in points)
    return head.encode() + body + b"".join(struct.pack(f"{sign}Biii", 3, *f) for f in faces)


@pytest.mark.parametrize("kind", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply_points_and_mesh(spark, tmp_path, kind):
    p = np.random.default_rng(19).random((50, 3)).astype(np.float32)
    f = [(i, i + 1, i + 2) for i in range(30)]
    path = tmp_path / "m.ply"
    path.write_bytes(ply(p, kind, f))
    v, t = clouds.read_mesh(spark, str(path), records=16)
    v, t = v.toPandas().sort_values("vid"), t.toPandas().sort_values("fid")
    assert np.allclose(v[["x", "y", "z"]], p, atol=1e-7) and list(v.vid) == list(range(50))
    assert list(map(tuple, t[["a", "b", "c"]].to_numpy())) == f


def test_meshes_of_several_files_keep_apart(spark, tmp_path):
    for i, kind in enumerate(("ascii", "binary_little_endian", "ascii")):
        (tmp_path / f"{i}.ply").write_bytes(ply([(i, 0, 0), (i, 1, 0), (i, 0, 1)], kind, [(0, 1, 2)]))
    v, t = clouds.read_mesh(spark, str(tmp_path))
    assert v.select("path", "vid").distinct().count() == v.count() == 9 and t.count() == 3
    got = mesh.triangle_corners(t, v).collect()
    assert sorted((r.ax, r.bx, r.cx, r.by, r.cz) for r in got) == [(i, i, i, 1.0, 1.0) for i in range(3)]


def test_scan_folder(spark, tmp_path):
    for i in (0, 3, 12):
        (tmp_path / f"{i:04d}.ply").write_bytes(ply([(i, 0, 0), (i, 1, 0)], "ascii" if i == 3 else "binary_little_endian"))
    got = clouds.read_scans(spark, str(tmp_path)).groupBy("frame_id").agg(F.count("*").alias("n"), F.max("x").alias("x")).toPandas()
    assert {(r.frame_id, r.n, r.x) for r in got.itertuples()} == {(0, 2, 0.0), (3, 2, 3.0), (12, 2, 12.0)}


def test_npy_pcd_and_errors(spark, tmp_path):
    p = np.arange(30, dtype=np.float64).reshape(10, 3)
    np.save(tmp_path / "c.npy", p)
    got = clouds.read_points(spark, str(tmp_path / "c.npy"), records=4).toPandas().sort_values("pt_id")
    assert np.allclose(got[["x", "y", "z"]], p)
    head = "# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH 10\nHEIGHT 1\nPOINTS 10\nDATA "
    q = np.c_[p, np.ones(10)].astype(np.float32)
    (tmp_path / "b.pcd").write_bytes((head + "binary\n").encode() + q.tobytes())
    (tmp_path / "a.pcd").write_text(head + "ascii\n" + "\n".join(" ".join(map(str, r)) for r in q) + "\n")
    for name in ("a.pcd", "b.pcd"):
        got = clouds.read_points(spark, str(tmp_path / name)).toPandas().sort_values("pt_id")
        assert np.allclose(got[["x", "y", "z"]], p)
    np.save(tmp_path / "bad.npy", np.zeros((4, 2)))
    (tmp_path / "x.xyz").write_text("1 2 3")
    for name, match in (("bad.npy", "expected"), ("x.xyz", "unsupported")):
        with pytest.raises(Exception, match=match):
            clouds.read_points(spark, str(tmp_path / name)).collect()


def png(image, filters):
    h, w = image.shape
    raw, data = image.astype(">u2").tobytes(), b""
    rows = [np.frombuffer(raw[y * w * 2 : (y + 1) * w * 2], np.uint8).astype(int) for y in range(h)]
    for y, row in enumerate(rows):
        up = rows[y - 1] if y else np.zeros_like(row)
        left, corner = np.r_[[0, 0], row[:-2]], np.r_[[0, 0], up[:-2]]
        kind = filters[y % len(filters)]
        guess = {0: 0 * row, 1: left, 2: up, 3: (left + up) // 2}.get(kind)
        if guess is None:
            p = left + up - corner
            pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
        data += bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes()
    part = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(data)) + part(b"IEND", b"")


def test_depth_scene(spark, tmp_path):
    rng = np.random.default_rng(20)
    images = [rng.integers(0, 60000, (9, 13)) for _ in range(2)]
    (tmp_path / "results").mkdir()
    for i, image in enumerate(images):
        (tmp_path / "results" / f"depth{i:06d}.png").write_bytes(png(image, [0, 1, 2, 3, 4]))
    (tmp_path / "traj.txt").write_text("\n".join(pose_lines(2)))
    px = readers.read_depth_images(spark, str(tmp_path / "results")).toPandas()
    for i, image in enumerate(images):
        got = px[px.frame_id == i].pivot(index="v", columns="u", values="depth").to_numpy()
        assert np.allclose(got, image / 6553.5)
    frames, points = readers.get_dataset(spark, "depth_scene", path=str(tmp_path), low=1.0, high=8.0, fx=10.0, fy=10.0, cx=6.0, cy=4.0, end=1)
    assert frames.count() == 1
    got = points.toPandas()
    want = images[0] / 6553.5
    assert len(got) == ((want >= 1) & (want <= 8)).sum() and np.allclose(got.z, got.depth)
    with pytest.raises(ValueError, match="unknown dataset"):
        readers.get_dataset(spark, "nope")


def test_raw_buffers(spark):
    image = np.arange(6).reshape(2, 3)
    rows = [(i, enc, big, 2, 3, image.astype((">" if big else "<") + readers.ENCODINGS[enc]).tobytes()) for i, (enc, big) in enumerate((e, b) for e in readers.ENCODINGS for b in (False, True))]
    df = spark.createDataFrame(rows, "frame_id bigint, encoding string, is_bigendian boolean, height int, width int, data binary")
    got = readers.decode_depth(df, 0.5).toPandas()
    for _, g in got.groupby("frame_id"):
        assert np.allclose(g.sort_values(["v", "u"]).depth, image.ravel() * 0.5)
    with pytest.raises(Exception, match="unsupported depth encoding"):
        readers.decode_depth(df.withColumn("encoding", F.lit("rgb8"))).collect()
    p = np.arange(20, dtype=np.float32).reshape(4, 5)
    cloud = readers.decode_cloud(spark.createDataFrame([(1, 20, p.tobytes())], "frame_id bigint, point_step int, data binary")).toPandas()
    assert np.allclose(cloud[["x", "y", "z"]], p[:, :3])


def test_camera(spark, tmp_path):
    (tmp_path / "cam.json").write_text(json.dumps({"camera": {"fx": 600.0, "fy": 601.0, "cx": 1.0, "cy": 2.0, "scale": 6553.5, "w": 3, "h": 4}}, indent=1))
    assert readers.read_camera(spark, str(tmp_path / "cam.json")).first().fy == 601.0


def test_sinks(spark, tmp_path):
    grid = spark.createDataFrame([(i, j, 0, 1.0, "near" if i else "far") for i in range(3) for j in range(3)], "i int, j int, k int, sdf double, region string")
    writers.write_grid(grid, str(tmp_path / "g"))
    writers.write_test_set(grid, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "g")).count() == 9
    assert spark.read.parquet(str(tmp_path / "t")).filter("region = 'near'").count() == 6
    long = spark.createDataFrame([("m", "sdf", "near", "mae", 0.5), ("m", "sdf", "far", "mae", 0.7)], "subject string, field string, region string, metric string, value double")
    writers.write_metrics(long, str(tmp_path / "m"))
    row = spark.read.csv(str(tmp_path / "m"), header=True, inferSchema=True).first()
    assert row["sdf.near.mae"] == 0.5 and row["sdf.far.mae"] == 0.7
    report = spark.createDataFrame([(0.1, 0.2)], "boundary double, total double")
    writers.append_losses(report, 1, str(tmp_path / "l"))
    writers.append_losses(report, 2, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).filter("term = 'total'").count() == 2
    v = spark.createDataFrame([(1, 0.0, 0.0, 0.0)], "vid int, x double, y double, z double")
    writers.write_mesh(v, v, str(tmp_path / "mesh"))
    writers.write_points(v, str(tmp_path / "pc"))
    assert spark.read.parquet(str(tmp_path / "mesh/vertices")).count() == 1


def test_snapshots(spark, tmp_path):
    v = spark.range(5).withColumnRenamed("id", "node")
    layers = [(np.ones((2, 3)), np.zeros(2))]
    for epoch in (2, 10):
        writers.save_snapshot(str(tmp_path / "s"), epoch, v, v, layers)
    epoch, vertices, voxels, back = writers.load_snapshot(spark, str(tmp_path / "s"))
    assert epoch == 10 and voxels.count() == 5 and np.allclose(back[0][0], 1.0)
    assert [e for e in range(1, 8) if writers.due(e, 3, e == 7)] == [3, 6, 7]


def test_grid_map_needs_every_cell(spark):
    from voxfield.operators import grids

    plane = grids.sensor_plane(spark, 3, 3, 1.0).withColumn("sdf", F.col("x") * 10 + F.col("y"))
    row = writers.grid_map(plane, 3, 3, 1.0, gradient=False).first()
    assert row.layers["sdf"] == [11.0, 1.0, -9.0, 10.0, 0.0, -10.0, 9.0, -1.0, -11.0] and row.length_x == 3.0
    assert writers.grid_map(plane.filter("cell > 0"), 3, 3, 1.0, gradient=False).count() == 0
    bad = plane.withColumn("sdf", F.when(F.col("cell") == 1, float("nan")).when(F.col("cell") == 2, float("inf")).otherwise(F.col("sdf")))
    assert writers.field_cloud(bad).count() == 7
