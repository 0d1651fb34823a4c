import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.operators import asof
from voxfield.operators import voxelmap as V
from voxfield.streaming import streams as ST


def drop_files(spark, pdf, path, parts):
    """The rows as several files, in order."""
    path.mkdir()
    for i, part in enumerate(np.array_split(pdf, parts)):
        pd.DataFrame(part).to_parquet(path / f"{i:03d}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        time.sleep(0.01)
    return spark.read.parquet(str(path)).schema


def run(spark, pdf, folder, sink, cuts):
    """The sink's result of a table in ordered files (one per trigger), in one file, or in shuffled files (several per trigger)."""
    rows = pdf.sample(frac=1, random_state=7) if cuts == "shuffled" else pdf
    schema = drop_files(spark, rows, folder / "in", {"ordered": 4, "one": 1, "shuffled": 64}[cuts])
    stream = ST.read_stream(spark, str(folder / "in"), schema, max_files=1 if cuts == "ordered" else 40)
    ST.start_batches(stream, sink, str(folder / "cp")).awaitTermination()
    if hasattr(sink, "finish"):
        sink.finish(spark)
        sink.finish(spark)
        return sink.result(spark).collect()


CUTS = pytest.mark.parametrize("cuts", ["ordered", "one", "shuffled"])


def messages(seed, n, span, copies=False):
    rng = np.random.default_rng(seed)
    stamps = rng.choice(span, n, replace=copies)
    return pd.DataFrame({"key": rng.integers(0, 2, n), "side": rng.choice(["scan", "pose"], n), "id": np.arange(n), "t": np.sort(stamps)})


@pytest.mark.parametrize("cuts, queue", [("ordered", None), ("one", 3), ("shuffled", None)])
def test_pairing_matches_a_simulation(spark, tmp_path, cuts, queue):
    pdf = messages(21, 400, 20000)
    sink = ST.PairSink(str(tmp_path / "out"), 60, 100 if cuts == "ordered" else None, queue)
    got = {(r.scan_id, r.pose_id) for r in run(spark, pdf, tmp_path, sink, cuts)}
    want = set()
    for _, g in pdf.groupby("key"):
        wait = {"scan": [], "pose": []}
        for r in g.itertuples():
            other = "pose" if r.side == "scan" else "scan"
            near = [m for m in wait[other] if r.t - m[0] <= 60]
            wait[other] = near
            if near:
                m = min(near, key=lambda m: (r.t - m[0], m[0]))
                near.remove(m)
                want.add((r.id, m[1]) if r.side == "scan" else (m[1], r.id))
            else:
                wait[r.side] = wait[r.side] + [(r.t, r.id)]
                wait[r.side] = wait[r.side][-queue:] if queue else wait[r.side]
    assert got == want and len(want) > 20


@CUTS
def test_nearest_on_a_stream_is_the_batch_result(spark, tmp_path, cuts):
    pdf = messages(22, 300, 600_000)
    sink = ST.NearestSink(str(tmp_path / "out"), 2000, 3000 if cuts == "ordered" else None)
    got = sorted((r.scan_id, r.pose_id, r.gap) for r in run(spark, pdf, tmp_path, sink, cuts))
    side = lambda name: spark.createDataFrame(pdf[pdf.side == name]).select("key", F.col("id").alias(f"{name}_id"), "t")
    batch = asof.asof_nearest(side("scan"), side("pose"), ["key"], "t", ("pose_id",), 2000)
    assert got == sorted((r.scan_id, r.pose_id, abs(r.dt)) for r in batch.collect()) and len(got) > 30


@pytest.mark.parametrize("cuts", ["ordered", "shuffled"])
def test_key_frames_and_numbers_carry_state(spark, tmp_path, cuts):
    rng = np.random.default_rng(23)
    sets = [set(rng.choice(30, 12).tolist()) for _ in range(40)]
    pdf = pd.DataFrame([("a", i, n) for i, s in enumerate(sets) for n in s], columns=["scene", "frame_id", "node"])
    (tmp_path / "k").mkdir()
    sink = ST.KeyFrameSink(str(tmp_path / "keys"), 0.4, 3 if cuts == "ordered" else None)
    got = sorted(r.frame_id for r in run(spark, pdf, tmp_path / "k", sink, cuts))
    last, want = None, []
    for i, s in enumerate(sets):
        if last is None or len(last & s) / len(last | s) < 0.4:
            want.append(i)
            last = s
    assert got == want
    (tmp_path / "n").mkdir()
    sink = ST.NumberSink(str(tmp_path / "seq"), "scene", "t", 20 if cuts == "ordered" else None)
    got = run(spark, pd.DataFrame({"scene": "a", "t": np.arange(40) * 10}), tmp_path / "n", sink, cuts)
    assert sorted((r.t, r.seq) for r in got) == [(i * 10, i) for i in range(40)]


def test_late_rows_are_kept_apart_and_batches_repeat(spark, tmp_path):
    sink = ST.NumberSink(str(tmp_path), "key", "t", 5)
    batch = lambda *ts: spark.createDataFrame([("a", t) for t in ts], "key string, t bigint")
    sink(batch(0, 10, 20), 0)
    sink(batch(3, 18, 30), 1)
    sink(batch(3, 18, 30), 1)
    sink.finish(spark)
    assert sorted((r.t, r.seq) for r in sink.result(spark).collect()) == [(0, 0), (10, 1), (18, 2), (20, 3), (30, 4)]
    assert [r.t for r in spark.read.parquet(f"{tmp_path}/late").collect()] == [3]


@CUTS
def test_voxel_sink_grows_and_can_be_repeated(spark, tmp_path, cuts):
    rng = np.random.default_rng(24)
    pdf = pd.DataFrame(rng.random((600, 3)) * 6 - 3, columns=list("xyz")).assign(scene="a", frame_id=np.repeat(np.arange(6), 100))
    sink = ST.VoxelSink(str(tmp_path / "map"), 1.0, 4, 1)
    run(spark, pdf, tmp_path, sink, cuts)
    batch = V.occupied_voxels(spark.createDataFrame(pdf), 1.0, 4, 1, ("scene", "frame_id"))
    want = sorted({r.node for r in batch.collect()})
    assert sorted(r.node for r in sink.voxels(spark).collect()) == want
    assert sink.seen(spark).count() == batch.count()
    if cuts == "one":
        # A batch that is run again writes the same folder.
        sink(spark.createDataFrame(pdf), 0)
        assert sink.seen(spark).count() == batch.count()


def test_watchdog_stops_an_idle_query(spark, tmp_path):
    pdf = pd.DataFrame({"t": np.arange(10)})
    schema = drop_files(spark, pdf, tmp_path / "in", 2)
    rows, done = [], []
    q = ST.read_stream(spark, str(tmp_path / "in"), schema).writeStream.option("checkpointLocation", str(tmp_path / "cp"))
    q = q.trigger(processingTime="200 milliseconds").foreachBatch(lambda df, n: rows.append(df.count())).start()
    assert ST.run_until_idle(q, 4.0, lambda: done.append(True))
    assert not q.isActive and sum(rows) == 10 and done == [True]


def test_refinement_runs_between_drains(spark, tmp_path):
    pdf = pd.DataFrame({"t": np.arange(10)})
    schema = drop_files(spark, pdf, tmp_path / "in", 1)
    calls = []
    begin = lambda: ST.start(ST.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert ST.refine_between(begin, calls.append, 3) == 1 and calls == [0, 1, 2]


def test_publication_never_overlaps(spark):
    live, most, ticks = [0], [0], []

    def publish(n):
        live[0] += 1
        most[0] = max(most[0], live[0])
        time.sleep(0.3)
        ticks.append(n)
        live[0] -= 1

    q = ST.publish_periodically(spark, publish, 0.1)
    time.sleep(4)
    q.stop()
    assert len(ticks) >= 2 and most[0] == 1


def test_raw_messages_with_a_broken_pose_are_dropped(spark):
    good, bad = [float(i % 5 == 0) for i in range(16)], [float("nan")] * 16
    p = np.arange(6, dtype=np.float32)
    df = spark.createDataFrame([(0, 12, p.tobytes(), good), (1, 12, p.tobytes(), bad)], "frame_id bigint, point_step int, data binary, pose array<double>")
    assert [r.frame_id for r in ST.scan_points(df, "cloud").collect()] == [0, 0]
    with pytest.raises(ValueError, match="unknown scan kind"):
        ST.scan_points(df, "radar")


def test_arrivals_are_handed_on_piece_by_piece(spark, tmp_path):
    from voxfield.plans.queries_streams import ARRIVALS, _arrive

    rows = spark.createDataFrame([(k, 10 * i) for i in range(200) for k in (1, 2)], "key long, t long")
    sink = ST.NumberSink(f"{tmp_path}/seq", "key", delay=15)
    _arrive(spark, rows, "t", sink, str(tmp_path))
    assert sink._read(spark, "out").select("batch").distinct().count() == ARRIVALS + 1
    assert sink._read(spark, "late").count() == 0
    assert sorted((r.key, r.t, r.seq) for r in sink.result(spark).collect()) == sorted((k, 10 * i, i) for i in range(200) for k in (1, 2))
