import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxfield.operators import asof


@pytest.fixture(scope="module")
def sides(spark):
    rng = np.random.default_rng(3)
    # Key 0 holds most rows, and many stamps repeat.
    lk = np.where(rng.random(600) < 0.6, 0, rng.integers(1, 5, 600))
    rk = np.where(rng.random(400) < 0.6, 0, rng.integers(1, 5, 400))
    left = pd.DataFrame({"key": lk, "lid": np.arange(600), "t": rng.integers(0, 5000, 600)})
    right = pd.DataFrame({"key": rk, "rid": np.arange(400), "t": rng.integers(0, 5000, 400)})
    return left, right


@pytest.mark.parametrize("width", [64, 100000])
def test_nearest_matches_brute_force(spark, sides, width):
    left, right = sides
    got = asof.asof_nearest(spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "t", ("rid",), 40, width)
    got = {r.lid: (r.rid, r.dt) for r in got.collect()}
    for l in left.itertuples():
        c = right[(right.key == l.key) & ((right.t - l.t).abs() <= 40)]
        if c.empty:
            assert l.lid not in got
            continue
        best = min(((abs(t - l.t), t, rid) for t, rid in zip(c.t, c.rid)))
        assert got[l.lid] == (best[2], best[1] - l.t)


@pytest.mark.parametrize("exact", [True, False])
def test_latest_matches_brute_force(spark, sides, exact):
    left, right = sides
    got = asof.asof_latest(spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "t", ("rid",), 300, 64, exact)
    got = {r.lid: r.rid for r in got.collect()}
    for l in left.itertuples():
        c = right[(right.key == l.key) & (right.t <= l.t if exact else right.t < l.t) & (l.t - right.t <= 300)]
        want = None if c.empty else min((-t, rid) for t, rid in zip(c.t, c.rid))[1]
        assert got.get(l.lid) == want


def test_tolerance_is_inclusive_and_a_tie_goes_back(spark):
    left = spark.createDataFrame([("a", 100), ("b", 100), ("c", 100)], "key string, t bigint")
    right = spark.createDataFrame([("a", 90, 1), ("a", 110, 2), ("b", 110, 3), ("c", 111, 4)], "key string, t bigint, rid int")
    got = {r.key: r.rid for r in asof.asof_nearest(left, right, ["key"], "t", ("rid",), 10).collect()}
    assert got == {"a": 1, "b": 3}


@pytest.mark.parametrize("copies", [False, True])
def test_pair_once_is_the_greedy_matching(spark, copies):
    rng = np.random.default_rng(4)
    stamps = lambda: rng.choice(60, 80) * 15 if copies else rng.choice(1000, 80, replace=False)
    l = pd.DataFrame({"key": 0, "l": np.arange(80), "t": stamps()})
    r = pd.DataFrame({"key": 0, "r": np.arange(80), "t": stamps()})
    got = asof.pair_once(spark.createDataFrame(l), spark.createDataFrame(r), ["key"], 25, "l", "r", width=128)
    got = {(x.l, x.r) for x in got.collect()}
    pairs = sorted((abs(a.t - b.t), a.t, b.t, a.l, b.r) for a in l.itertuples() for b in r.itertuples() if abs(a.t - b.t) <= 25)
    used_l, used_r, want = set(), set(), set()
    for _, _, _, i, j in pairs:
        if i not in used_l and j not in used_r:
            used_l.add(i)
            used_r.add(j)
            want.add((i, j))
    assert got == want


def test_a_second_message_of_one_stamp_takes_the_next_pose(spark):
    scans = spark.createDataFrame([(0, 10, 100), (0, 11, 100)], "key int, l int, t bigint")
    poses = spark.createDataFrame([(0, 1, 101), (0, 2, 102)], "key int, r int, t bigint")
    got = asof.pair_once(scans, poses, ["key"], 5, "l", "r").collect()
    assert sorted((x.l, x.r, x.gap) for x in got) == [(10, 1, 1), (11, 2, 2)]
    assert asof.pair_once(scans, poses.filter("t > 200"), ["key"], 5, "l", "r").count() == 0


def test_numbering_lag_and_running_sum(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 3, 500), "f": rng.permutation(100000)[:500], "v": rng.random(500)})
    df = spark.createDataFrame(pdf)
    block = F.floor(F.col("f") / 1000).cast("bigint")
    n = asof.numbered(df, ["k"], ["f"], block, "rn").toPandas().sort_values(["k", "f"])
    assert (n.groupby("k").cumcount() + 1 == n.rn).all()
    p = asof.with_previous(df, ["k"], "f", ["v"], 1000).toPandas().sort_values(["k", "f"])
    want = p.groupby("k").v.shift()
    got = p.prev.map(lambda r: None if r is None else r["v"]).astype(float)
    assert np.allclose(got, want, equal_nan=True)
    s = asof.running_sum(df, ["k"], ["f"], block, "v", "s").toPandas().sort_values(["k", "f"])
    assert np.allclose(s.s, s.groupby("k").v.cumsum() - s.v)


def test_slerp_keeps_a_steady_turn(spark):
    rows = [(0, float(np.sin(0)), float(np.cos(0))), (100, float(np.sin(0.6)), float(np.cos(0.6)))]
    zeros = [F.lit(0.0).alias(c) for c in ("x", "y", "z", "qx", "qy")]
    right = spark.createDataFrame(rows, "t bigint, qz double, qw double").select(F.lit(1).alias("key"), "t", *zeros, "qz", "qw")
    left = spark.createDataFrame([(1, 25), (1, 100), (1, 101)], "key int, t bigint")
    near = asof.asof_bracket(left, right, ["key"], "t", ("x", "y", "z", "qx", "qy", "qz", "qw"))
    got = {r.t: r.qz for r in asof.lerp_transform(near).collect()}
    assert set(got) == {25, 100}
    assert abs(got[25] - np.sin(0.15)) < 1e-12 and abs(got[100] - np.sin(0.6)) < 1e-12
