import numpy as np
import pandas as pd
import pytest

from voxfield.operators import keyframes as KF
from voxfield.operators import sampling as SA
from voxfield.session import cut


def walk(sets, ratio):
    keys, last = [], None
    for f in sorted(sets):
        if last is None or len(last & sets[f]) / len(last | sets[f]) < ratio:
            keys.append(f)
            last = sets[f]
    return keys


def table(spark, scenes):
    rows = [(s, f, n) for s, frames in scenes.items() for f, nodes in frames.items() for n in nodes]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["scene", "frame_id", "node"]))


@pytest.mark.parametrize("width", [4, 32])
def test_iou_key_frames_match_the_walk(spark, width):
    rng = np.random.default_rng(9)
    scenes = {}
    # A drifting window, a long still stretch, frames with nothing in common.
    drift = {i * 3: set(range(i, i + 20)) for i in range(60)}
    still = {i: set(range(10)) for i in range(80)} | {200: set(range(50, 60)), 201: set(range(50, 60))}
    apart = {i: {i * 100, i * 100 + 1} for i in range(10)}
    noisy = {i: set(rng.choice(40, 15, replace=False).tolist()) for i in range(50)}
    scenes = {"drift": drift, "still": still, "apart": apart, "noisy": noisy}
    got = KF.iou_key_frames(table(spark, scenes), 0.5, width=width).toPandas()
    for name, sets in scenes.items():
        assert sorted(got[got.scene == name].frame_id) == walk(sets, 0.5), name


def test_frames_meet_by_words_of_voxels(spark, monkeypatch):
    """Codes of all ranges, the top bit of a word and null; a dense frame is a few rows, not one per voxel."""
    rng = np.random.default_rng(12)
    pool = [*range(-70, 70), 63, (1 << 40) + 63, (1 << 60) + 1, None]
    sets = {i: {pool[j] for j in rng.choice(len(pool), 90, replace=False)} for i in range(30)}
    rows = [("a", f, n) for f, nodes in sets.items() for n in nodes]
    written = []
    monkeypatch.setattr(KF, "cut", lambda df: written.append(df := cut(df)) or df)
    got = KF.iou_key_frames(spark.createDataFrame(rows, "scene string, frame_id bigint, node bigint"), 0.46, width=4)
    last, want = None, []
    for f, nodes in sets.items():
        common = len((nodes & last) - {None}) if last is not None else 0
        if last is None or common / (len(nodes) + len(last) - common) < 0.46:
            want, last = [*want, f], nodes
    assert sorted(r.frame_id for r in got.collect()) == want and 1 < len(want) < 30
    assert max(df.groupBy("f").count().agg({"count": "max"}).first()[0] for df in written if "word" in df.columns) <= 8


def cover(sets, window, state=None):
    """The greedy selection on plain sets."""
    if len(sets) <= window:
        return sorted(sets), state
    everything, picks = set().union(*sets.values()), []
    if state is None:
        first = min(sets, key=lambda f: (-len(sets[f]), f))
        picks, state = [first], everything - sets[first]
    while len(picks) < window:
        best = min(sets, key=lambda f: (-len(sets[f] & state), f))
        picks.append(best)
        state = state - sets[best]
        if not state:
            state = everything - sets[best]
    return picks, state


def test_greedy_cover_over_several_calls(spark):
    rng = np.random.default_rng(10)
    sets = {f: set(rng.choice(60, rng.integers(3, 20), replace=False).tolist()) for f in range(12)}
    df = table(spark, {"s": sets}).drop("scene")
    state, rest = None, None
    for _ in range(3):
        picks, rest = KF.greedy_cover(df, 4, rest)
        want, state = cover(sets, 4, state)
        assert [r.frame_id for r in picks.orderBy("step").collect()] == want
    few, same = KF.greedy_cover(df, 20, rest)
    assert few.count() == 12 and same is rest


def test_interval_key_frames(spark):
    ids = sorted(np.random.default_rng(11).choice(3000, 300, replace=False).tolist())
    got = KF.interval_key_frames(spark.createDataFrame([("a", i) for i in ids], "scene string, frame_id bigint"), 50)
    want, last = [], None
    for i in ids:
        if last is None or i - last >= 50:
            want.append(i)
            last = i
    assert sorted(r.frame_id for r in got.collect()) == want


def quota(counts, n):
    m, total = len(counts), sum(counts)
    if total == 0:
        return [n // m + (i < n % m) for i in range(m)]
    if m == 1:
        return [n]
    out = [max(1, int(n * (total - c) / (total * (m - 1)))) for c in counts]
    diff = n - sum(out)
    for i in range(abs(diff)):
        if diff > 0:
            out[i % m] += 1
        elif out[i % m] > 1:
            out[i % m] -= 1
    return out


@pytest.mark.parametrize("counts", [[5, 0, 9], [0, 0], [7], [1, 1, 1, 1, 100], [50, 50, 0, 3, 2, 1]])
@pytest.mark.parametrize("n", [1, 10, 1001])
def test_inverse_quota(spark, counts, n):
    df = spark.createDataFrame(list(enumerate(counts)), "frame_id int, samples bigint")
    got = [r.quota for r in SA.split_quota(df, n, inverse=True).orderBy("frame_id").collect()]
    assert got == quota(counts, n)


def test_random_draws_are_whole_and_repeatable(spark):
    df = spark.range(5000).selectExpr("id AS pt_id", "CASE WHEN id < 3000 THEN 0 ELSE id % 7 END AS frame_id")
    a = SA.take_random(df, 100, ("frame_id",)).toPandas()
    b = SA.take_random(df.repartition(3), 100, ("frame_id",)).toPandas()
    assert (a.groupby("frame_id").size() == 100).all() and set(a.pt_id) == set(b.pt_id)
    assert SA.take_random(df, 10**6, ("frame_id",)).count() == 5000
    d = SA.draw_rays(df, 50).toPandas()
    assert (d.groupby("frame_id").size() == 50).all() and d.duplicated(["frame_id", "j"]).sum() == 0


def test_every_frame_draws_its_own_ids(spark):
    df = spark.range(3000).selectExpr("id % 1000 AS pt_id", "id div 1000 AS frame_id", "IF(id % 2 = 0, 'a', 'b') AS scene")
    got = SA.take_random(df, 5, ("frame_id",)).toPandas().groupby("frame_id")["pt_id"].agg(set)
    assert len(set(map(frozenset, got))) == 3
    both = SA.take_random(df, 5, ("scene", "frame_id")).toPandas()
    assert (both.groupby(["scene", "frame_id"]).size() == 5).all()
    rays = SA.draw_rays(df, 20, ("scene", "frame_id")).toPandas()
    assert len({tuple(g.sort_values("j").pt_id) for _, g in rays.groupby(["scene", "frame_id"])}) == 6


def test_farthest_points_exact(spark):
    p = np.random.default_rng(12).random((200, 3))
    df = spark.createDataFrame(pd.DataFrame({"pt_id": np.arange(200), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    got = [r.pt_id for r in SA.farthest_points(df, 8, 0.0).orderBy("step").collect()]
    want, d = [0], ((p - p[0]) ** 2).sum(1)
    while len(want) < 8:
        want.append(int(d.argmax()))
        d = np.minimum(d, ((p - p[want[-1]]) ** 2).sum(1))
    assert got == want
