"""Hard negatives against every pair."""

import collections
import math

import numpy as np
from pyspark.sql import functions as F

from voxfield.llm import bond


def brute(rows, anchor, positives=5, negatives=10):
    """rows: (vec_id, label, embedding)."""
    kept = {}
    for i, label, e in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            v = tuple(max(min(math.floor(256 * float(np.float32(x))), 1 << 55), -(1 << 55)) for x in e)
            kept[i] = min(kept.get(i, (v, label)), (v, label))
    out = []
    for i, (v, label) in kept.items():
        if not anchor(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, (w, other) in kept.items() if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            hits = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            big = lambda s: max(min(s, 2**63 - 1), -(2**63))
            out += [(i, j, r + 1, k, big(-p), big(-s)) for r, (s, k, _) in enumerate(hits)]
    return out


def run(spark, rows, **sizes):
    df = spark.createDataFrame([(i, l, e, "x", 1) for i, l, e in rows], "vec_id long, label int, embedding array<float>, page string, goals int")
    vectors = bond.whole_rows(df)
    return collections.Counter(tuple(r) for r in bond.hard_negatives(vectors, F.col("vec_id") % 10 == 0, **sizes).collect())


def some(n, width, rng, labels=3, scale=1.0, grid=None):
    x = rng.normal(size=(n, width)) * scale
    if grid:
        x = np.round(x * grid) / grid
    return [(int(i), int(rng.integers(labels)), [float(v) for v in e]) for i, e in enumerate(x.astype(np.float32))]


def test_negatives_against_every_pair(spark):
    rng = np.random.default_rng(5)
    rows = some(300, 40, rng) + [(1000 + 10 * i, i % 2, [0.5] * 40) for i in range(30)]  # equal vectors: ties
    rows += [(2000, 1, None), (2001, None, [1.0] * 40), (None, 1, [1.0] * 40), (2010, 1, [float("nan")] * 40), (2011, 0, [1.0, None] * 20), (2020, 1, [float("inf")] * 40)]
    rows += [(0, rows[0][1], rows[0][2]), (10, 2, [9.0] * 40), (2030, 0, [-1.0] * 40), (2040, 1, [0.0] * 40), (2041, 9, [1.0, 2.0])]
    want = collections.Counter(brute(rows, lambda i: i % 10 == 0))
    assert sum(want.values()) > 500
    assert run(spark, rows) == want
    assert run(spark, rows, page=70, chunk=9) == want


def test_scores_of_any_size(spark):
    rng = np.random.default_rng(6)
    for scale in (2.0**24, 2.0**40, 1e30):
        rows = some(60, 3, rng, scale=scale)
        assert run(spark, rows) == collections.Counter(brute(rows, lambda i: i % 10 == 0))


def test_empty_results(spark):
    rng = np.random.default_rng(7)
    assert not run(spark, []) and not run(spark, some(50, 4, rng, labels=1)) and not run(spark, [(i, 0, [1.0]) for i in (1, 2, 3)])


def test_scan_reads_part_of_the_columns():
    rng = np.random.default_rng(8)
    spread = np.exp(-np.arange(256) / 12)[:, None]
    columns = np.floor(1000 * rng.normal(size=(256, 4000)) * spread)
    anchor = np.floor(1000 * rng.normal(size=256) * spread[:, 0])
    score, vec, read = anchor @ columns, np.arange(4000), []
    lo, hi = 0.3 * score.max(), 0.9 * score.max()
    (at, best), (first, _) = bond.scan(columns, anchor, vec, vec, [(lo, hi), (None, None)], 10, read)
    inside = np.flatnonzero((score >= lo) & (score <= hi))
    assert list(at) == list(inside[np.argsort(-score[inside], kind="stable")][:10]) and (best == score[at]).all()
    assert list(first) == list(np.argsort(-score, kind="stable")[:10])
    assert sum(read) < 0.3 * columns.size
