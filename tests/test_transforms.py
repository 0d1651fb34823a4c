"""Transform chains against plain matrix products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxfield.operators import transforms as T

EDGE = "parent string, child string, t bigint, x double, y double, z double, qx double, qy double, qz double, qw double"
FIXED = EDGE.replace("t bigint, ", "")


def matrix(p, q):
    x, y, z, w = np.asarray(q) / np.linalg.norm(q)
    m = np.eye(4)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = p
    return m


def between(rows, t):
    """Position by linear and orientation by spherical interpolation; None outside the messages."""
    before, after = [r for r in rows if r[0] <= t], [r for r in rows if r[0] >= t]
    if not before or not after:
        return None
    a, b = max(before), min(after)
    f = 0.0 if a[0] == b[0] else (t - a[0]) / (b[0] - a[0])
    p, q = np.array(a[1]), np.array(b[1])
    c = float(p[3:] @ q[3:])
    sign, angle = (-1 if c < 0 else 1), np.arccos(min(1.0, abs(c)))
    w = (1 - f, f) if np.sin(angle) < 1e-6 else (np.sin((1 - f) * angle) / np.sin(angle), np.sin(f * angle) / np.sin(angle))
    return matrix(p[:3] + f * (q[:3] - p[:3]), w[0] * p[3:] + sign * w[1] * q[3:])


@pytest.fixture(scope="module")
def tree():
    """world <- odom <- base <- arm <- hand, base <- camera (fixed), world <- other; a ring and a lone pair."""
    rng = np.random.default_rng(9)

    def value():
        q = rng.normal(size=4)
        return [*rng.normal(size=3), *(q / np.linalg.norm(q))]

    moving = [("world", "odom"), ("odom", "base"), ("base", "arm"), ("arm", "hand"), ("world", "other"), ("ring1", "ring2"), ("ring2", "ring1"), ("isle", "boat")]
    edges = [(p, c, int(t), *map(float, value())) for p, c in moving for t in sorted(rng.choice(np.arange(0, 200), 12, replace=False))]
    edges += [(p, c, t, *map(float, value())) for p, c in moving for t in (0, 200)]
    edges = list({(e[1], e[2]): e for e in edges}.values())
    fixed = [("base", "camera", *map(float, value())), ("camera", "lens", *map(float, value())), ("nowhere", "arm", *map(float, value()))]
    return edges, fixed


def test_chains_against_matrix_products(spark, tree):
    edges, fixed = tree
    parent = {e[1]: e[0] for e in edges if e[1] not in ("ring1", "ring2")} | {"camera": "base", "lens": "camera"}
    held = {f[1]: matrix(f[2:5], f[5:]) for f in fixed[:2]}

    def up(frame):
        out = [frame]
        while out[-1] in parent:
            out.append(parent[out[-1]])
        return out

    def to_ancestor(frame, top, t):
        m = np.eye(4)
        for child in up(frame)[: up(frame).index(top)]:
            step = held.get(child)
            if step is None:
                step = between([(e[2], e[3:]) for e in edges if e[1] == child], t)
            if step is None:
                return None
            m = step @ m
        return m

    names = ["world", "odom", "base", "arm", "hand", "camera", "lens", "other", "isle", "boat"]
    asked = [(i, a, b, t) for i, (a, b, t) in enumerate((a, b, t) for a in names for b in names for t in (0, 77, 131, 200, 201, -1))]
    want = {}
    for i, a, b, t in asked:
        common = next((f for f in up(a) if f in up(b)), None)
        if common:
            s, g = to_ancestor(a, common, t), to_ancestor(b, common, t)
            if s is not None and g is not None:
                want[i] = np.linalg.inv(g) @ s
    odd = [(9001, "ring1", "ring2", 5), (9002, "ghost", "world", 5), (9003, None, "world", 5), (9004, "hand", None, 5), (9005, "hand", "world", None), (9006, "ghost", "ghost", 5)]
    df = spark.createDataFrame(asked + odd, "id bigint, source string, target string, t bigint")
    got = {r.id: np.array(r.pose).reshape(4, 4) for r in T.chain_transforms(df, spark.createDataFrame(edges, EDGE), spark.createDataFrame(fixed, FIXED)).collect()}
    assert set(got) == set(want) and len(want) > 250
    assert max(np.abs(got[i] - want[i]).max() for i in want) < 1e-9


def test_long_chain_takes_few_rounds(spark):
    edges = spark.range(300).select(F.concat(F.lit("f"), F.col("id")).alias("parent"), F.concat(F.lit("f"), F.col("id") + 1).alias("child"))
    for c, v in zip(FIXED.split(", ")[2:], (1.0, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)):
        edges = edges.withColumn(c.split()[0], F.lit(v))
    moving = spark.createDataFrame([], EDGE)
    asked = spark.createDataFrame([(1, "f300", "f0", 5), (2, "f10", "f250", 5)], "id bigint, source string, target string, t bigint")
    got = {r.id: r.pose[3] for r in T.chain_transforms(asked, moving, edges).collect()}
    assert got == {1: 300.0, 2: -240.0}
