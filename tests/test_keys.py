import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxfield.functions import keys as K


def interleave(values, bits):
    n = len(values)
    return sum((v >> b & 1) << (n * b + a) for b in range(bits) for a, v in enumerate(values))


def test_morton_round_trip(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.integers(0, 1 << 20, (500, 3)), columns=["kx", "ky", "kz"])
    df = spark.createDataFrame(pdf).select("*", K.morton(K.key_columns()).alias("m3"), K.morton(K.key_columns(2)).alias("m2"))
    df = spark.createDataFrame(df.toPandas())
    back = [c.alias(f"d{i}") for i, c in enumerate(K.morton_decode(F.col("m3")))]
    back += [c.alias(f"e{i}") for i, c in enumerate(K.morton_decode(F.col("m2"), 2))]
    for r in df.select("*", *back).collect():
        assert r.m3 == interleave((r.kx, r.ky, r.kz), 20)
        assert r.m2 == interleave((r.kx, r.ky), 20)
        assert (r.d0, r.d1, r.d2, r.e0, r.e1) == (r.kx, r.ky, r.kz, r.kx, r.ky)


def test_codes_of_a_block_are_consecutive(spark):
    block = [(x, y, z) for z in (0, 1) for y in (0, 1) for x in (0, 1)]
    df = spark.createDataFrame(block, "kx bigint, ky bigint, kz bigint")
    codes = [r.m for r in df.select(K.morton(K.key_columns()).alias("m")).collect()]
    assert sorted(codes) == list(range(8))


def test_node_depth_at_every_power(spark):
    rows = [(dims, d, (1 << dims * d) + off) for dims in (2, 3) for d in range(60 // dims + 1) for off in (0, (1 << dims * d) - 1)]
    df = spark.createDataFrame(rows, "dims int, d int, node bigint")
    for dims in (2, 3):
        bad = df.filter(F.col("dims") == dims).filter(K.node_depth(F.col("node"), dims) != F.col("d"))
        assert bad.count() == 0


def test_common_ancestor(spark):
    rng = np.random.default_rng(2)
    depths = rng.integers(0, 9, (300, 2))
    pairs = [tuple(int(1 << 3 * d) + int(rng.integers(0, 1 << 3 * d)) for d in ds) for ds in depths]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").withColumn("c", K.common_ancestor(F.col("a"), F.col("b")))
    for r in df.collect():
        a, b = r.a, r.b
        while a != b:
            if a > b:
                a >>= 3
            else:
                b >>= 3
        assert r.c == a


def test_face_neighbour_is_null_at_the_border(spark):
    df = spark.createDataFrame([(0, 3, 7), (7, 0, 0)], "kx bigint, ky bigint, kz bigint")
    west = K.face_neighbour(K.key_columns(), "west", 3)
    top = K.face_neighbour(K.key_columns(), "top", 3)
    rows = df.select(*[c.alias(f"w{i}") for i, c in enumerate(west)], *[c.alias(f"t{i}") for i, c in enumerate(top)]).collect()
    assert tuple(rows[0]) == (None, None, None, None, None, None)
    assert tuple(rows[1]) == (6, 0, 0, 7, 0, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=3, max_size=3), st.integers(0, 8))
def test_parent_codes_are_prefixes(key, level):
    leaf = (1 << 24) | interleave(key, 8)
    assert leaf >> (3 * level) == (1 << 3 * (8 - level)) | interleave([k >> level for k in key], 8)


def test_common_ancestor_of_aligned_keys(spark):
    """All lower bits differ: the XOR is one below a power of two."""
    from pyspark.sql import functions as F

    from voxfield.functions import keys

    leaf = lambda code: F.lit((1 << 24) + code).cast("bigint")
    a, b = leaf(0), leaf((1 << 21) - 1)  # keys (0, 0, 0) and (127, 127, 127) at depth 8
    row = spark.range(1).select(keys.common_ancestor(a, b).alias("far"), keys.common_ancestor(a, a).alias("same"), keys.common_ancestor(a, leaf(7)).alias("near")).first()
    assert (row.far, row.same, row.near) == (8, 1 << 24, 1 << 21)
