import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxfield.functions import keys as K
from voxfield.operators import voxelmap as V


def nodes_of(df):
    return {r.node for r in df.select("node").collect()}


def leaves(spark, keys, depth):
    df = spark.createDataFrame(pd.DataFrame(keys, columns=["kx", "ky", "kz"]))
    return df.select(K.location_code(K.key_columns(), depth).alias("node")).distinct()


def test_build_and_complete(spark):
    keys = np.random.default_rng(7).integers(0, 32, (40, 3))
    leaf = nodes_of(leaves(spark, keys, 5))
    want = {n >> 3 * k for n in leaf for k in range(6)}
    built = V.build_nodes(leaves(spark, keys, 5), 5)
    assert nodes_of(built) == want
    inner = {n >> 3 for n in want if n > 1}
    full = want | {(n << 3) | c for n in inner if n < 8**3 for c in range(8)}
    assert nodes_of(V.semi_sparse(built, 5, 3)) == full


def test_deepest_voxel_is_the_longest_prefix(spark):
    rng = np.random.default_rng(8)
    nodes = V.semi_sparse(V.build_nodes(leaves(spark, rng.integers(0, 32, (60, 3)), 5), 5), 5, 4)
    have = nodes_of(nodes)
    p = pd.DataFrame(rng.random((400, 3)) * 40 - 20, columns=list("xyz")).assign(pt_id=np.arange(400))
    coded = V.leaf_codes(spark.createDataFrame(p), 1.0, 5)
    for r in V.deepest_voxel(coded, nodes).collect():
        n = r.leaf
        while n is not None and n not in have:
            n = n >> 3 if n > 1 else None
        assert r.node == n


def test_prune_then_expand_is_the_same_set(spark):
    block = [(x, y, z) for x in range(4) for y in range(4) for z in range(4)] + [(9, 9, 9)]
    leaf = leaves(spark, block, 4)
    pruned = V.prune(leaf, F.lit(7), 4)
    assert pruned.count() == 2
    assert nodes_of(V.expand(pruned, 4)) == nodes_of(leaf)


def test_prune_keeps_groups_with_different_values(spark):
    block = [(x, y, z) for x in range(2) for y in range(2) for z in range(2)]
    leaf = leaves(spark, block, 4)
    assert V.prune(leaf, F.when(F.col("node") % 2 == 0, 1).otherwise(2), 4).count() == 8


def test_delete_removes_childless_parents(spark):
    nodes = V.build_nodes(leaves(spark, [(0, 0, 0), (1, 0, 0), (9, 9, 9)], 4), 4)
    doomed = nodes.filter(F.col("node") == (1 << 12)).union(nodes.filter(F.col("node") == (1 << 12) + 1)).select("node")
    left = nodes_of(V.delete_nodes(nodes, doomed))
    gone = nodes_of(leaves(spark, [(9, 9, 9)], 4)).pop()
    assert left == {gone >> 3 * k for k in range(5)}


def test_adjacent_leaves_of_mixed_sizes(spark):
    # One pruned 2x2x2 block next to single cells.
    block = [(x, y, z) for x in range(2) for y in range(2) for z in range(2)] + [(2, 0, 0), (2, 2, 0), (3, 0, 0)]
    mixed = V.prune(leaves(spark, block, 4), F.lit(1), 4)
    pairs = {(r.node, r.neighbour) for r in V.face_adjacent_leaves(mixed, 4).collect()}
    code = lambda *k: nodes_of(leaves(spark, [k], 4)).pop()
    big = code(0, 0, 0) >> 3
    want = {(big, code(2, 0, 0)), (code(2, 0, 0), code(3, 0, 0))}
    assert pairs == want | {(b, a) for a, b in want}


def test_separate_leaf_vertices(spark):
    nodes = V.build_nodes(leaves(spark, [(0, 0, 0), (1, 0, 0)], 3), 3)
    table = V.vertex_table(nodes, 3, separate_leaves=True)
    assert table.filter("ns = 'leaf'").count() == 12
    assert V.vertex_table(nodes, 3).count() < table.count()
