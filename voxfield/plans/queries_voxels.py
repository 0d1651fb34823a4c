"""Driver queries for keys, codes and the voxel table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxfield.functions import keys as K
from voxfield.operators import voxelmap as V
from voxfield.plans import views
from voxfield.plans.registry import query
from voxfield.plans.views import DEPTH, KEYED, LEAVES, NODES, OFFSET, PTS, PTS_K, RES, code_sql, morton_sql, r6_sql

KXYZ = ["kx", "ky", "kz"]


def _leaves(spark, sf):
    return V.occupied_voxels(views.pts(spark, sf), RES, DEPTH)


def _nodes(spark, sf):
    return V.build_nodes(_leaves(spark, sf), DEPTH)


def _occupied(spark, sf, t):
    return V.occupied_voxels(views.pts(spark, sf), RES, DEPTH, t)


def _map(spark, sf):
    """A table with leaves of several sizes: only well-filled cells are refined to the finest level."""
    return V.semi_sparse(V.build_nodes(_occupied(spark, sf, 25), DEPTH), DEPTH, 5)


HIER = f"WITH {PTS}, {KEYED}, {LEAVES}, {NODES}"
MAP = f"""WITH {PTS}, {KEYED},
occ AS (SELECT {code_sql()} AS node FROM keyed GROUP BY kx, ky, kz HAVING count(*) > 25),
n0 AS (SELECT DISTINCT node >> (3 * l)::INTEGER AS node FROM occ, range({DEPTH + 1}) r(l)),
m0 AS (SELECT node FROM n0 UNION SELECT (p.node << 3) | i AS node
  FROM (SELECT DISTINCT node >> 3 AS node FROM n0 WHERE node > 1) p, range(8) c(i) WHERE p.node < {8 ** 5}),
map AS (SELECT node, (8 - floor((length(bin(node)) - 1) / 3))::BIGINT AS level FROM m0)"""


@query(
    "voxel_mean",
    f"""WITH {PTS}, {KEYED} SELECT scene, kx, ky, kz, count(*) AS n, {r6_sql('avg(x)')} AS mx, {r6_sql('avg(y)')} AS my,
    {r6_sql('avg(z)')} AS mz FROM keyed GROUP BY scene, kx, ky, kz""",
)
def voxel_mean(spark, sf):
    keyed = K.with_keys(views.pts(spark, sf), RES, DEPTH)
    return keyed.groupBy("scene", *KXYZ).agg(
        F.count("*").alias("n"), *[views.r6(F.avg(a)).alias(f"m{a}") for a in "xyz"]
    )


@query(
    "voxel_count_a1",
    f"WITH {PTS}, {KEYED} SELECT scene, frame_id, kx, ky, kz, count(*) AS n FROM keyed GROUP BY ALL",
)
def voxel_count(spark, sf):
    return V.voxel_counts(views.pts(spark, sf), RES, DEPTH, ("scene", "frame_id"))


@query(
    "voxel_threshold_a1",
    f"""WITH {PTS}, {KEYED}, f AS (SELECT scene, frame_id, kx, ky, kz FROM keyed GROUP BY ALL HAVING count(*) > 1)
    SELECT DISTINCT scene, kx, ky, kz, {code_sql()} AS node FROM f""",
)
def voxel_threshold(spark, sf):
    occ = V.occupied_voxels(views.pts(spark, sf), RES, DEPTH, 1, ("scene", "frame_id"))
    return occ.select("scene", *KXYZ, "node").distinct()


@query(
    "voxel_key_p10",
    f"""WITH {PTS_K} SELECT pt_id, floor(x / 2.0)::BIGINT + 128 AS kx, floor(y / 2.0)::BIGINT + 128 AS ky,
    floor(z / 2.0)::BIGINT + 128 AS kz FROM pts_k""",
)
def voxel_key(spark, sf):
    return K.with_keys(views.pts_k(spark, sf), RES, DEPTH, checked=False).select("pt_id", *KXYZ)


@query(
    "checked_key_p11",
    f"""WITH {PTS_K}, k AS (SELECT pt_id, floor(x / 2.0)::BIGINT + 16 AS a, floor(y / 2.0)::BIGINT + 16 AS b FROM pts_k)
    SELECT pt_id, CASE WHEN a BETWEEN 0 AND 31 THEN a END AS kx, CASE WHEN b BETWEEN 0 AND 31 THEN b END AS ky FROM k""",
)
def checked_key(spark, sf):
    p = views.pts_k(spark, sf)
    return p.select("pt_id", *[K.checked_key(K.point_key(F.col(a), RES, 5), 5).alias(f"k{a}") for a in "xy"])


@query(
    "morton_key_p12",
    f"""WITH {PTS}, {KEYED} SELECT DISTINCT kx, ky, kz, {morton_sql('kx', 'ky', 'kz')} AS m3, {morton_sql('kx', 'ky')} AS m2,
    kx AS dx, ky AS dy, kz AS dz, kx AS ex, ky AS ey FROM keyed""",
)
def morton_key(spark, sf):
    cells = K.with_keys(views.pts(spark, sf), RES, DEPTH).select(*KXYZ).distinct()
    cells = cells.select("*", K.morton(K.key_columns()).alias("m3"), K.morton(K.key_columns(2)).alias("m2"))
    decoded = [c.alias(f"d{a}") for a, c in zip("xyz", K.morton_decode(F.col("m3")))]
    return cells.select("*", *decoded, *[c.alias(f"e{a}") for a, c in zip("xy", K.morton_decode(F.col("m2"), 2))])


@query(
    "level_key_p13",
    f"""WITH {PTS}, {KEYED}, c AS (SELECT DISTINCT kx FROM keyed)
    SELECT kx, l AS level, CASE WHEN l = 0 THEN kx ELSE ((kx >> l) << l) + (1 << l) // 2 END AS key,
    CASE WHEN l = 0 THEN (kx - 128 + 0.5::DOUBLE) * 2.0::DOUBLE ELSE (((kx >> l) << l) + (1 << l) // 2 - 128) * 2.0::DOUBLE END AS centre
    FROM c, (SELECT l::INTEGER AS l FROM range(9) r(l))""",
)
def level_key(spark, sf):
    cells = K.with_keys(views.pts(spark, sf), RES, DEPTH).select("kx").distinct()
    cells = cells.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEPTH))))
    return cells.select(
        "kx",
        "level",
        K.level_key(F.col("kx"), F.col("level")).alias("key"),
        K.voxel_centre(F.col("kx"), F.col("level"), RES, DEPTH).alias("centre"),
    )


@query(
    "voxel_centre_p14",
    f"""WITH {PTS}, {KEYED} SELECT DISTINCT kx, ky, kz, (kx - 127.5::DOUBLE) * 2.0::DOUBLE AS cx, (ky - 127.5::DOUBLE) * 2.0::DOUBLE AS cy,
    (kz - 127.5::DOUBLE) * 2.0::DOUBLE AS cz, (kx - 128) * 2.0::DOUBLE AS lx FROM keyed""",
)
def voxel_centre(spark, sf):
    cells = K.with_keys(views.pts(spark, sf), RES, DEPTH).select(*KXYZ).distinct()
    return cells.select(
        *KXYZ,
        *[K.voxel_centre(F.col(f"k{a}"), 0, RES, DEPTH).alias(f"c{a}") for a in "xyz"],
        K.corner_coord(F.col("kx"), RES, DEPTH).alias("lx"),
    )


@query(
    "face_neighbours_p15",
    f"""WITH {PTS}, {KEYED}, c AS (SELECT DISTINCT kx, ky, kz FROM keyed), o(a, b, c) AS (VALUES (1,0,0),(-1,0,0),(0,1,0),(0,-1,0),(0,0,1),(0,0,-1))
    SELECT kx, ky, kz, kx + o.a AS nx, ky + o.b AS ny, kz + o.c AS nz FROM c, o""",
)
def face_neighbours(spark, sf):
    cells = K.with_keys(views.pts(spark, sf), RES, DEPTH).select(*KXYZ).distinct()
    return K.explode_neighbours(cells, DEPTH)


@query(
    "all_neighbours_p15",
    f"""WITH {PTS}, k AS (SELECT DISTINCT floor(x / 2.0)::BIGINT + 16 AS kx, floor(y / 2.0)::BIGINT + 16 AS ky FROM pts),
    c AS (SELECT * FROM k WHERE kx BETWEEN 0 AND 31 AND ky BETWEEN 0 AND 31), r AS (SELECT i FROM range(-1, 2) t(i))
    SELECT kx, ky, kx + a.i AS nx, ky + b.i AS ny FROM c, r a, r b WHERE (a.i <> 0 OR b.i <> 0)
    AND kx + a.i BETWEEN 0 AND 31 AND ky + b.i BETWEEN 0 AND 31""",
)
def all_neighbours(spark, sf):
    cells = K.with_keys(views.pts(spark, sf), RES, 5, 2).select("kx", "ky").distinct()
    return K.explode_neighbours(cells, 5, 2, full=True)


@query(
    "common_ancestor_p16",
    f"""WITH {PTS}, {KEYED}, f AS (SELECT scene, frame_id, min({code_sql()}) AS a, max({code_sql()}) AS b FROM keyed GROUP BY ALL)
    SELECT scene, frame_id, a, b, max(a >> (3 * l)::INTEGER) AS node FROM f, range({DEPTH + 1}) r(l)
    WHERE a >> (3 * l)::INTEGER = b >> (3 * l)::INTEGER GROUP BY ALL""",
)
def common_ancestor(spark, sf):
    occ = V.occupied_voxels(views.pts(spark, sf), RES, DEPTH, 0, ("scene", "frame_id"))
    ends = occ.groupBy("scene", "frame_id").agg(F.min("node").alias("a"), F.max("node").alias("b"))
    return ends.withColumn("node", K.common_ancestor(F.col("a"), F.col("b")))


@query(
    "node_size_p17",
    HIER + """ SELECT node, level, 2.0::DOUBLE * (1 << level::INTEGER) AS edge, (1 << level::INTEGER)::BIGINT AS size FROM nodes""",
)
def node_size(spark, sf):
    n = _nodes(spark, sf)
    return n.select(
        "node",
        F.col("level").cast("bigint").alias("level"),
        K.node_size(F.col("level"), RES).alias("edge"),
        K.discrete_size(F.col("level")).alias("size"),
    )


@query("node_levels_o1", HIER + " SELECT level, count(*) AS n, sum(node)::BIGINT AS code_sum FROM nodes GROUP BY level")
def node_levels(spark, sf):
    n = _nodes(spark, sf)
    return n.groupBy(F.col("level").cast("bigint").alias("level")).agg(
        F.count("*").alias("n"), F.sum("node").alias("code_sum")
    )


@query("semi_sparse_nodes_o2", MAP + " SELECT node, level FROM map")
def semi_sparse_nodes(spark, sf):
    return _map(spark, sf).select("node", F.col("level").cast("bigint").alias("level"))


def _unmorton(code, axis):
    return "(" + " + ".join(f"((({code} >> {3 * b + axis}) & 1) << {b})" for b in range(DEPTH)) + ")"


NODE_KEYS = f"""nk AS (SELECT node, level, (1 << level::INTEGER)::BIGINT AS size, (node - (1 << (3 * (8 - level))::INTEGER)) AS m FROM map),
boxes AS (SELECT node, level, size, {_unmorton('m', 0)} << level::INTEGER AS kx, {_unmorton('m', 1)} << level::INTEGER AS ky,
  {_unmorton('m', 2)} << level::INTEGER AS kz FROM nk),
lv AS (SELECT * FROM boxes WHERE node NOT IN (SELECT node >> 3 FROM map WHERE node > 1))"""


@query(
    "vertices_o3",
    MAP + f""", {NODE_KEYS} SELECT DISTINCT CASE WHEN level = 0 THEN 'leaf' ELSE 'shared' END AS ns, kx + (c & 1) * size AS vx,
    ky + ((c >> 1) & 1) * size AS vy, kz + ((c >> 2) & 1) * size AS vz FROM boxes, range(8) r(c)""",
)
def vertices(spark, sf):
    return V.vertex_table(_map(spark, sf), DEPTH, separate_leaves=True)


DEEP = """pk AS (SELECT pt_id, floor(x / 2.0)::BIGINT + 128 AS kx, floor(y / 2.0)::BIGINT + 128 AS ky, floor(z / 2.0)::BIGINT + 128 AS kz FROM pts_k)"""


@query(
    "deepest_voxel_j7",
    MAP + f""", {PTS_K}, {DEEP}, q AS (SELECT pt_id, {code_sql()} AS leaf FROM pk)
    SELECT pt_id, max(m.node) AS node FROM q CROSS JOIN range({DEPTH + 1}) r(l) LEFT JOIN map m ON m.node = q.leaf >> (3 * l)::INTEGER GROUP BY pt_id""",
)
def deepest_voxel(spark, sf):
    p = V.leaf_codes(views.pts_k(spark, sf), RES, DEPTH)
    return V.deepest_voxel(p, _map(spark, sf)).select("pt_id", "node")


@query(
    "ancestor_voxel_j8",
    MAP + f""", {PTS_K}, {DEEP}, q AS (SELECT pt_id, {code_sql()} >> 6 AS anc FROM pk)
    SELECT pt_id, m.node AS node FROM q LEFT JOIN map m ON m.node = q.anc""",
)
def ancestor_voxel(spark, sf):
    p = V.leaf_codes(views.pts_k(spark, sf), RES, DEPTH)
    return V.ancestor_voxel(p, _map(spark, sf), 3).select("pt_id", "node")


@query(
    "missing_voxels_j15",
    f"""WITH {PTS}, {KEYED}, {PTS_K}, {DEEP} SELECT DISTINCT {code_sql()} AS node FROM pk
    WHERE {code_sql()} NOT IN (SELECT {code_sql()} FROM keyed GROUP BY kx, ky, kz HAVING count(*) > 15)""",
)
def missing_voxels(spark, sf):
    new = V.occupied_voxels(views.pts_k(spark, sf), RES, DEPTH)
    return V.missing_voxels(new.select("node"), _occupied(spark, sf, 15))


@query("leaf_nodes_f16", MAP + f", {NODE_KEYS} SELECT node, level FROM lv")
def leaf_nodes(spark, sf):
    return V.leaf_nodes(_map(spark, sf)).select("node", F.col("level").cast("bigint").alias("level"))


@query("scan_nodes_f16", MAP + " SELECT node, level FROM map WHERE level >= 3")
def scan_nodes(spark, sf):
    return V.scan_nodes(_map(spark, sf), DEPTH - 3).select("node", F.col("level").cast("bigint").alias("level"))


@query("subtree_f16", MAP + " SELECT node, level FROM map WHERE level <= 6 AND node >> (3 * (6 - level))::INTEGER = 120")
def subtree(spark, sf):
    return V.subtree(_map(spark, sf), 120).select("node", F.col("level").cast("bigint").alias("level"))


@query(
    "nodes_in_box_f15",
    MAP + f""", {NODE_KEYS} SELECT node, level, kx, ky, kz FROM lv WHERE (kx + size - 128) * 2.0 >= 5.0 AND (kx - 128) * 2.0 <= 21.0
    AND (ky + size - 128) * 2.0 >= 7.0 AND (ky - 128) * 2.0 <= 30.5 AND (kz + size - 128) * 2.0 >= 0.5 AND (kz - 128) * 2.0 <= 6.0""",
)
def nodes_in_box(spark, sf):
    out = V.nodes_in_box(_map(spark, sf), (5.0, 7.0, 0.5), (21.0, 30.5, 6.0), RES, DEPTH, leaves_only=True)
    return out.select("node", F.col("level").cast("bigint").alias("level"), *KXYZ)


@query(
    "nodes_in_key_box_f15",
    MAP + f""", {NODE_KEYS} SELECT node, level FROM boxes WHERE kx + size > 130 AND kx <= 140 AND ky + size > 128 AND ky <= 135
    AND kz + size > 128 AND kz <= 129""",
)
def nodes_in_key_box(spark, sf):
    out = V.nodes_in_key_box(_map(spark, sf), (130, 128, 128), (140, 135, 129), DEPTH)
    return out.select("node", F.col("level").cast("bigint").alias("level"))


@query(
    "display_voxels_f12",
    MAP + """ SELECT node, (1 << level::INTEGER)::BIGINT AS size FROM map WHERE (1 << level::INTEGER) >= 2
    AND node NOT IN (SELECT node >> 3 FROM map WHERE node > 1 GROUP BY 1 HAVING count(*) = 8)""",
)
def display_voxels(spark, sf):
    return V.display_voxels(_map(spark, sf), DEPTH, 2).select("node", "size")


@query(
    "map_bounds_a3",
    MAP + f""", {NODE_KEYS}, b AS (SELECT min((kx - 128) * 2.0::DOUBLE) AS min_x, min((ky - 128) * 2.0::DOUBLE) AS min_y, min((kz - 128) * 2.0::DOUBLE) AS min_z,
    max((kx + size - 128) * 2.0::DOUBLE) AS max_x, max((ky + size - 128) * 2.0::DOUBLE) AS max_y, max((kz + size - 128) * 2.0::DOUBLE) AS max_z FROM lv)
    SELECT *, max_x - min_x AS size_x, max_y - min_y AS size_y, max_z - min_z AS size_z FROM b""",
)
def map_bounds(spark, sf):
    return V.map_bounds(_map(spark, sf), RES, DEPTH)


@query(
    "node_statistics_a4",
    MAP + f""", {NODE_KEYS} SELECT m.level::INTEGER AS level, count(*) AS n_nodes, count(lv.node) AS n_leaves
    FROM map m LEFT JOIN lv USING (node) GROUP BY m.level""",
)
def node_statistics(spark, sf):
    return V.node_statistics(_map(spark, sf), DEPTH)


def _search_codes(spark, sf):
    occ = V.occupied_voxels(views.pts_k(spark, sf), RES, DEPTH)
    return occ.select(K.ancestor(F.col("node"), 1).alias("query")).distinct()


SEARCH = f""", {PTS_K}, {DEEP}, q AS (SELECT DISTINCT {code_sql()} >> 3 AS query FROM pk)"""


@query(
    "search_nodes_o4",
    MAP + SEARCH + f""", {NODE_KEYS}, d AS (SELECT query, max(m.node) AS node FROM q, range(8) r(l), map m WHERE m.node = query >> (3 * l)::INTEGER GROUP BY query)
    SELECT q.query, d.node FROM q LEFT JOIN (SELECT * FROM d WHERE node = query OR node IN (SELECT node FROM lv)) d USING (query)""",
)
def search_nodes(spark, sf):
    return V.search_nodes(_search_codes(spark, sf), _map(spark, sf), DEPTH)


@query(
    "node_path_o4",
    MAP + SEARCH + " SELECT query, m.node FROM q, range(8) r(l), map m WHERE m.node = query >> (3 * l)::INTEGER",
)
def node_path(spark, sf):
    return V.node_path(_search_codes(spark, sf), _map(spark, sf)).select("query", "node")


@query(
    "delete_nodes_o5",
    MAP + f""", {NODE_KEYS}, dead AS (SELECT node FROM map WHERE level IN (1, 2) AND node % 3 = 0),
    gone AS (SELECT DISTINCT lv.node FROM lv, range(9) r(l), dead WHERE lv.node >> (3 * l)::INTEGER = dead.node)
    SELECT DISTINCT lv.node >> (3 * l)::INTEGER AS node FROM lv, range(9) r(l)
    WHERE lv.node NOT IN (SELECT node FROM gone) AND lv.node >> (3 * l)::INTEGER > 0""",
)
def delete_nodes(spark, sf):
    m = _map(spark, sf)
    doomed = m.filter(F.col("level").isin(1, 2) & (F.col("node") % 3 == 0))
    return V.delete_nodes(m, doomed).select("node")


@query(
    "prune_collapse_a16",
    "WITH RECURSIVE " + PTS + ", " + KEYED + f""", l0 AS (SELECT {code_sql()} AS node, 1::BIGINT AS value FROM keyed GROUP BY ALL HAVING count(*) > 0),
    """ + ",\n".join(
        f"""p{d} AS (SELECT node >> 3 AS node, min(value) AS value FROM l{DEPTH - d} GROUP BY node >> 3 HAVING count(*) = 8 AND min(value) = max(value)),
    l{DEPTH - d + 1} AS (SELECT * FROM p{d})"""
        for d in range(DEPTH, 0, -1)
    ) + " " + " UNION ALL ".join(
        f"SELECT node, value FROM l{DEPTH - d} WHERE node >> 3 NOT IN (SELECT node FROM p{d})" for d in range(DEPTH, 0, -1)
    ) + f" UNION ALL SELECT node, value FROM l{DEPTH}",
)
def prune_collapse(spark, sf):
    return V.prune(_leaves(spark, sf), F.lit(1).cast("bigint"), DEPTH)


@query(
    "expand_leaves_a16",
    MAP + f""", {NODE_KEYS} SELECT count(*) AS n, count(DISTINCT node) AS n_distinct, sum(hash)::BIGINT AS code_sum FROM
    (SELECT lv.node, (((lv.node << (3 * level)::INTEGER) + i) % 1000003) AS hash, (lv.node << (3 * level)::INTEGER) + i AS code
     FROM lv, range({8 ** 3}) r(i) WHERE level <= 3 AND i < (1 << (3 * level)::INTEGER))""",
)
def expand_leaves(spark, sf):
    leaves = V.leaf_nodes(_map(spark, sf)).filter(F.col("level") <= 3)
    leaves = leaves.select("node", F.col("node").alias("origin"))
    out = V.expand(leaves, DEPTH)
    return out.agg(
        F.count("*").alias("n"),
        F.countDistinct("origin").alias("n_distinct"),
        F.sum(F.col("node") % 1000003).alias("code_sum"),
    )


@query(
    "adjacent_leaves_j20",
    MAP + f""", {NODE_KEYS} SELECT a.node, b.node AS neighbour FROM lv a, lv b WHERE
    ((a.kx + a.size = b.kx OR b.kx + b.size = a.kx) AND a.ky < b.ky + b.size AND b.ky < a.ky + a.size AND a.kz < b.kz + b.size AND b.kz < a.kz + a.size)
    OR ((a.ky + a.size = b.ky OR b.ky + b.size = a.ky) AND a.kx < b.kx + b.size AND b.kx < a.kx + a.size AND a.kz < b.kz + b.size AND b.kz < a.kz + a.size)
    OR ((a.kz + a.size = b.kz OR b.kz + b.size = a.kz) AND a.kx < b.kx + b.size AND b.kx < a.kx + a.size AND a.ky < b.ky + b.size AND b.ky < a.ky + a.size)""",
)
def adjacent_leaves(spark, sf):
    return V.face_adjacent_leaves(V.leaf_nodes(_map(spark, sf)), DEPTH)


# -- O6: planar forms ----------------------------------------------------------------------------

QUAD = f"""WITH {PTS}, k2 AS (SELECT floor(x / 2.0)::BIGINT + 128 AS kx, floor(y / 2.0)::BIGINT + 128 AS ky FROM pts),
occ AS (SELECT {code_sql(kz=None)} AS node FROM k2 GROUP BY kx, ky HAVING count(*) > 60),
n0 AS (SELECT DISTINCT node >> (2 * l)::INTEGER AS node FROM occ, range({DEPTH + 1}) r(l)),
m0 AS (SELECT node FROM n0 UNION SELECT (p.node << 2) | i AS node
  FROM (SELECT DISTINCT node >> 2 AS node FROM n0 WHERE node > 1) p, range(4) c(i) WHERE p.node < {4 ** 5}),
map AS (SELECT node, (8 - floor((length(bin(node)) - 1) / 2))::BIGINT AS level FROM m0)"""


def _quad(spark, sf):
    occ = V.occupied_voxels(views.pts(spark, sf), RES, DEPTH, 60, dims=2)
    return V.semi_sparse(V.build_nodes(occ, DEPTH, 2), DEPTH, 5, 2)


@query("quad_nodes_o6", QUAD + " SELECT node, level FROM map")
def quad_nodes(spark, sf):
    return _quad(spark, sf).select("node", F.col("level").cast("bigint").alias("level"))


@query(
    "quad_deepest_o6",
    QUAD + f""", {PTS_K}, q AS (SELECT pt_id, floor(x / 2.0)::BIGINT + 128 AS kx, floor(y / 2.0)::BIGINT + 128 AS ky FROM pts_k),
    c AS (SELECT pt_id, {code_sql(kz=None)} AS leaf FROM q)
    SELECT pt_id, max(m.node) AS node FROM c CROSS JOIN range({DEPTH + 1}) r(l) LEFT JOIN map m ON m.node = c.leaf >> (2 * l)::INTEGER GROUP BY pt_id""",
)
def quad_deepest(spark, sf):
    p = V.leaf_codes(views.pts_k(spark, sf), RES, DEPTH, 2)
    return V.deepest_voxel(p, _quad(spark, sf), 2).select("pt_id", "node")
