"""Driver queries for grids, the field, surfaces and the fit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F


from voxfield.operators import field as FD
from voxfield.operators import grids, surface
from voxfield.operators import voxelmap as V
from voxfield.plans import fit, joint, views
from voxfield.plans.queries_selection import SAMPLES, samples
from voxfield.plans.queries_voxels import MAP, NODE_KEYS, _map
from voxfield.plans.registry import query
from voxfield.plans.views import DEPTH, PTS_K, RES, code_sql, r6, r6_sql

# -- grids over the bounds of the order points -----------------------------------------------------


def point_bounds(spark, sf):
    row = views.pts_k(spark, sf).agg(*[f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    return [row[f"lo{a}"] for a in "xyz"], [row[f"hi{a}"] for a in "xyz"]


BND = "bd AS (SELECT min(x) AS lx, max(x) AS hx, min(y) AS ly, max(y) AS hy, min(z) AS lz, max(z) AS hz FROM pts_k)"


def _grid_sql(res: float) -> str:
    return f"""gr AS (SELECT i::INTEGER AS i, j::INTEGER AS j, k::INTEGER AS k, lx + i * {res}::DOUBLE AS x, ly + j * {res}::DOUBLE AS y, lz + k * {res}::DOUBLE AS z FROM bd, range(200) a(i), range(200) b(j), range(60) c(k)
    WHERE i < ceil((hx - lx) / {res}::DOUBLE) AND j < ceil((hy - ly) / {res}::DOUBLE) AND k < ceil((hz - lz) / {res}::DOUBLE))"""


@query("grid_3d_g1", f"WITH {PTS_K}, {BND}, {_grid_sql(1.0)} SELECT i, j, k, {r6_sql('x')} AS x, {r6_sql('y')} AS y, {r6_sql('z')} AS z FROM gr")
def grid_3d(spark, sf):
    g = grids.grid_3d(spark, *point_bounds(spark, sf), 1.0)
    return g.select("i", "j", "k", *[r6(F.col(a)).alias(a) for a in "xyz"])


@query(
    "slice_grid_g2",
    f"""WITH {PTS_K}, {BND} SELECT i::INTEGER AS i, j::INTEGER AS j, {r6_sql('lx + i * 0.25::DOUBLE')} AS x, {r6_sql('(ly + hy) / 2.0::DOUBLE')} AS y, {r6_sql('lz + j * 0.25::DOUBLE')} AS z
    FROM bd, range(300) a(i), range(100) b(j) WHERE i < ceil((hx - lx) / 0.25::DOUBLE) AND j < ceil((hz - lz) / 0.25::DOUBLE)""",
)
def slice_grid(spark, sf):
    g = grids.slice_grid(spark, *point_bounds(spark, sf), 0.25, 1)
    return g.select("i", "j", *[r6(F.col(a)).alias(a) for a in "xyz"])


@query(
    "grid_dilate_g4",
    f"""WITH {PTS_K}, m AS (SELECT DISTINCT floor(x)::INTEGER AS i, floor(y)::INTEGER AS j, floor(z)::INTEGER AS k FROM pts_k)
    SELECT DISTINCT i + a AS i, j + b AS j, k + c AS k FROM m, (SELECT a::INTEGER AS a FROM range(-2, 3) r(a)), (SELECT b::INTEGER AS b FROM range(-2, 3) r(b)), (SELECT c::INTEGER AS c FROM range(-2, 3) r(c))
    WHERE i + a BETWEEN 0 AND 50 AND j + b BETWEEN 0 AND 50 AND k + c BETWEEN 0 AND 10""",
)
def grid_dilate(spark, sf):
    p = views.pts_k(spark, sf)
    mask = p.select(*[F.floor(a).cast("int").alias(n) for a, n in zip("xyz", "ijk")])
    return grids.dilate(mask, (51, 51, 11), 2)


# -- a vertex field with values from the corner keys -----------------------------------------------


def vertex_field(spark, sf):
    v = V.vertex_table(_map(spark, sf), DEPTH)
    x, y, z = F.col("vx"), F.col("vy"), F.col("vz")
    return v.select(
        "ns", "vx", "vy", "vz",
        (F.pmod(x * 7 + y * 13 + z * 17, F.lit(23)) / 10.0 - 1.0).alias("sdf"),
        (F.pmod(x * 3 + y, F.lit(5)) / 10.0).alias("gx"),
        (F.pmod(y * 5 + z, F.lit(7)) / 10.0 - 0.3).alias("gy"),
        (F.pmod(x + z * 2, F.lit(3)) / 10.0).alias("gz"),
        F.array(F.pmod(x + y, F.lit(4)) / 4.0, F.pmod(y + z * 3, F.lit(9)) / 9.0).alias("feat"),
    )


def corners(spark, sf, features=0):
    return FD.corner_rows(_map(spark, sf), vertex_field(spark, sf), RES, DEPTH, features=features)


QK = """pk AS (SELECT pt_id, x, y, z, floor(x / 2.0)::BIGINT + 128 AS kx, floor(y / 2.0)::BIGINT + 128 AS ky, floor(z / 2.0)::BIGINT + 128 AS kz FROM pts_k)"""
VAL = """((vx*7 + vy*13 + vz*17) % 23) / 10.0::DOUBLE - 1.0::DOUBLE AS s, ((vx*3 + vy) % 5) / 10.0::DOUBLE AS gx, ((vy*5 + vz) % 7) / 10.0::DOUBLE - 0.3::DOUBLE AS gy, ((vx + vz*2) % 3) / 10.0::DOUBLE AS gz,
  ((vx + vy) % 4) / 4.0::DOUBLE AS f0, ((vy + vz*3) % 9) / 9.0::DOUBLE AS f1"""


def _query_sql(points: str = PTS_K, pk: str = QK) -> str:
    """Deepest voxel, its corners, weights and slopes for each point, corner by corner."""
    return f"""{points}, {pk}, {NODE_KEYS}, lq AS (SELECT pt_id, x, y, z, {code_sql()} AS leaf FROM pk),
    loc AS (SELECT pt_id, x, y, z, max(m.node) AS node FROM lq, range({DEPTH + 1}) r(l), map m WHERE m.node = leaf >> (3 * l)::INTEGER GROUP BY ALL),
    cr AS (SELECT pt_id, loc.node, x, y, z, size * 2.0::DOUBLE AS edge, c, kx + (c & 1) * size AS vx, ky + ((c >> 1) & 1) * size AS vy, kz + ((c >> 2) & 1) * size AS vz FROM loc JOIN boxes USING (node), range(8) r(c)),
    cv AS (SELECT *, x - (vx - 128) * 2.0::DOUBLE AS ux, y - (vy - 128) * 2.0::DOUBLE AS uy, z - (vz - 128) * 2.0::DOUBLE AS uz, {VAL} FROM cr),
    cw AS (SELECT *, 1 - abs(ux) / edge AS wx, 1 - abs(uy) / edge AS wy, 1 - abs(uz) / edge AS wz, CASE WHEN c & 1 = 1 THEN 1 ELSE -1 END AS sx, CASE WHEN (c >> 1) & 1 = 1 THEN 1 ELSE -1 END AS sy, CASE WHEN (c >> 2) & 1 = 1 THEN 1 ELSE -1 END AS sz,
      s + gx * ux + gy * uy + gz * uz AS v FROM cv)"""


PRIOR = "sum(wx * wy * wz * v)"
GRAD = {
    "x": "sum(sx / edge * wy * wz * v + wx * wy * wz * gx)",
    "y": "sum(sy / edge * wx * wz * v + wx * wy * wz * gy)",
    "z": "sum(sz / edge * wx * wy * v + wx * wy * wz * gz)",
}


@query("trilinear_g5", f"{MAP}, {_query_sql()} SELECT pt_id, node, {r6_sql('sum(wx * wy * wz * s)')} AS sdf FROM cw GROUP BY pt_id, node")
def trilinear(spark, sf):
    out = FD.query_sdf(views.pts_k(spark, sf), corners(spark, sf), RES, DEPTH, augmented=False, gradient=False)
    return out.filter("node IS NOT NULL").select("pt_id", "node", r6(F.col("sdf_prior")).alias("sdf"))


@query(
    "query_sdf_g10_g6_g12",
    f"{MAP}, {_query_sql()} SELECT pt_id, node, {r6_sql(PRIOR)} AS sdf, " + ", ".join(f"{r6_sql(g)} AS grad_{a}" for a, g in GRAD.items()) + " FROM cw GROUP BY pt_id, node",
)
def query_sdf(spark, sf):
    out = FD.query_sdf(views.pts_k(spark, sf), corners(spark, sf), RES, DEPTH).filter("node IS NOT NULL")
    return out.select("pt_id", "node", r6(F.col("sdf_prior")).alias("sdf"), *[r6(F.col(f"grad_{a}")).alias(f"grad_{a}") for a in "xyz"])


@query(
    "voxel_corner_values_j9",
    f"{MAP}, {NODE_KEYS}, cr AS (SELECT node, c, kx + (c & 1) * size AS vx, ky + ((c >> 1) & 1) * size AS vy, kz + ((c >> 2) & 1) * size AS vz FROM boxes, range(8) r(c)), cv AS (SELECT *, {VAL} FROM cr) "
    + f"SELECT node, {r6_sql('sum(s)')} AS total, {r6_sql('max(s) FILTER (c = 5)')} AS sdf5, {r6_sql('max(gy) FILTER (c = 2)')} AS gy2 FROM cv GROUP BY node",
)
def voxel_corner_values(spark, sf):
    c = corners(spark, sf)
    total = sum((F.col(f"sdf{i}") for i in range(1, 8)), F.col("sdf0"))
    return c.select("node", r6(total).alias("total"), r6(F.col("sdf5")).alias("sdf5"), r6(F.col("gy2")).alias("gy2"))


@query(
    "level_features_g7",
    f"{MAP}, {PTS_K}, {QK}, {NODE_KEYS}, lv0 AS (SELECT pt_id, x, y, z, n, {code_sql()} >> (3 * (n - 1))::INTEGER AS node FROM pk, range(1, 4) r(n)),"
    + f""" cr AS (SELECT pt_id, n, x, y, z, size * 2.0::DOUBLE AS edge, kx + (c & 1) * size AS vx, ky + ((c >> 1) & 1) * size AS vy, kz + ((c >> 2) & 1) * size AS vz FROM lv0 JOIN boxes USING (node), range(8) r(c)),
    cv AS (SELECT *, {VAL} FROM cr), cw AS (SELECT *, (1 - abs(x - (vx - 128) * 2.0::DOUBLE) / edge) * (1 - abs(y - (vy - 128) * 2.0::DOUBLE) / edge) * (1 - abs(z - (vz - 128) * 2.0::DOUBLE) / edge) AS w FROM cv),
    fe AS (SELECT pt_id, n, sum(w * f0) AS a, sum(w * f1) AS b FROM cw GROUP BY ALL)
    SELECT p.pt_id, """ + ", ".join(
        f"{r6_sql(f'coalesce(max({c}) FILTER (n = {n}), 0)')} AS l{n}{c}" for n in (1, 2, 3) for c in "ab"
    ) + " FROM pts_k p LEFT JOIN fe USING (pt_id) GROUP BY p.pt_id",
)
def level_features(spark, sf):
    out = FD.level_features(views.pts_k(spark, sf), corners(spark, sf, 2), RES, DEPTH, 3, 2, "pt_id")
    cells = [r6(F.get("feat", i)).alias(f"l{i // 2 + 1}{'ab'[i % 2]}") for i in range(6)]
    return out.select("pt_id", *cells)


# Two small fixed layers, so that SQL can state the network.
LAYERS = [(np.array([[0.5, -1.0, 0.25], [-0.75, 0.5, 1.0]]), np.array([0.1, -0.2])), (np.array([[1.5, -0.5]]), np.array([0.05]))]


@query(
    "residual_model_g8_g9",
    f"""{MAP}, {_query_sql()}, fe AS (SELECT pt_id, {PRIOR} AS p, sum(wx * wy * wz * f0) FILTER (edge = 2.0) AS a, sum(wx * wy * wz * f1) FILTER (edge = 2.0) AS b FROM cw GROUP BY pt_id),
    h AS (SELECT pt_id, p, 0.5::DOUBLE * p - coalesce(a, 0) + 0.25::DOUBLE * coalesce(b, 0) + 0.1::DOUBLE AS h0, -0.75::DOUBLE * p + 0.5::DOUBLE * coalesce(a, 0) + coalesce(b, 0) - 0.2::DOUBLE AS h1 FROM fe),
    r AS (SELECT pt_id, p, 0.1::DOUBLE * (1.5::DOUBLE * CASE WHEN h0 >= 0 THEN h0 ELSE 0.01::DOUBLE * h0 END - 0.5::DOUBLE * CASE WHEN h1 >= 0 THEN h1 ELSE 0.01::DOUBLE * h1 END + 0.05::DOUBLE) AS res FROM h)
    SELECT pt_id, {r6_sql('p')} AS sdf_prior, {r6_sql('res')} AS sdf_residual, {r6_sql('p + res')} AS sdf FROM r""",
)
def residual_model(spark, sf):
    c = corners(spark, sf, 2)
    p = FD.level_features(views.pts_k(spark, sf), c, RES, DEPTH, 1, 2, "pt_id")
    out = FD.compose(FD.query_sdf(p, c, RES, DEPTH, gradient=False).filter("node IS NOT NULL"), LAYERS)
    return out.select("pt_id", *[r6(F.col(k)).alias(k) for k in ("sdf_prior", "sdf_residual", "sdf")])


@query("central_gradient_g11")
def central_gradient(spark, sf):
    c = corners(spark, sf)
    field = lambda p: FD.query_sdf(p, c, RES, DEPTH, gradient=False)
    return FD.central_gradient(views.pts_k(spark, sf), field, 0.01, "pt_id")


@query(
    "vertex_filter_f13_g13",
    f"""{MAP}, {PTS_K}, {BND}, {_grid_sql(2.0)}, kk AS (SELECT i, j, k, floor(x / 2.0::DOUBLE)::BIGINT + 128 AS kx, floor(y / 2.0::DOUBLE)::BIGINT + 128 AS ky, floor(z / 2.0::DOUBLE)::BIGINT + 128 AS kz FROM gr),
    lq AS (SELECT i, j, k, {code_sql()} AS leaf FROM kk), loc AS (SELECT i, j, k, max(m.node) AS node FROM lq, range({DEPTH + 1}) r(l), map m WHERE m.node = leaf >> (3 * l)::INTEGER GROUP BY ALL),
    f AS (SELECT i, j, k FROM loc JOIN map USING (node) WHERE (1 << level::INTEGER) <= 2)
    SELECT DISTINCT g.i, g.j, g.k FROM f, gr g WHERE abs(f.i - g.i) <= 1 AND abs(f.j - g.j) <= 1 AND abs(f.k - g.k) <= 1""",
)
def vertex_filter(spark, sf):
    low, high = point_bounds(spark, sf)
    g = grids.grid_3d(spark, low, high, 2.0)
    shape = [grids.steps(l, h, 2.0) for l, h in zip(low, high)]
    return FD.filtered_grid(g, _map(spark, sf), RES, DEPTH, 1, 2, shape).select("i", "j", "k")


@query("extract_slice_g14")
def extract_slice(spark, sf):
    c = corners(spark, sf)
    s = grids.slice_grid(spark, *point_bounds(spark, sf), 0.25, 2)
    return FD.extract_grid(s, lambda p: FD.query_sdf(p, c, RES, DEPTH))


# -- surfaces: point density of the order points on a unit grid, minus a level --------------------

DENS = """den AS (SELECT floor(x / 2.0)::INTEGER AS i, floor(y / 2.0)::INTEGER AS j, floor(z / 2.0)::INTEGER AS k, count(*) - 4.5::DOUBLE AS sdf FROM pts_k GROUP BY ALL)"""


def density(spark, sf):
    p = views.pts_k(spark, sf)
    cell = [F.floor(F.col(a) / 2.0).cast("int").alias(n) for a, n in zip("xyz", "ijk")]
    return p.groupBy(*cell).agg((F.count("*") - 4.5).alias("sdf"))


def _crossings(dims: int) -> str:
    """Grid edges that change sign and belong to a complete cell."""
    axes = "ijk"[:dims]
    parts = []
    n = 1 << dims
    ids = "(i::BIGINT * 26 + j) * 6 + k" if dims == 3 else "i::BIGINT * 26 + j"
    cells = f"cel AS (SELECT {', '.join(f'{a} - (c >> {b} & 1)::INTEGER AS {a}' for b, a in enumerate(axes))} FROM den, range({n}) r(c) GROUP BY ALL HAVING count(*) = {n})"
    for b, a in enumerate(axes):
        on = " AND ".join(f"q.{x} = p.{x}" + (" + 1" if x == a else "") for x in axes)
        around = " AND ".join(
            f"cel.{x} = p.{x}" if x == a else f"cel.{x} BETWEEN p.{x} - 1 AND p.{x}" for x in axes
        )
        t = f"(0.0 - p.sdf) / (q.sdf - p.sdf)"
        coords = ", ".join(f"(p.{x} + {'(' + t + ')' if x == a else '0.0'}) * 2.0::DOUBLE AS {'xyz'[n2]}" for n2, x in enumerate(axes))
        pid = ids.replace("i::", "p.i::").replace("+ j", "+ p.j").replace("+ k", "+ p.k")
        parts.append(
            f"SELECT ({pid}) * {dims} + {b} AS vid, {coords} FROM den p JOIN den q ON {on} WHERE (p.sdf < 0) <> (q.sdf < 0) AND EXISTS (SELECT 1 FROM cel WHERE {around})"
        )
    return cells + ", vx AS (" + " UNION ALL ".join(parts) + ")"


@query("iso_vertices_g15", f"WITH {PTS_K}, {DENS}, {_crossings(3)} SELECT vid, {r6_sql('x')} AS x, {r6_sql('y')} AS y, {r6_sql('z')} AS z FROM vx")
def iso_vertices(spark, sf):
    v, _ = surface.iso_surface(density(spark, sf), (0.0, 0.0, 0.0), 2.0, (26, 26, 6))
    return v.select("vid", *[r6(F.col(a)).alias(a) for a in "xyz"])


@query("iso_triangles_g15")
def iso_triangles(spark, sf):
    return surface.iso_surface(density(spark, sf), (0.0, 0.0, 0.0), 2.0, (26, 26, 6))[1]


DENS2 = """den AS (SELECT floor(x / 2.0)::INTEGER AS i, floor(y / 2.0)::INTEGER AS j, count(*) - 24.5::DOUBLE AS sdf FROM pts_k GROUP BY ALL)"""


def _flat_density(spark, sf):
    cell = [F.floor(F.col(a) / 2.0).cast("int").alias(n) for a, n in zip("xy", "ij")]
    return views.pts_k(spark, sf).groupBy(*cell).agg((F.count("*") - 24.5).alias("sdf"))


@query("iso_line_vertices_g16", f"WITH {PTS_K}, {DENS2}, {_crossings(2)} SELECT vid, {r6_sql('x')} AS x, {r6_sql('y')} AS y FROM vx")
def iso_line_vertices(spark, sf):
    v, _ = surface.iso_lines(_flat_density(spark, sf), (0.0, 0.0), 2.0, (26, 26))
    return v.select("vid", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("iso_line_segments_g16")
def iso_line_segments(spark, sf):
    return surface.iso_lines(_flat_density(spark, sf), (0.0, 0.0), 2.0, (26, 26))[1]


WIRE = f"""{NODE_KEYS}, ed(axis, a, b, c) AS (VALUES (0,0,0,0),(0,0,1,0),(0,0,0,1),(0,0,1,1),(1,0,0,0),(1,1,0,0),(1,0,0,1),(1,1,0,1),(2,0,0,0),(2,1,0,0),(2,0,1,0),(2,1,1,0)),
wi AS (SELECT DISTINCT axis, kx + a * size AS x, ky + b * size AS y, kz + c * size AS z, size AS length FROM boxes, ed)"""


@query("wire_edges_g17_a19", f"{MAP}, {WIRE} SELECT axis, x, y, z, length FROM wi WHERE (x - 128) * 2.0 >= 0 AND (x + CASE WHEN axis = 0 THEN length ELSE 0 END - 128) * 2.0 <= 32 AND (y - 128) * 2.0 >= 0 AND (y + CASE WHEN axis = 1 THEN length ELSE 0 END - 128) * 2.0 <= 32 AND (z - 128) * 2.0 >= 0 AND (z + CASE WHEN axis = 2 THEN length ELSE 0 END - 128) * 2.0 <= 32")
def wire_edges(spark, sf):
    e = surface.wire_edges(_map(spark, sf), DEPTH)
    return surface.crop_edges(e, (0, 0, 0), (32, 32, 32), RES, DEPTH)


@query(
    "longest_edge_w4",
    f"{MAP}, {WIRE} SELECT axis, x, y, z, length FROM wi QUALIFY row_number() OVER (PARTITION BY axis, x + CASE WHEN axis = 0 THEN length ELSE 0 END, y + CASE WHEN axis = 1 THEN length ELSE 0 END, z + CASE WHEN axis = 2 THEN length ELSE 0 END ORDER BY length DESC) = 1",
)
def longest_edge(spark, sf):
    return surface.longest_edges(surface.wire_edges(_map(spark, sf), DEPTH))


@query(
    "edges_distinct_a19",
    "SELECT DISTINCT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b FROM lineitem",
)
def edges_distinct(spark, sf):
    e = views.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return surface.unique_edges(e)


# -- losses and fit ------------------------------------------------------------------------------


def labelled(spark, sf):
    """Ray samples with a label and a made-up prediction."""
    s = samples(spark, sf)
    sign = F.when(F.col("behind"), -1.0).otherwise(1.0)
    label = F.when(F.col("kind") == "surface", 0.0).otherwise(sign * (F.pmod(F.col("ray_id") + F.col("s_idx"), F.lit(7)) + 1) / 10.0)
    return s.select(
        "kind", "behind", label.alias("label"),
        (label + (F.pmod(F.col("ray_id") * 3 + F.col("s_idx"), F.lit(11)) - 5) / 50.0).alias("sdf"),
        (F.pmod(F.col("ray_id"), F.lit(5)) / 4.0).alias("gx"), (F.pmod(F.col("s_idx"), F.lit(3)) / 3.0).alias("gy"), F.lit(0.25).alias("gz"),
    )


LAB = f"""{SAMPLES}, l0 AS (SELECT kind, behind, ray_id, s_idx, CASE WHEN kind = 'surface' THEN 0.0::DOUBLE ELSE CASE WHEN behind THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END * ((ray_id + s_idx) % 7 + 1) / 10.0::DOUBLE END AS label FROM samples),
l1 AS (SELECT kind, behind, label, label + ((ray_id * 3 + s_idx) % 11 - 5) / 50.0::DOUBLE AS f, sqrt(((ray_id % 5) / 4.0::DOUBLE) * ((ray_id % 5) / 4.0::DOUBLE) + ((s_idx % 3) / 3.0::DOUBLE) * ((s_idx % 3) / 3.0::DOUBLE) + 0.0625::DOUBLE) AS g,
  CASE WHEN behind THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS s FROM l0)"""


@query(
    "loss_report_a15_l2",
    f"""WITH {LAB}, t AS (SELECT avg(abs(f)) FILTER (kind = 'surface') AS boundary, avg(greatest(s * f - s * label, 0) + exp(2.0::DOUBLE * greatest(0.1::DOUBLE - s * f, 0)) - 1) FILTER (kind = 'perturbed') AS perturbation,
      avg(abs(g - 1)) FILTER (kind = 'surface') AS es, avg(abs(g - 1)) FILTER (kind = 'perturbed') AS ep, avg(abs(g - 1)) FILTER (kind = 'stratified') AS ef, avg(abs(f - label)) FILTER (kind = 'stratified') AS projection,
      avg(0.5::DOUBLE * exp(-2.0::DOUBLE * 3.0::DOUBLE * abs(f)) * (g * g + 1)) FILTER (kind = 'stratified') AS heat, avg(abs(tanh(10.0::DOUBLE * f) - 1)) FILTER (kind <> 'surface' AND NOT behind) AS sf, avg(abs(tanh(10.0::DOUBLE * f) + 1)) FILTER (kind <> 'surface' AND behind) AS so FROM l1)
    SELECT {r6_sql('boundary')} AS boundary_sdf, {r6_sql('perturbation')} AS perturbation_sdf, {r6_sql('es')} AS eikonal_surface_sdf, {r6_sql('ep')} AS eikonal_perturbation_sdf, {r6_sql('ef')} AS eikonal_space_sdf,
    {r6_sql('projection')} AS projection_sdf, {r6_sql('heat')} AS heat_sdf, {r6_sql('sf')} AS sign_free_sdf, {r6_sql('so')} AS sign_occ_sdf, {r6_sql('boundary + perturbation + es + ep + ef + projection + 0.5::DOUBLE * heat')} AS total FROM t""",
)
def loss_report(spark, sf):
    cfg = fit.Losses(heat=0.5, heat_lambda=3.0, exp_penalty=2.0, temperature=10.0)
    out = fit.loss_report(labelled(spark, sf), cfg, {"sdf": ("sdf", ["gx", "gy", "gz"])})
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


def ball_samples(spark, sf):
    """Order points labelled with their signed distance to a ball: a known field to fit."""
    p = views.pts_k(spark, sf)
    d = F.sqrt((F.col("x") - 20) * (F.col("x") - 20) + (F.col("y") - 25) * (F.col("y") - 25) + (F.col("z") - 5) * (F.col("z") - 5)) - 12.0
    return p.select("x", "y", "z", F.lit("stratified").alias("kind"), (d < 0).alias("behind"), d.alias("label"))


@query("fit_vertices_l1")
def fit_vertices(spark, sf):
    nodes = _map(spark, sf)
    cfg = fit.Losses(eikonal={"surface": 0.0, "perturbation": 0.0, "space": 0.1})
    start = fit.initial_vertices(nodes, DEPTH)
    return fit.fit_vertices(ball_samples(spark, sf), nodes, start, RES, DEPTH, steps=3, rate=0.5, cfg=cfg)


@query("fit_residual_l3")
def fit_residual(spark, sf):
    rows = ball_samples(spark, sf).select((F.col("label") + 0.3).alias("sdf_prior"), F.array(F.col("x") / 50.0, F.col("y") / 50.0).alias("feat"), "label")
    _, losses = fit.fit_residual(rows, fit.random_layers(3, (8, 8)), steps=3, rate=0.05)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "step int, loss double")


@query("fit_joint_l3")
def fit_joint(spark, sf):
    """Loss of the prediction over three steps of the joint fit of prior, features and network."""
    nodes, losses = _map(spark, sf), []
    start = joint.initial_features(fit.initial_vertices(nodes, DEPTH), 4)
    layers = fit.random_layers(1 + 2 * 4, (16, 16))
    joint.fit_joint(ball_samples(spark, sf), nodes, start, layers, RES, DEPTH, steps=3, rate=0.05, levels=2, on_step=lambda i, x: losses.append((i, x)))
    return spark.createDataFrame(losses, "step int, loss double")
