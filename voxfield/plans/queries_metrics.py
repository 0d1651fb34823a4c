"""Driver queries for nearest-neighbour joins, meshes, polygons and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.operators import filters, mesh, metrics
from voxfield.operators import nearest as N
from voxfield.operators import rays as R
from voxfield.plans import views
from voxfield.plans.queries_selection import SAMPLES, samples
from voxfield.plans.registry import query
from voxfield.plans.views import PTS_K, SURFACE, VECS, r6, r6_sql

D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


@query(
    "nn_join_j10",
    f"""WITH {PTS_K}, {SURFACE}, u AS (SELECT x, y, z, min(dst_id) AS dst_id FROM surface GROUP BY x, y, z),
    m AS (SELECT a.pt_id, min(({D2}, b.dst_id)) AS best FROM pts_k a, u b GROUP BY a.pt_id)
    SELECT pt_id, best[2] AS dst_id, {r6_sql('sqrt(best[1])')} AS dist FROM m""",
)
def nn_join(spark, sf):
    out = N.nearest_points(views.pts_k(spark, sf), views.surface(spark, sf), "pt_id", "dst_id")
    return out.select("pt_id", "dst_id", r6(F.col("dist")).alias("dist"))


def _vec_sides(spark, sf):
    v = views.vecs(spark, sf)
    return v.filter("label < 5"), v.filter("label >= 5").withColumnRenamed("id", "other")


VEC_SIDES = f"{VECS}, va AS (SELECT * FROM vecs WHERE label < 5), vb AS (SELECT id AS other, x, y, z FROM vecs WHERE label >= 5)"


@query(
    "nn_vectors_j10",
    f"WITH {VEC_SIDES}, m AS (SELECT a.id, min(({D2}, b.other)) AS best FROM va a, vb b GROUP BY a.id) SELECT id, best[2] AS other, {r6_sql('sqrt(best[1])')} AS dist FROM m",
)
def nn_vectors(spark, sf):
    a, b = _vec_sides(spark, sf)
    return N.nearest_points(a, b, "id", "other").select("id", "other", r6(F.col("dist")).alias("dist"))


def _probes(spark, sf):
    """A lattice point next to every order, as grid points to label."""
    o = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(
        o.alias("g"),
        (F.pmod(o, F.lit(50)) + 0.25).alias("x"),
        (F.pmod(F.col("o_custkey"), F.lit(50)) + 0.5).alias("y"),
        (F.pmod(o, F.lit(11)) + 0.125).alias("z"),
    )


@query(
    "cloud_labels_j11",
    f"""WITH {SURFACE}, u AS (SELECT DISTINCT x, y, z FROM surface),
    g AS (SELECT o_orderkey AS g, o_orderkey % 50 + 0.25::DOUBLE AS x, o_custkey % 50 + 0.5::DOUBLE AS y, o_orderkey % 11 + 0.125::DOUBLE AS z FROM orders),
    o(s, i, j, k) AS (VALUES (0, 0, 0, 0), (1, 1, 0, 0), (2, -1, 0, 0), (3, 0, 1, 0), (4, 0, -1, 0), (5, 0, 0, 1), (6, 0, 0, -1)),
    p AS (SELECT g, s, x + i * 0.0625::DOUBLE AS x, y + j * 0.0625::DOUBLE AS y, z + k * 0.0625::DOUBLE AS z FROM g, o),
    dp AS (SELECT DISTINCT x, y, z FROM p),
    m AS (SELECT a.x, a.y, a.z, sqrt(min({D2})) AS d FROM dp a, u b GROUP BY a.x, a.y, a.z),
    w AS (SELECT g, max(d) FILTER (s = 0) AS sdf, (max(d) FILTER (s = 1) - max(d) FILTER (s = 2)) / 0.125::DOUBLE AS gx, (max(d) FILTER (s = 3) - max(d) FILTER (s = 4)) / 0.125::DOUBLE AS gy,
      (max(d) FILTER (s = 5) - max(d) FILTER (s = 6)) / 0.125::DOUBLE AS gz FROM p JOIN m USING (x, y, z) GROUP BY g),
    n AS (SELECT *, sqrt(gx*gx + gy*gy + gz*gz) AS l FROM w)
    SELECT g, {r6_sql('sdf')} AS sdf, {r6_sql('CASE WHEN l < 1e-6 THEN gx ELSE gx / l END')} AS gx, {r6_sql('CASE WHEN l < 1e-6 THEN gz ELSE gz / l END')} AS gz FROM n""",
)
def cloud_labels(spark, sf):
    out = N.cloud_labels(_probes(spark, sf), views.surface(spark, sf), 0.0625, "g", "dst_id")
    return out.select("g", *[r6(F.col(c)).alias(c) for c in ("sdf", "gx", "gz")])


BOTH = f"""{VEC_SIDES}, dd AS (SELECT 'a_to_b' AS side, a.id, sqrt(min({D2})) AS dist FROM va a, vb b GROUP BY a.id
UNION ALL SELECT 'b_to_a', b.other, sqrt(min({D2})) FROM va a, vb b GROUP BY b.other)"""


def _both(spark, sf):
    a, b = _vec_sides(spark, sf)
    return N.both_ways(a, b, "id", "other")


@query("both_ways_j12", f"WITH {BOTH} SELECT side, id, {r6_sql('dist')} AS dist FROM dd")
def both_ways(spark, sf):
    return _both(spark, sf).select("side", "id", r6(F.col("dist")).alias("dist"))


@query(
    "chamfer_f1_a11",
    f"""WITH {BOTH}, m AS (SELECT avg(dist) FILTER (side = 'a_to_b') AS acc, avg(dist) FILTER (side = 'b_to_a') AS comp,
    avg(CASE WHEN dist < 0.06 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (side = 'a_to_b') AS p, avg(CASE WHEN dist < 0.06 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (side = 'b_to_a') AS r FROM dd)
    SELECT {r6_sql('acc')} AS accuracy, {r6_sql('comp')} AS completion, {r6_sql('(acc + comp) / 2')} AS chamfer, {r6_sql('r')} AS completion_ratio, {r6_sql('p')} AS precision, {r6_sql('r')} AS recall,
    {r6_sql('CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END')} AS f1 FROM m""",
)
def chamfer_f1(spark, sf):
    out = metrics.surface_metrics(_both(spark, sf), 0.06)
    return out.select(*[r6(F.col(c)).alias(c) for c in out.columns])


NEAR = f"""{PTS_K}, {SURFACE}, u AS (SELECT DISTINCT x, y, z FROM surface), nn AS (SELECT a.pt_id, sqrt(min({D2})) AS dist FROM pts_k a, u b GROUP BY a.pt_id)"""


@query(
    "vertex_error_j13_a12",
    f"""WITH {NEAR} SELECT {r6_sql('min(dist)')} AS min, {r6_sql('max(dist)')} AS max, {r6_sql('avg(dist)')} AS mean, {r6_sql('median(dist)')} AS median,
    {r6_sql('stddev_pop(dist)')} AS std, count(*) AS n FROM nn""",
)
def vertex_error(spark, sf):
    near = N.nearest_points(views.pts_k(spark, sf), views.surface(spark, sf), "pt_id", "dst_id")
    out = metrics.error_summary(near, "dist")
    return out.select(*[r6(F.col(c)).alias(c) for c in ("min", "max", "mean", "median", "std")], "n")


@query(
    "error_stats_a12",
    """WITH e AS (SELECT o_orderpriority AS grp, o_totalprice AS v FROM orders) SELECT grp, min(v) AS min, max(v) AS max, round(median(v), 3) AS median, round(avg(v) + 1e-7, 4) AS mean,
    round(stddev_pop(v) + 1e-7, 4) AS std, count(*) AS n FROM e GROUP BY grp""",
)
def error_stats(spark, sf):
    e = views.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_totalprice").alias("v"))
    out = metrics.error_summary(e, "v", ("grp",))
    return out.select("grp", "min", "max", F.round("median", 3).alias("median"), F.round(F.col("mean") + 1e-7, 4).alias("mean"), F.round(F.col("std") + 1e-7, 4).alias("std"), "n")


@query(
    "error_hist_a13",
    f"""WITH {PTS_K}, b AS (SELECT min(x) AS lo, (max(x) - min(x)) / 50 AS w FROM pts_k), h AS (SELECT least(floor((x - lo) / w), 49)::INTEGER AS bin, lo, w FROM pts_k, b)
    SELECT bin, {r6_sql('lo + bin * w')} AS low, {r6_sql('lo + (bin + 1) * w')} AS high, count(*) AS n FROM h GROUP BY bin, lo, w""",
)
def error_hist(spark, sf):
    h = metrics.histogram(views.pts_k(spark, sf), "x")
    return h.select("bin", r6(F.col("low")).alias("low"), r6(F.col("high")).alias("high"), "n")


# Ground truth and two predictions per grid point, from order columns.
FIELD = """fld AS (SELECT o_orderkey AS i, o_custkey AS j, (o_totalprice / 10000.0::DOUBLE - 20.0::DOUBLE) / 10.0::DOUBLE AS truth,
  (o_totalprice / 10000.0::DOUBLE - 20.0::DOUBLE) / 10.0::DOUBLE + ((o_orderkey % 17) - 8) / 100.0::DOUBLE AS sdf,
  (o_totalprice / 10000.0::DOUBLE - 20.0::DOUBLE) / 10.0::DOUBLE + ((o_orderkey % 29) - 14) / 100.0::DOUBLE AS sdf_prior FROM orders),
reg AS (SELECT *, CASE WHEN abs(truth) > 0.5::DOUBLE * 5.0 THEN 'outlier' WHEN truth BETWEEN -0.4 AND 0.4 THEN 'near' WHEN truth > 0.4 THEN 'far' END AS region FROM fld)"""


def field_rows(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    truth = (F.col("o_totalprice") / 10000.0 - 20.0) / 10.0
    base = views.table(spark, sf, "orders")
    gt = base.select(o.alias("i"), c.alias("j"), truth.alias("truth"))
    pred = base.select(
        o.alias("i"), c.alias("j"),
        (truth + (F.pmod(o, F.lit(17)) - 8) / 100.0).alias("sdf"), (truth + (F.pmod(o, F.lit(29)) - 14) / 100.0).alias("sdf_prior"),
    )
    out = metrics.join_truth(pred, gt, ("i", "j"))
    return out.withColumn("region", filters.region(F.col("truth"), -0.4, 0.4, 5.0))


ERRS = """er AS (SELECT 'sdf' AS field, region, sdf - truth AS e FROM reg WHERE region IN ('near', 'far') UNION ALL SELECT 'sdf_prior', region, sdf_prior - truth FROM reg WHERE region IN ('near', 'far'))"""


@query(
    "sdf_metrics_a9_j21_u5",
    f"""WITH {FIELD}, {ERRS} SELECT field, region, count(*) AS n, {r6_sql('avg(abs(e))')} AS mae, {r6_sql('sqrt(avg(e * e))')} AS rmse FROM er GROUP BY ALL
    UNION ALL SELECT field, 'all', count(*), {r6_sql('avg(abs(e))')}, {r6_sql('sqrt(avg(e * e))')} FROM er GROUP BY field""",
)
def sdf_metrics(spark, sf):
    out = metrics.sdf_errors(field_rows(spark, sf), ("sdf", "sdf_prior"))
    return out.select("field", "region", "n", r6(F.col("mae")).alias("mae"), r6(F.col("rmse")).alias("rmse"))


@query(
    "gradient_metrics_a10_f14",
    f"""WITH {FIELD}, a AS (SELECT region, acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (0.6::DOUBLE * sdf + 0.8::DOUBLE * truth) / ((sqrt(sdf*sdf + truth*truth) + 1e-8::DOUBLE) * (sqrt(0.6::DOUBLE*0.6::DOUBLE + 0.8::DOUBLE*0.8::DOUBLE) + 1e-8::DOUBLE))))) AS angle
    FROM reg WHERE sdf > 0 AND truth > 0 AND region IN ('near', 'far')), f AS (SELECT * FROM a WHERE angle < 0.2)
    SELECT 'sdf' AS field, region, count(*) AS n, {r6_sql('avg(angle)')} AS angle FROM f GROUP BY region UNION ALL SELECT 'sdf', 'all', count(*), {r6_sql('avg(angle)')} FROM f""",
)
def gradient_metrics(spark, sf):
    f = field_rows(spark, sf)
    f = f.withColumn("angle", G.gradient_angle([F.col("sdf"), F.col("truth")], [F.lit(0.6), F.lit(0.8)]))
    kept = filters.comparable_gradients(f, F.col("sdf"), F.col("truth"), F.col("angle"), 0.2)
    out = metrics.gradient_errors(kept.withColumn("field", F.lit("sdf")))
    return out.select("field", "region", "n", r6(F.col("angle")).alias("angle"))


@query(
    "region_counts_f9_a14",
    f"WITH {FIELD} SELECT count(*) FILTER (region = 'near') AS near, count(*) FILTER (region = 'far') AS far, count(*) AS total FROM reg",
)
def region_counts(spark, sf):
    return metrics.region_counts(field_rows(spark, sf))


@query(
    "masked_mean_a8",
    f"WITH {FIELD} SELECT j % 7 AS grp, {r6_sql('coalesce(sum(sdf) FILTER (truth > 2.9), 0) / greatest(count(*) FILTER (truth > 2.9), 1)')} AS masked, {r6_sql('avg(sdf)')} AS plain FROM fld GROUP BY j % 7",
)
def masked_mean(spark, sf):
    f = field_rows(spark, sf)
    out = f.groupBy(F.pmod("j", F.lit(7)).alias("grp")).agg(
        r6(metrics.masked_mean(F.col("sdf"), F.col("truth") > 2.9)).alias("masked"), r6(metrics.masked_mean(F.col("sdf"))).alias("plain")
    )
    return out


@query(
    "sdf_labels_r4_u2",
    f"""WITH {SAMPLES}, {SURFACE}, d AS (SELECT DISTINCT x, y, z FROM (SELECT x, y, z FROM samples WHERE kind = 'surface' UNION ALL SELECT x, y, z FROM surface)),
    q AS (SELECT ray_id, s_idx, behind, x, y, z, floor(x / 2.0::DOUBLE) AS cx, floor(y / 2.0::DOUBLE) AS cy, floor(z / 2.0::DOUBLE) AS cz FROM samples WHERE kind <> 'surface'),
    c AS (SELECT d.*, floor(x / 2.0::DOUBLE) + i AS cx, floor(y / 2.0::DOUBLE) + j AS cy, floor(z / 2.0::DOUBLE) + k AS cz FROM d, (SELECT i FROM range(-1, 2) r(i)), (SELECT j FROM range(-1, 2) r(j)), (SELECT k FROM range(-1, 2) r(k))),
    n1 AS (SELECT a.ray_id, a.s_idx, sqrt(min({D2})) AS dist FROM q a JOIN c b USING (cx, cy, cz) GROUP BY ALL),
    rest AS (SELECT q.* FROM q LEFT JOIN n1 USING (ray_id, s_idx) WHERE n1.dist IS NULL OR n1.dist > 2.0),
    n2 AS (SELECT a.ray_id, a.s_idx, sqrt(min({D2})) AS dist FROM rest a, d b GROUP BY ALL),
    nn AS (SELECT * FROM n1 WHERE dist <= 2.0 UNION ALL SELECT * FROM n2)
    SELECT q.ray_id, q.s_idx, {r6_sql('CASE WHEN behind THEN -dist ELSE dist END')} AS label FROM q JOIN nn USING (ray_id, s_idx)""",
)
def sdf_labels(spark, sf):
    out = R.sdf_labels(samples(spark, sf), views.surface(spark, sf)).filter(F.col("kind") != "surface")
    return out.select("ray_id", "s_idx", r6(F.col("label")).alias("label"))


# -- meshes: one open square pyramid per part ------------------------------------------------------


def pyramids(spark, sf):
    """Four slanted triangles around every part's position: two tables (vertices, triangles)."""
    p = views.surface(spark, sf)
    corner = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(dz).alias("dz"))
        for i, (dx, dy, dz) in enumerate([(-0.5, -0.5, 0.0), (0.5, -0.5, 0.0), (0.5, 0.5, 0.0), (-0.5, 0.5, 0.0), (0.0, 0.0, 0.75)])
    ])
    v = p.select("dst_id", "x", "y", "z", F.explode(corner).alias("c")).select(
        (F.col("dst_id") * 8 + F.col("c.i")).alias("vid"), (F.col("x") + F.col("c.dx")).alias("x"), (F.col("y") + F.col("c.dy")).alias("y"), (F.col("z") + F.col("c.dz")).alias("z")
    )
    t = p.select("dst_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k")).select(
        (F.col("dst_id") * 8 + F.col("k")).alias("fid"),
        F.when(F.col("k") == 4, F.col("dst_id") * 8).otherwise(F.col("dst_id") * 8 + F.col("k")).alias("a"),
        F.when(F.col("k") == 4, F.col("dst_id") * 8).otherwise(F.col("dst_id") * 8 + F.pmod(F.col("k") + 1, F.lit(4))).alias("b"),
        (F.col("dst_id") * 8 + 4).alias("c"),
    )
    return v, t


MESH = f"""{SURFACE}, o(i, dx, dy, dz) AS (VALUES (0, -0.5::DOUBLE, -0.5::DOUBLE, 0.0::DOUBLE), (1, 0.5, -0.5, 0.0), (2, 0.5, 0.5, 0.0), (3, -0.5, 0.5, 0.0), (4, 0.0, 0.0, 0.75)),
mv AS (SELECT dst_id * 8 + i AS vid, x + dx AS x, y + dy AS y, z + dz AS z FROM surface, o),
mt AS (SELECT dst_id * 8 + k AS fid, CASE WHEN k = 4 THEN dst_id * 8 ELSE dst_id * 8 + k END AS a, CASE WHEN k = 4 THEN dst_id * 8 ELSE dst_id * 8 + (k + 1) % 4 END AS b, dst_id * 8 + 4 AS c FROM surface, range(5) r(k)),
tri AS (SELECT fid, a, b, c, p.x AS ax, p.y AS ay, p.z AS az, q.x AS bx, q.y AS by_, q.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM mt JOIN mv p ON p.vid = a JOIN mv q ON q.vid = b JOIN mv r ON r.vid = c WHERE a <> b AND b <> c AND a <> c)"""


def triangles(spark, sf):
    v, t = pyramids(spark, sf)
    return mesh.triangle_corners(filters.proper_triangles(t), v)


@query("triangle_corners_j14_f17", f"WITH {MESH} SELECT fid, a, b, c, {r6_sql('ax')} AS ax, {r6_sql('by_')} AS b_y, {r6_sql('cz')} AS cz FROM tri")
def triangle_corners(spark, sf):
    return triangles(spark, sf).select("fid", "a", "b", "c", r6(F.col("ax")).alias("ax"), r6(F.col("by")).alias("b_y"), r6(F.col("cz")).alias("cz"))


@query("remove_ceiling_f10", f"WITH {MESH} SELECT fid FROM tri WHERE greatest(az, bz, cz) < (SELECT max(greatest(az, bz, cz)) FROM tri) - 2.5")
def remove_ceiling(spark, sf):
    return filters.remove_ceiling(triangles(spark, sf), 2.5).select("fid")


@query("surface_samples_t8")
def surface_samples(spark, sf):
    return mesh.sample_surface(triangles(spark, sf), 20_000)


@query(
    "surface_sample_counts_t8",
    f"WITH {MESH}, ar AS (SELECT fid, 0.5::DOUBLE * sqrt(0.5::DOUBLE * 0.5::DOUBLE + 0.75::DOUBLE * 0.75::DOUBLE) AS area FROM tri) SELECT 20000::BIGINT AS n, {r6_sql('sum(area)')} AS area FROM ar",
)
def surface_sample_counts(spark, sf):
    t = triangles(spark, sf)
    area = mesh.with_area(t).agg(r6(F.sum("area")).alias("area"))
    return mesh.sample_surface(t, 20_000).agg(F.count("*").alias("n")).join(F.broadcast(area))


def blocks(spark, sf):
    """A closed box around every 40th of the x range: boxes that do not touch, as triangles."""
    p = views.surface(spark, sf).groupBy(F.floor(F.col("x") / 2.0).alias("k")).agg(F.max("y").alias("top"), F.min("y").alias("bottom"))
    # Unit-cube triangles; corner i has bits x, y, z.
    faces = [(0, 2, 1), (1, 2, 3), (4, 5, 6), (5, 7, 6), (0, 1, 4), (1, 5, 4), (2, 6, 3), (3, 6, 7), (0, 4, 2), (2, 4, 6), (1, 3, 5), (3, 7, 5)]
    x = lambda i: F.col("k") * 2.0 + (0.25 if not i & 1 else 1.5)
    y = lambda i: F.col("bottom") - 0.125 if not i & 2 else F.col("top") + 0.125
    z = lambda i: F.lit(1.03 if not i & 4 else 8.03)
    rows = [
        F.struct(
            (F.col("k") * 16 + n).alias("fid"),
            *[f(i).alias(f"{c}{a}") for c, i in zip("abc", tri) for a, f in (("x", x), ("y", y), ("z", z))],
        )
        for n, tri in enumerate(faces)
    ]
    return p.select(F.explode(F.array(*rows)).alias("t")).select("t.*")


BLOCKS = f"""{SURFACE}, bl AS (SELECT floor(x / 2.0) * 2.0::DOUBLE + 0.25::DOUBLE AS x0, floor(x / 2.0) * 2.0::DOUBLE + 1.5::DOUBLE AS x1, min(y) - 0.125::DOUBLE AS y0, max(y) + 0.125::DOUBLE AS y1, 1.03::DOUBLE AS z0, 8.03::DOUBLE AS z1 FROM surface GROUP BY floor(x / 2.0))"""


@query(
    "mesh_sdf_j22",
    f"""WITH {PTS_K}, {BLOCKS}, q AS (SELECT pt_id, x + 0.013::DOUBLE AS x, y + 0.017::DOUBLE AS y, z + 0.011::DOUBLE AS z FROM pts_k),
    d AS (SELECT pt_id, greatest(x0 - x, x - x1) AS ux, greatest(y0 - y, y - y1) AS uy, greatest(z0 - z, z - z1) AS uz FROM q, bl),
    s AS (SELECT pt_id, min(sqrt(pow(greatest(ux, 0), 2) + pow(greatest(uy, 0), 2) + pow(greatest(uz, 0), 2)) + least(greatest(ux, uy, uz), 0)) AS sdf FROM d GROUP BY pt_id)
    SELECT pt_id, {r6_sql('sdf')} AS sdf FROM s""",
)
def mesh_sdf(spark, sf):
    p = views.pts_k(spark, sf).select("pt_id", (F.col("x") + 0.013).alias("x"), (F.col("y") + 0.017).alias("y"), (F.col("z") + 0.011).alias("z"))
    return mesh.mesh_sdf(p, blocks(spark, sf), "pt_id").select("pt_id", r6(F.col("sdf")).alias("sdf"))


def skyline(spark, sf):
    """One closed polygon over the parts: a step profile with the largest y per unit of x."""
    top = views.surface(spark, sf).groupBy(F.col("x")).agg(F.max("y").alias("h"))
    x0, x1, h = F.col("x") - 0.45, F.col("x") + 0.45, F.col("h") + 0.3
    low = F.lit(-0.7)
    pts = [(x0, low), (x1, low), (x1, h), (x0, h)]
    edges = [
        F.struct((F.col("x").cast("bigint") * 4 + i).alias("eid"), *[c.alias(n) for n, c in zip(("ax", "ay", "bx", "by"), (*pts[i], *pts[(i + 1) % 4]))])
        for i in range(4)
    ]
    return top.select(F.explode(F.array(*edges)).alias("e")).select("e.*")


SKY = f"{SURFACE}, bar AS (SELECT x - 0.45::DOUBLE AS x0, x + 0.45::DOUBLE AS x1, max(y) + 0.3::DOUBLE AS h FROM surface GROUP BY x)"


@query(
    "pip_winding_j19",
    f"WITH {PTS_K}, {SKY} SELECT pt_id, count(x0)::BIGINT AS winding, count(x0) <> 0 AS inside FROM pts_k LEFT JOIN bar ON x > x0 AND x < x1 AND y > -0.7 AND y < h GROUP BY pt_id",
)
def pip_winding(spark, sf):
    return mesh.inside_polygon(views.pts_k(spark, sf), skyline(spark, sf), "pt_id")


@query(
    "polygon_sdf_j23",
    f"""WITH {PTS_K}, {SKY}, d AS (SELECT pt_id, greatest(x0 - x, x - x1) AS ux, greatest(-0.7::DOUBLE - y, y - h) AS uy FROM pts_k, bar),
    s AS (SELECT pt_id, min(sqrt(pow(greatest(ux, 0), 2) + pow(greatest(uy, 0), 2)) + least(greatest(ux, uy), 0)) AS sdf FROM d GROUP BY pt_id) SELECT pt_id, {r6_sql('sdf')} AS sdf FROM s""",
)
def polygon_sdf(spark, sf):
    return mesh.polygon_sdf(views.pts_k(spark, sf), skyline(spark, sf), "pt_id", "eid").select("pt_id", r6(F.col("sdf")).alias("sdf"))
