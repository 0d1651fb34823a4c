"""Driver queries for poses, projections, filters, time joins and trajectories."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.functions import shapes as S
from voxfield.operators import asof, filters, frames, transforms
from voxfield.plans import views
from voxfield.plans.registry import query
from voxfield.plans.views import PTS, PTS_K, RAYS, SCANS, TRAJ, r6, r6_sql

HOUR = 3_600_000_000

# -- poses: one per customer; orders are the points seen from it ----------------------------------


def _quaternion(key):
    parts = [F.pmod(key, F.lit(n)) - F.lit(m) for n, m in ((7, 3), (11, 5), (13, 6), (5, -1))]
    return [c.cast("double") for c in parts]


def cams(spark, sf):
    key = F.col("c_custkey")
    q = _quaternion(key)
    t = [F.col("c_acctbal") / 1000.0, F.pmod(key, F.lit(40)).cast("double"), F.pmod(key, F.lit(7)).cast("double")]
    raw = views.table(spark, sf, "customer").select(
        key.alias("frame_id"), *[c.alias(f"t{a}") for a, c in zip("xyz", t)], *[c.alias(f"q{a}") for a, c in zip("xyzw", q)]
    )
    pose = G.quaternion_pose(G.vec("tx", "ty", "tz"), G.vec("qx", "qy", "qz", "qw"))
    return raw.select("frame_id", pose.alias("pose"))


def seen_points(spark, sf):
    o = F.col("o_orderkey")
    return views.table(spark, sf, "orders").select(
        o.alias("pt_id"),
        F.col("o_custkey").alias("frame_id"),
        (F.col("o_totalprice") / 10000.0).alias("x"),
        (F.pmod(o * 7919, F.lit(1000)) / 20.0).alias("y"),
        (F.pmod(F.col("o_custkey") * 104729, F.lit(200)) / 20.0).alias("z"),
    )


QN = "sqrt(a*a + b*b + c*c + d*d)"
CAMS = f"""cq AS (SELECT c_custkey AS frame_id, c_acctbal / 1000.0::DOUBLE AS tx, (c_custkey % 40)::DOUBLE AS ty, (c_custkey % 7)::DOUBLE AS tz,
  (c_custkey % 7 - 3)::DOUBLE AS a, (c_custkey % 11 - 5)::DOUBLE AS b, (c_custkey % 13 - 6)::DOUBLE AS c, (c_custkey % 5 + 1)::DOUBLE AS d FROM customer),
cu AS (SELECT frame_id, tx, ty, tz, a / {QN} AS qx, b / {QN} AS qy, c / {QN} AS qz, d / {QN} AS qw FROM cq),
cams AS (SELECT frame_id, tx, ty, tz, 1 - 2*(qy*qy + qz*qz) AS r00, 2*(qx*qy - qz*qw) AS r01, 2*(qx*qz + qy*qw) AS r02,
  2*(qx*qy + qz*qw) AS r10, 1 - 2*(qx*qx + qz*qz) AS r11, 2*(qy*qz - qx*qw) AS r12,
  2*(qx*qz - qy*qw) AS r20, 2*(qy*qz + qx*qw) AS r21, 1 - 2*(qx*qx + qy*qy) AS r22 FROM cu)"""
SEEN = """seen AS (SELECT o_orderkey AS pt_id, o_custkey AS frame_id, o_totalprice / 10000.0::DOUBLE AS x,
  ((o_orderkey * 7919) % 1000) / 20.0::DOUBLE AS y, ((o_custkey * 104729) % 200) / 20.0::DOUBLE AS z FROM orders)"""
WORLD = f"""{CAMS}, {SEEN}, world AS (SELECT pt_id, frame_id, r00*x + r01*y + r02*z + tx AS x, r10*x + r11*y + r12*z + ty AS y,
  r20*x + r21*y + r22*z + tz AS z, tx, ty, tz FROM seen JOIN cams USING (frame_id))"""


def world(spark, sf):
    return frames.world_points(seen_points(spark, sf), cams(spark, sf), ("frame_id",))


@query(
    "quaternion_pose_p4",
    f"WITH {CAMS} SELECT frame_id, " + ", ".join(f"{r6_sql(f'r{i}{j}')} AS r{i}{j}" for i in range(3) for j in range(3)) + f", {r6_sql('tx')} AS tx FROM cams",
)
def quaternion_pose(spark, sf):
    c = cams(spark, sf)
    cells = [r6(G.pose_at(F.col("pose"), i, j)).alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    return c.select("frame_id", *cells, r6(G.pose_at(F.col("pose"), 0, 3)).alias("tx"))


@query("message_pose_p5", f"WITH {CAMS} SELECT 'pose' AS kind, frame_id, {r6_sql('r01')} AS r01, {r6_sql('ty')} AS ty FROM cams UNION ALL SELECT 'odometry', frame_id, {r6_sql('r01')}, {r6_sql('ty')} FROM cams UNION ALL SELECT 'transform', frame_id, {r6_sql('r01')}, {r6_sql('ty')} FROM cams")
def message_pose(spark, sf):
    key = F.col("c_custkey")
    place = F.struct(
        (F.col("c_acctbal") / 1000.0).alias("x"), F.pmod(key, F.lit(40)).cast("double").alias("y"), F.pmod(key, F.lit(7)).cast("double").alias("z")
    )
    turn = F.struct(*[c.alias(a) for c, a in zip(_quaternion(key), "xyzw")])
    raw = views.table(spark, sf, "customer").select(key.alias("frame_id"), place.alias("p"), turn.alias("q"))
    body = F.struct(F.col("p").alias("position"), F.col("q").alias("orientation"))
    messages = {
        "pose": F.struct(body.alias("pose")),
        "odometry": F.struct(F.struct(body.alias("pose")).alias("pose")),
        "transform": F.struct(F.struct(F.col("p").alias("translation"), F.col("q").alias("rotation")).alias("transform")),
    }
    out = None
    for kind, msg in messages.items():
        rows = G.message_pose(raw.withColumn("msg", msg), kind)
        rows = rows.select(F.lit(kind).alias("kind"), "frame_id", r6(G.pose_at(F.col("pose"), 0, 1)).alias("r01"), r6(G.pose_at(F.col("pose"), 1, 3)).alias("ty"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("world_points_p3_j1", f"WITH {WORLD} SELECT pt_id, {r6_sql('x')} AS x, {r6_sql('y')} AS y, {r6_sql('z')} AS z FROM world")
def world_points(spark, sf):
    return world(spark, sf).select("pt_id", *[r6(F.col(a)).alias(a) for a in "xyz"])


@query(
    "pixel_points_p1_p2",
    f"""WITH s AS (SELECT o_orderkey AS px, (o_orderkey % 1200)::DOUBLE AS u, ((o_orderkey * 31) % 680)::DOUBLE AS v, o_totalprice / 10000.0::DOUBLE AS depth FROM orders)
    SELECT px, {r6_sql('(u - 599.5::DOUBLE) / 600.0::DOUBLE * depth')} AS x, {r6_sql('(v - 339.5::DOUBLE) / 600.0::DOUBLE * depth')} AS y, {r6_sql('depth')} AS z,
    {r6_sql('(u - 299.75::DOUBLE) / 300.0::DOUBLE')} AS half_x FROM s""",
)
def pixel_points(spark, sf):
    o = F.col("o_orderkey")
    px = views.table(spark, sf, "orders").select(
        o.alias("px"),
        F.pmod(o, F.lit(1200)).cast("double").alias("u"),
        F.pmod(o * 31, F.lit(680)).cast("double").alias("v"),
        (F.col("o_totalprice") / 10000.0).alias("depth"),
    )
    point = G.back_project(G.pixel_ray(F.col("u"), F.col("v"), 600.0, 600.0, 599.5, 339.5), F.col("depth"))
    half = G.pixel_ray(F.col("u"), F.col("v"), *G.scale_intrinsics(600.0, 600.0, 599.5, 339.5, 1200, 680, 600, 340))
    return px.select("px", *[r6(c).alias(a) for a, c in zip("xyz", point)], r6(half[0]).alias("half_x"))


@query(
    "lidar_range_p6",
    f"WITH {PTS_K} SELECT pt_id, {r6_sql('sqrt(x*x + y*y + z*z)')} AS r, {r6_sql('x / sqrt(x*x + y*y + z*z)')} AS dx, {r6_sql('z / sqrt(x*x + y*y + z*z)')} AS dz FROM pts_k",
)
def lidar_range(spark, sf):
    r, d = G.range_and_direction(G.vec("x", "y", "z"))
    return views.pts_k(spark, sf).select("pt_id", r6(r).alias("r"), r6(d[0]).alias("dx"), r6(d[2]).alias("dz"))


@query(
    "rays_to_world_p7",
    f"""WITH {CAMS}, {SEEN} SELECT pt_id, {r6_sql('tx')} AS ox, {r6_sql('tz')} AS oz, {r6_sql('r00*x + r01*y + r02*z')} AS dx,
    {r6_sql('r20*x + r21*y + r22*z')} AS dz FROM seen JOIN cams USING (frame_id)""",
)
def rays_to_world(spark, sf):
    joined = frames.join_poses(seen_points(spark, sf), cams(spark, sf), ("frame_id",))
    o, d = G.ray_to_world(F.col("pose"), G.vec("x", "y", "z"))
    return joined.select("pt_id", r6(o[0]).alias("ox"), r6(o[2]).alias("oz"), r6(d[0]).alias("dx"), r6(d[2]).alias("dz"))


# A box whose frame is a quarter turn about x followed by one about z; its most vertical axis is y.
BOX_AXES = ((0.0, 0.0, 1.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0))
BOX_CENTRE = (20.0, 25.0, 5.0)


@query(
    "canonical_points_p8_p9",
    f"""WITH {PTS_K} SELECT pt_id, {r6_sql('x - 20.0::DOUBLE')} AS x, {r6_sql('y - 25.0::DOUBLE')} AS y, {r6_sql('z - 5.0::DOUBLE')} AS z,
    {r6_sql('x')} AS bx, {r6_sql('y')} AS by, {r6_sql('z')} AS bz FROM pts_k""",
)
def canonical_points(spark, sf):
    # The most vertical box axis is turned to +z, so this box frame ends up parallel to the world axes in z.
    turn = G.up_axis_rotation(BOX_AXES)
    moved = G.canonical_points(G.vec("x", "y", "z"), turn, BOX_CENTRE)
    p = views.pts_k(spark, sf).select("pt_id", *[c.alias(f"c{a}") for a, c in zip("xyz", moved)])
    back = G.restore_points(G.vec("cx", "cy", "cz"), turn, BOX_CENTRE)
    world_axes = G.canonical_points(back, ((1, 0, 0), (0, 1, 0), (0, 0, 1)), BOX_CENTRE)
    return p.select("pt_id", *[r6(c).alias(a) for a, c in zip("xyz", world_axes)], *[r6(c).alias(f"b{a}") for a, c in zip("xyz", back)])


@query(
    "offset_points_p20",
    f"""WITH {PTS_K}, o(axis, side) AS (VALUES (0,1),(0,-1),(1,1),(1,-1),(2,1),(2,-1)) SELECT pt_id, axis, side,
    {r6_sql('x + CASE WHEN axis = 0 THEN side * 0.01::DOUBLE ELSE 0.0::DOUBLE END')} AS x, {r6_sql('y + CASE WHEN axis = 1 THEN side * 0.01::DOUBLE ELSE 0.0::DOUBLE END')} AS y,
    {r6_sql('z + CASE WHEN axis = 2 THEN side * 0.01::DOUBLE ELSE 0.0::DOUBLE END')} AS z FROM pts_k, o""",
)
def offset_points(spark, sf):
    out = G.offset_points(views.pts_k(spark, sf).select("pt_id", "x", "y", "z"), 0.01)
    return out.select("pt_id", "axis", "side", *[r6(F.col(a)).alias(a) for a in "xyz"])


@query(
    "gradient_angle_p21_p22",
    f"""WITH {PTS_K}, g AS (SELECT pt_id, x, y, z, y AS a, z AS b, x AS c, sqrt(x*x + y*y + z*z) AS n FROM pts_k)
    SELECT pt_id, {r6_sql('CASE WHEN n = 0 THEN x ELSE x / n END')} AS nx,
    {r6_sql('acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (x*a + y*b + z*c) / ((n + 1e-8::DOUBLE) * (n + 1e-8::DOUBLE)))))')} AS angle FROM g""",
)
def gradient_angle(spark, sf):
    p = views.pts_k(spark, sf)
    unit = G.normalised(G.vec("x", "y", "z"))
    return p.select("pt_id", r6(unit[0]).alias("nx"), r6(G.gradient_angle(G.vec("x", "y", "z"), G.vec("y", "z", "x"))).alias("angle"))


@query(
    "clip_error_p24_p25",
    f"""WITH {PTS_K} SELECT pt_id, {r6_sql('(greatest(10.0::DOUBLE, least(40.0::DOUBLE, x)) - 10.0::DOUBLE) / 30.0::DOUBLE')} AS shade,
    {r6_sql('greatest(-0.5::DOUBLE, least(0.5::DOUBLE, x / 50.0::DOUBLE - y / 50.0::DOUBLE))')} AS err FROM pts_k""",
)
def clip_error(spark, sf):
    return views.pts_k(spark, sf).select(
        "pt_id",
        r6(G.clip_normalise(F.col("x"), 10.0, 40.0)).alias("shade"),
        r6(G.signed_error(F.col("x") / 50.0, F.col("y") / 50.0)).alias("err"),
    )


def _scene_poses(spark, sf):
    """One pose per customer, numbered 0, 1, 2... within the single scene 0."""
    c = cams(spark, sf).withColumn("scene", F.lit(0))
    return frames.number_frames(c, ("scene",)).withColumn("frame_id", F.col("seq")).drop("seq")


@query(
    "augment_views_p23",
    f"""WITH {CAMS}, n AS (SELECT *, row_number() OVER (ORDER BY frame_id) - 1 AS f FROM cams)
    SELECT f AS source, 0 AS view, f + (f // 5) * 6 AS frame_id, {r6_sql('r00')} AS r00, {r6_sql('r11')} AS r11, {r6_sql('r22')} AS r22 FROM n
    UNION ALL
    SELECT f, w.k, f + (f // 5) * 6 + w.k, {r6_sql('r00')}, {r6_sql('r11 * cos(w.a) - r12 * sin(w.a)')}, {r6_sql('r21 * sin(w.a) + r22 * cos(w.a)')}
    FROM n, (VALUES (1, -0.24::DOUBLE), (2, -0.48::DOUBLE), (3, -0.24::DOUBLE), (4, 0.0::DOUBLE), (5, 0.24::DOUBLE), (6, 0.0::DOUBLE)) w(k, a) WHERE (f + 1) % 5 = 0""",
)
def augment_views(spark, sf):
    out = frames.augment_views(_scene_poses(spark, sf), 5, 5, 1.2)
    cell = lambda i, j: r6(G.pose_at(F.col("pose"), i, j))
    return out.select("source", "view", "frame_id", cell(0, 0).alias("r00"), cell(1, 1).alias("r11"), cell(2, 2).alias("r22"))


# -- filters -------------------------------------------------------------------------------------


@query(
    "depth_filter_f1",
    f"""WITH {RAYS} SELECT 'depth_file' AS mode, count(*) AS n, {r6_sql('sum(depth)')} AS total FROM rays WHERE depth > 0 AND depth >= 2.0 AND depth <= 30.0
    UNION ALL SELECT 'lidar_file', count(*), {r6_sql('sum(depth)')} FROM rays WHERE depth >= 2.0
    UNION ALL SELECT 'depth_stream', count(*), {r6_sql('sum(depth)')} FROM rays WHERE depth > 2.0 AND depth < 30.0
    UNION ALL SELECT 'lidar_stream', count(*), {r6_sql('sum(depth)')} FROM rays
    UNION ALL SELECT 'valid_rays_f7', count(*), {r6_sql('sum(depth)')} FROM rays WHERE depth > 2.5 AND depth < 30.0""",
)
def depth_filter(spark, sf):
    rays = views.rays(spark, sf)
    parts = {
        "depth_file": filters.depth_range(rays, "depth_file", 2.0, 30.0),
        "lidar_file": filters.depth_range(rays, "lidar_file", 2.0, 0.0),
        "depth_stream": filters.depth_range(rays, "depth_stream", 2.0, 30.0),
        "lidar_stream": filters.depth_range(rays, "lidar_stream", 2.0, 30.0),
        "valid_rays_f7": filters.valid_rays(rays, 2.0, 30.0, 0.5),
    }
    out = None
    for mode, df in parts.items():
        row = df.agg(F.count("*").alias("n"), r6(F.sum("depth")).alias("total")).select(F.lit(mode).alias("mode"), "n", "total")
        out = row if out is None else out.unionByName(row)
    return out


@query("finite_pose_f2_f6", f"WITH {CAMS} SELECT frame_id FROM cams WHERE frame_id % 10 <> 3 AND tx BETWEEN 0 AND 5 AND ty BETWEEN 0 AND 20 AND tz BETWEEN 0 AND 4")
def finite_pose(spark, sf):
    bad = F.when(F.pmod(F.col("frame_id"), F.lit(10)) == 3, F.transform(F.col("pose"), lambda v: v / F.lit(float("nan"))))
    broken = cams(spark, sf).withColumn("pose", F.coalesce(bad, F.col("pose")))
    return filters.sensor_inside(filters.finite_poses(broken), (0, 0, 0), (5, 20, 4)).select("frame_id")


@query(
    "crop_box_f3_f5",
    f"""WITH {PTS_K} SELECT pt_id, 'axis' AS box FROM pts_k WHERE x BETWEEN 5 AND 20 AND y BETWEEN 10 AND 40 AND z BETWEEN 1 AND 8
    UNION ALL SELECT pt_id, 'turned' FROM pts_k WHERE abs((x - 20) * cos(0.5::DOUBLE) + (y - 25) * sin(0.5::DOUBLE)) <= 8
    AND abs(-(x - 20) * sin(0.5::DOUBLE) + (y - 25) * cos(0.5::DOUBLE)) <= 5 AND abs(z - 5) <= 3""",
)
def crop_box(spark, sf):
    import math

    p = views.pts_k(spark, sf)
    turn = (math.cos(0.25), 0.0, 0.0, math.sin(0.25))
    a = filters.crop_box(p, (5, 10, 1), (20, 40, 8)).select("pt_id", F.lit("axis").alias("box"))
    b = filters.crop_oriented_box(p, (16, 10, 6), (20, 25, 5), turn).select("pt_id", F.lit("turned").alias("box"))
    return a.unionByName(b)


EXIT = "least(" + ", ".join(
    f"greatest(({lo}::DOUBLE - t{a}) / CASE WHEN abs(d{a}) >= 1e-8 THEN d{a} WHEN d{a} < 0 THEN -1e-8::DOUBLE ELSE 1e-8::DOUBLE END, "
    f"({hi}::DOUBLE - t{a}) / CASE WHEN abs(d{a}) >= 1e-8 THEN d{a} WHEN d{a} < 0 THEN -1e-8::DOUBLE ELSE 1e-8::DOUBLE END)"
    for a, lo, hi in (("x", -2, 20), ("y", -1, 50), ("z", -1, 9))
) + ")"


@query(
    "clamp_to_box_f4",
    f"""WITH {WORLD}, w AS (SELECT pt_id, x, y, z, tx, ty, tz, x - tx AS dx, y - ty AS dy, z - tz AS dz FROM world),
    e AS (SELECT *, x BETWEEN -2 AND 20 AND y BETWEEN -1 AND 50 AND z BETWEEN -1 AND 9 AS inside, {EXIT} * 0.9999::DOUBLE AS t FROM w)
    SELECT pt_id, {r6_sql('CASE WHEN inside THEN x ELSE tx + t * dx END')} AS x, {r6_sql('CASE WHEN inside THEN y ELSE ty + t * dy END')} AS y,
    {r6_sql('CASE WHEN inside THEN z ELSE tz + t * dz END')} AS z FROM e""",
)
def clamp_to_box(spark, sf):
    joined = frames.join_poses(seen_points(spark, sf), cams(spark, sf), ("frame_id",))
    pose = F.col("pose")
    p = joined.select("pt_id", *[c.alias(a) for a, c in zip("xyz", G.to_world(pose, G.vec("x", "y", "z")))], *[c.alias(f"t{a}") for a, c in zip("xyz", G.translation(pose))])
    out = G.clamp_to_box(G.vec("tx", "ty", "tz"), G.vec("x", "y", "z"), (-2, -1, -1), (20, 50, 9))
    return p.select("pt_id", *[r6(c).alias(a) for a, c in zip("xyz", out)])


# -- time joins ----------------------------------------------------------------------------------


@query(
    "asof_nearest_j2",
    f"""WITH {SCANS}, c AS (SELECT s.scan_id, p.pose_id, p.t - s.t AS dt, row_number() OVER (PARTITION BY s.scan_id ORDER BY abs(p.t - s.t), p.t, p.pose_id) AS rn
    FROM scans s JOIN poses p USING (key) WHERE abs(p.t - s.t) <= {8 * HOUR}) SELECT scan_id, pose_id, dt FROM c WHERE rn = 1""",
)
def asof_nearest(spark, sf):
    out = asof.asof_nearest(views.scans(spark, sf), views.poses(spark, sf), ["key"], "t", ("pose_id",), 8 * HOUR)
    return out.select("scan_id", "pose_id", "dt")


@query(
    "asof_latest_j3",
    f"""WITH {SCANS}, c AS (SELECT s.scan_id, p.pose_id, p.t - s.t AS dt, row_number() OVER (PARTITION BY s.scan_id ORDER BY p.t DESC, p.pose_id) AS rn
    FROM scans s JOIN poses p USING (key) WHERE p.t <= s.t AND s.t - p.t <= {24 * HOUR}) SELECT scan_id, pose_id, dt FROM c WHERE rn = 1""",
)
def asof_latest(spark, sf):
    out = asof.asof_latest(views.scans(spark, sf), views.poses(spark, sf), ["key"], "t", ("pose_id",), 24 * HOUR)
    return out.select("scan_id", "pose_id", "dt")


def _sync_sql(rounds: int) -> str:
    ctes = [
        SCANS,
        f"""c0 AS (SELECT key, scan_id, pose_id, s.t AS st, p.t AS pt, abs(p.t - s.t) AS gap FROM scans s JOIN poses p USING (key) WHERE abs(p.t - s.t) <= {6 * HOUR})""",
    ]
    for r in range(rounds):
        ctes.append(
            f"""b{r} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY gap, st, pt) AS rs,
            row_number() OVER (PARTITION BY pose_id ORDER BY gap, st, pt) AS rp FROM c{r}) WHERE rs = 1 AND rp = 1)"""
        )
        ctes.append(
            f"c{r + 1} AS (SELECT * FROM c{r} WHERE scan_id NOT IN (SELECT scan_id FROM b{r}) AND pose_id NOT IN (SELECT pose_id FROM b{r}))"
        )
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(f"SELECT key, scan_id, pose_id, gap FROM b{r}" for r in range(rounds))


@query("interval_sync_j4_j5", _sync_sql(5))
def interval_sync(spark, sf):
    return asof.pair_once(views.scans(spark, sf), views.poses(spark, sf), ["key"], 6 * HOUR, "scan_id", "pose_id")


@query(
    "transform_lookup_j6",
    f"""WITH {SCANS}, a AS (SELECT s.key, s.scan_id, s.t, max(p.t) FILTER (p.t <= s.t) AS t0, min(p.t) FILTER (p.t >= s.t) AS t1 FROM scans s JOIN poses p USING (key) GROUP BY ALL),
    b AS (SELECT a.*, p.value AS v0, q.value AS v1, CASE WHEN t1 = t0 THEN 0.0::DOUBLE ELSE (a.t - t0)::DOUBLE / (t1 - t0)::DOUBLE END AS f FROM a JOIN poses p ON p.key = a.key AND p.t = t0 JOIN poses q ON q.key = a.key AND q.t = t1)
    SELECT scan_id, {r6_sql('v0 + f * (v1 - v0)')} AS x, {r6_sql('sin((v0 + f * (v1 - v0)) / 1000.0::DOUBLE)')} AS qz FROM b""",
)
def transform_lookup(spark, sf):
    # A body that moves along x and turns about z by an angle proportional to x: slerp keeps that relation.
    half = F.col("value") / 1000.0
    p = views.poses(spark, sf).select(
        "key", "t", F.col("value").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"),
    )
    near = asof.asof_bracket(views.scans(spark, sf), p, ["key"], "t", ("x", "y", "z", "qx", "qy", "qz", "qw"))
    return asof.lerp_transform(near).select("scan_id", r6(F.col("x")).alias("x"), r6(F.col("qz")).alias("qz"))


#: Per user a body (clicks) on a cart (errors) in the world, and a fixed sensor on the body; sensors are asked for at views, seen from the world or from the
#: next user's cart. All turns are about z, by 0.4 of a radian times the message number modulo 7.
CHAIN = """m AS (SELECT user_id AS u, event_type AS k, epoch_us(ts) AS t, event_id AS id, value AS x, (event_id % 13)::DOUBLE AS y, 0.4::DOUBLE * (event_id % 7) AS a FROM events),
    r AS (SELECT event_id AS id, user_id AS u, epoch_us(ts) AS t, CASE WHEN event_id % 2 = 1 THEN (user_id + 1) % 150 END AS o FROM events WHERE event_type = 'view'),
    asked AS (SELECT id, t, 'click' AS k, u FROM r UNION ALL SELECT id, t, 'error', u FROM r UNION ALL SELECT id, t, 'other', o FROM r WHERE o IS NOT NULL),
    w AS (SELECT q.id, q.k, q.t, p.t AS t0, p.x AS x0, p.y AS y0, p.a AS a0 FROM asked q ASOF JOIN m p ON p.u = q.u AND p.k = CASE WHEN q.k = 'click' THEN 'click' ELSE 'error' END AND q.t >= p.t),
    v AS (SELECT q.id, q.k, n.t AS t1, n.x AS x1, n.y AS y1, n.a AS a1 FROM asked q ASOF JOIN m n ON n.u = q.u AND n.k = CASE WHEN q.k = 'click' THEN 'click' ELSE 'error' END AND q.t <= n.t),
    e AS (SELECT id, k, x0 + f * (x1 - x0) AS x, y0 + f * (y1 - y0) AS y, a0 + f * (a1 - a0) AS a FROM (SELECT *, CASE WHEN t1 = t0 THEN 0.0::DOUBLE ELSE (t - t0)::DOUBLE / (t1 - t0)::DOUBLE END AS f FROM w JOIN v USING (id, k))),
    s AS (SELECT r.id, r.o, c.x + cos(c.a) * (b.x + cos(b.a) * 0.5 + 0.0) - sin(c.a) * (b.y + sin(b.a) * 0.5) AS x, c.y + sin(c.a) * (b.x + cos(b.a) * 0.5) + cos(c.a) * (b.y + sin(b.a) * 0.5) AS y, c.a + b.a + 0.25 AS a
      FROM r JOIN e b ON b.id = r.id AND b.k = 'click' JOIN e c ON c.id = r.id AND c.k = 'error')"""


@query(
    "transform_chain_j6",
    f"""WITH {CHAIN}, z AS (SELECT s.id, CASE WHEN s.o IS NULL THEN s.x ELSE cos(e.a) * (s.x - e.x) + sin(e.a) * (s.y - e.y) END AS x,
      CASE WHEN s.o IS NULL THEN s.y ELSE -sin(e.a) * (s.x - e.x) + cos(e.a) * (s.y - e.y) END AS y, CASE WHEN s.o IS NULL THEN s.a ELSE s.a - e.a END AS a, s.o, e.id AS found
      FROM s LEFT JOIN e ON e.id = s.id AND e.k = 'other')
    SELECT id, {r6_sql('x')} AS x, {r6_sql('y')} AS y, {r6_sql('sin(a)')} AS turn FROM z WHERE o IS NULL OR found IS NOT NULL""",
)
def transform_chain(spark, sf):
    ev = views.table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", views.micros("ts").alias("t"))
    half = F.pmod("event_id", F.lit(7)) * 0.2
    name = lambda kind, user: F.concat(F.lit(f"{kind}_"), user.cast("string"))
    user, moves = F.col("user_id"), ev.where(F.col("event_type").isin("click", "error"))
    body = F.col("event_type") == "click"
    edges = moves.select(
        F.when(body, name("cart", user)).otherwise(F.lit("world")).alias("parent"), F.when(body, name("body", user)).otherwise(name("cart", user)).alias("child"), "t",
        F.col("value").alias("x"), F.pmod("event_id", F.lit(13)).cast("double").alias("y"), F.lit(0.0).alias("z"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.sin(half).alias("qz"), F.cos(half).alias("qw"),
    )
    fixed = moves.select(user).distinct().select(
        name("body", user).alias("parent"), name("sensor", user).alias("child"), F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"),
        F.lit(0.0).alias("qx"), F.lit(0.0).alias("qy"), F.lit(math.sin(0.125)).alias("qz"), F.lit(math.cos(0.125)).alias("qw"),
    )
    target = F.when(F.pmod("event_id", F.lit(2)) == 1, name("cart", F.pmod(user + 1, F.lit(150)))).otherwise(F.lit("world"))
    asked = ev.where("event_type = 'view'").select(F.col("event_id").alias("id"), name("sensor", user).alias("source"), target.alias("target"), "t")
    out = transforms.chain_transforms(asked, edges, fixed)
    return out.select("id", *[r6(F.get("pose", i)).alias(n) for n, i in (("x", 3), ("y", 7), ("turn", 4))])


# -- bounds, trajectories ------------------------------------------------------------------------


@query(
    "bounds_a2",
    f"""WITH {PTS} SELECT scene, frame_id, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z
    FROM pts GROUP BY ROLLUP (scene, frame_id)""",
)
def bounds(spark, sf):
    return frames.bounds(views.pts(spark, sf))


@query(
    "traj_length_w3",
    f"""WITH {TRAJ}, l AS (SELECT scene, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS d
    FROM traj WINDOW w AS (PARTITION BY scene ORDER BY frame_id)) SELECT scene, {r6_sql('sum(d)')} AS length, count(d) AS n_segments FROM l WHERE d IS NOT NULL GROUP BY scene""",
)
def traj_length(spark, sf):
    out = frames.trajectory_length(views.traj(spark, sf))
    return out.select("scene", r6(F.col("length")).alias("length"), "n_segments")


@query("frame_numbers_w5", f"WITH {TRAJ} SELECT scene, frame_id, row_number() OVER (PARTITION BY scene ORDER BY frame_id) - 1 AS seq FROM traj")
def frame_numbers(spark, sf):
    return frames.number_frames(views.traj(spark, sf).select("scene", "frame_id"))


@query("stride_t6", f"WITH {PTS_K} SELECT pt_id, {r6_sql('x')} AS x FROM pts_k WHERE pt_id % 100 = 0")
def stride(spark, sf):
    return frames.stride(views.pts_k(spark, sf)).select("pt_id", r6(F.col("x")).alias("x"))


# -- shapes --------------------------------------------------------------------------------------

SHAPES = """s AS (SELECT o_orderkey AS id, o_totalprice / 10000.0::DOUBLE AS px, (o_orderkey % 50)::DOUBLE AS py, (o_custkey % 9)::DOUBLE AS pz,
  (o_custkey % 37)::DOUBLE AS ax, (o_orderkey % 41)::DOUBLE AS ay, (o_orderkey % 5)::DOUBLE AS az,
  (o_orderkey % 53)::DOUBLE AS hx, (o_custkey % 47)::DOUBLE AS hy, (o_orderkey % 11)::DOUBLE AS hz FROM orders)"""


def shapes(spark, sf):
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    m = lambda k, n: F.pmod(k, F.lit(n)).cast("double")
    return views.table(spark, sf, "orders").select(
        o.alias("id"), (F.col("o_totalprice") / 10000.0).alias("px"), m(o, 50).alias("py"), m(c, 9).alias("pz"),
        m(c, 37).alias("ax"), m(o, 41).alias("ay"), m(o, 5).alias("az"), m(o, 53).alias("hx"), m(c, 47).alias("hy"), m(o, 11).alias("hz"),
    )


SEG = """CASE WHEN dd = 0 THEN sqrt((px-ax)*(px-ax) + (py-ay)*(py-ay)) ELSE sqrt(
  (px - ax - greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px-ax)*(hx-ax) + (py-ay)*(hy-ay)) / dd)) * (hx-ax)) * (px - ax - greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px-ax)*(hx-ax) + (py-ay)*(hy-ay)) / dd)) * (hx-ax)) +
  (py - ay - greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px-ax)*(hx-ax) + (py-ay)*(hy-ay)) / dd)) * (hy-ay)) * (py - ay - greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((px-ax)*(hx-ax) + (py-ay)*(hy-ay)) / dd)) * (hy-ay))) END"""


@query("point_segment_j18", f"WITH {SHAPES}, t AS (SELECT *, (hx-ax)*(hx-ax) + (hy-ay)*(hy-ay) AS dd FROM s) SELECT id, {r6_sql(SEG)} AS dist FROM t")
def point_segment(spark, sf):
    s = shapes(spark, sf)
    return s.select("id", r6(S.point_segment_distance(G.vec("px", "py"), G.vec("ax", "ay"), G.vec("hx", "hy"))).alias("dist"))


@query(
    "line_line_j18",
    f"""WITH {SHAPES}, t AS (SELECT id, px, py, ax, ay, hx - ax AS vx, hy - ay AS vy, 3.0::DOUBLE AS ux, 2.0::DOUBLE AS uy FROM s),
    d AS (SELECT *, ux * vy - uy * vx AS det FROM t)
    SELECT id, CASE WHEN abs(det) > 1e-9 THEN {r6_sql('((ax - px) * vy - (ay - py) * vx) / det')} END AS lam1,
    CASE WHEN abs(det) > 1e-9 THEN {r6_sql('((ax - px) * uy - (ay - py) * ux) / det')} END AS lam2 FROM d""",
)
def line_line(spark, sf):
    s = shapes(spark, sf)
    p1 = [F.col("px") + 3.0, F.col("py") + 2.0]
    a, b = S.line_line_2d(G.vec("px", "py"), p1, G.vec("ax", "ay"), G.vec("hx", "hy"))
    # Parallel to within rounding counts as parallel here.
    meet = F.abs(S.cross2((F.lit(3.0), F.lit(2.0)), G.sub(G.vec("hx", "hy"), G.vec("ax", "ay")))) > 1e-9
    return s.select("id", F.when(meet, r6(a)).alias("lam1"), F.when(meet, r6(b)).alias("lam2"))


@query(
    "line_line_3d_j18",
    f"""WITH {SHAPES}, t AS (SELECT id, hx - ax AS vx, hy - ay AS vy, hz - az AS vz, ax - px AS wx, ay - py AS wy, az - pz AS wz FROM s),
    c AS (SELECT *, (2*vz - 3*vy) AS cx, (3*vx - 1*vz) AS cy, (1*vy - 2*vx) AS cz FROM t)
    SELECT id, CASE WHEN cx*cx + cy*cy + cz*cz > 0 THEN {r6_sql('abs(wx*cx + wy*cy + wz*cz) / sqrt(cx*cx + cy*cy + cz*cz)')} END AS gap FROM c""",
)
def line_line_3d(spark, sf):
    s = shapes(spark, sf)
    p1 = [F.col("px") + 1.0, F.col("py") + 2.0, F.col("pz") + 3.0]
    _, _, gap = S.line_line_3d(G.vec("px", "py", "pz"), p1, G.vec("ax", "ay", "az"), G.vec("hx", "hy", "hz"))
    # Parallel lines have no gap of their own; in floating point the last bit would decide.
    return s.select("id", (r6(gap) * F.when(F.expr("hy - ay <> 2 * (hx - ax) OR hz - az <> 3 * (hx - ax)"), 1.0)).alias("gap"))


@query(
    "ray_line_j18",
    f"""WITH {SHAPES}, t AS (SELECT *, (hx-ax) * 0.8::DOUBLE - (hy-ay) * 0.6::DOUBLE AS det FROM s)
    SELECT id, CASE WHEN abs(det) > 1e-9 THEN {r6_sql('((hx-px) * 0.8::DOUBLE - (hy-py) * 0.6::DOUBLE) / det')} END AS lam,
    CASE WHEN abs(det) > 1e-9 THEN {r6_sql('((hx-ax) * (hy-py) - (hy-ay) * (hx-px)) / det')} END AS dist FROM t""",
)
def ray_line(spark, sf):
    s = shapes(spark, sf)
    # Parallel to within rounding counts as parallel here.
    meet = F.abs((F.col("hx") - F.col("ax")) * 0.8 - (F.col("hy") - F.col("ay")) * 0.6) > 1e-9
    lam, dist = S.ray_line_2d(G.vec("px", "py"), [F.lit(0.6), F.lit(0.8)], G.vec("ax", "ay"), G.vec("hx", "hy"))
    return s.select("id", F.when(meet, r6(lam)).alias("lam"), F.when(meet, r6(dist)).alias("dist"))


@query(
    "line_ellipse_j18",
    f"""WITH {SHAPES}, t AS (SELECT id, (px - 20) / 15.0::DOUBLE AS ax, (py - 25) / 10.0::DOUBLE AS ay, (pz - 4) / 5.0::DOUBLE AS az, (hx - px) / 15.0::DOUBLE AS dx, (hy - py) / 10.0::DOUBLE AS dy, (hz - pz) / 5.0::DOUBLE AS dz FROM s),
    q AS (SELECT id, dx*dx + dy*dy AS a2, ax*dx + ay*dy AS b2, ax*ax + ay*ay - 1 AS c2, dx*dx + dy*dy + dz*dz AS a3, ax*dx + ay*dy + az*dz AS b3, ax*ax + ay*ay + az*az - 1 AS c3 FROM t)
    SELECT id, CASE WHEN b2*b2 - a2*c2 > 1e-9 THEN {r6_sql('(-b2 - sqrt(greatest(b2*b2 - a2*c2, 0))) / a2')} END AS near2,
    CASE WHEN b3*b3 - a3*c3 > 1e-9 THEN {r6_sql('(-b3 + sqrt(greatest(b3*b3 - a3*c3, 0))) / a3')} END AS far3 FROM q""",
)
def line_ellipse(spark, sf):
    s = shapes(spark, sf)
    p = [F.col("px") - 20.0, F.col("py") - 25.0, F.col("pz") - 4.0]
    e = [F.col("hx") - 20.0, F.col("hy") - 25.0, F.col("hz") - 4.0]
    r = [F.lit(15.0), F.lit(10.0), F.lit(5.0)]
    # A line that only touches, to within rounding, counts as a miss here: the last bit would decide.
    cuts = []
    for n in (2, 3):
        a, d = [G.safe_div(c, k) for c, k in zip(p[:n], r[:n])], [G.safe_div(h - c, k) for c, h, k in zip(p[:n], e[:n], r[:n])]
        cuts.append(G.dot(a, d) * G.dot(a, d) - G.dot(d, d) * (G.dot(a, a) - 1.0) > 1e-9)
    near2, _ = S.line_ellipsoid(p[:2], e[:2], r[:2])
    _, far3 = S.line_ellipsoid(p, e, r)
    return s.select("id", F.when(cuts[0], r6(near2)).alias("near2"), F.when(cuts[1], r6(far3)).alias("far3"))


@query(
    "ray_box_j18",
    f"""WITH {SHAPES}, t AS (SELECT id, px, py, (10.0::DOUBLE - px) / 0.6::DOUBLE AS x1, (20.0::DOUBLE - px) / 0.6::DOUBLE AS x2, (15.0::DOUBLE - py) / 0.8::DOUBLE AS y1, (30.0::DOUBLE - py) / 0.8::DOUBLE AS y2 FROM s),
    m AS (SELECT *, greatest(least(x1, x2), least(y1, y2)) AS tn, least(greatest(x1, x2), greatest(y1, y2)) AS tx, px BETWEEN 10 AND 20 AND py BETWEEN 15 AND 30 AS inside FROM t)
    SELECT id, tx >= tn AS hit, inside, CASE WHEN tx >= tn THEN {r6_sql('CASE WHEN NOT inside AND tn >= 0 THEN tn ELSE tx END')} END AS d1 FROM m""",
)
def ray_box(spark, sf):
    s = shapes(spark, sf)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    d1, _, hit, inside = S.ray_box(G.vec("px", "py"), lit(0.6, 0.8), lit(10, 15), lit(20, 30))
    return s.select("id", hit.alias("hit"), inside.alias("inside"), r6(d1).alias("d1"))
