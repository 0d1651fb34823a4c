"""Driver queries for key frames, sampling, sets, rays and occupancy."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxfield.functions.hashing import hash32_sql, uniform_sql
from voxfield.operators import keyframes as KF
from voxfield.operators import rays as R
from voxfield.operators import sampling as SA
from voxfield.operators import voxelmap as V
from voxfield.plans import incremental, views
from voxfield.plans.mapping import MapConfig
from voxfield.plans.registry import query
from voxfield.plans.views import DEPTH, KEYED, PTS, PTS_K, RAYS, RES, TRAJ, code_sql, r6, r6_sql
from voxfield.session import cut

# -- frame voxel sets on a coarse grid so that frames overlap -------------------------------------

COARSE = 8.0


def frame_voxels(spark, sf):
    occ = V.occupied_voxels(views.pts(spark, sf), COARSE, 6, 0, ("scene", "frame_id"))
    return occ.select("scene", "frame_id", "node")


FV = f"""{PTS}, ck AS (SELECT scene, frame_id, floor(x / 8.0::DOUBLE)::BIGINT + 32 AS kx, floor(y / 8.0::DOUBLE)::BIGINT + 32 AS ky, floor(z / 8.0::DOUBLE)::BIGINT + 32 AS kz FROM pts),
fv AS (SELECT DISTINCT scene, frame_id, {code_sql(depth=6)} AS node FROM ck)"""


@query("seen_counts_a5", f"WITH {FV} SELECT scene, frame_id, count(*) AS n FROM fv GROUP BY ALL")
def seen_counts(spark, sf):
    return KF.seen_counts(frame_voxels(spark, sf))


@query(
    "frame_iou_a6",
    f"""WITH {FV}, p AS (SELECT DISTINCT scene, frame_id AS f1, frame_id + 1 AS f2 FROM fv WHERE (scene, frame_id + 1) IN (SELECT (scene, frame_id) FROM fv)),
    n AS (SELECT scene, frame_id, count(*) AS n FROM fv GROUP BY ALL),
    c AS (SELECT a.scene, a.frame_id AS f1, count(*) AS c FROM fv a JOIN fv b ON a.scene = b.scene AND b.frame_id = a.frame_id + 1 AND a.node = b.node GROUP BY ALL)
    SELECT p.scene, f1, f2, coalesce(c, 0) AS common, {r6_sql('coalesce(c, 0)::DOUBLE / (a.n + b.n - coalesce(c, 0))')} AS iou FROM p LEFT JOIN c USING (scene, f1)
    JOIN n a ON a.scene = p.scene AND a.frame_id = f1 JOIN n b ON b.scene = p.scene AND b.frame_id = f2""",
)
def frame_iou(spark, sf):
    fv = frame_voxels(spark, sf)
    ids = fv.select("scene", "frame_id").distinct()
    pairs = ids.select("scene", F.col("frame_id").alias("f1"), (F.col("frame_id") + 1).alias("f2"))
    pairs = pairs.join(ids.withColumnRenamed("frame_id", "f2"), ["scene", "f2"], "left_semi")
    out = KF.pair_iou(pairs, fv)
    return out.select("scene", "f1", "f2", F.col("common").cast("bigint").alias("common"), r6(F.col("iou")).alias("iou"))


@query(
    "coverage_gain_a7",
    f"""WITH {FV} SELECT scene, frame_id, count(*) AS n FROM fv WHERE node NOT IN (SELECT node FROM fv WHERE scene = 'A' AND frame_id = 1) GROUP BY ALL""",
)
def coverage_gain(spark, sf):
    fv = frame_voxels(spark, sf)
    covered = fv.filter((F.col("scene") == "A") & (F.col("frame_id") == 1))
    return KF.coverage_gain(fv, KF.refill(fv.select("node").distinct(), covered))


@query(
    "keyframe_naive_w1",
    f"""WITH RECURSIVE {TRAJ}, k(scene, frame_id) AS (SELECT scene, min(frame_id) FROM traj GROUP BY scene
    UNION ALL SELECT k.scene, (SELECT min(t.frame_id) FROM traj t WHERE t.scene = k.scene AND t.frame_id >= k.frame_id + 700) FROM k WHERE k.frame_id IS NOT NULL)
    SELECT scene, frame_id FROM k WHERE frame_id IS NOT NULL""",
)
def keyframe_naive(spark, sf):
    return KF.interval_key_frames(views.traj(spark, sf), 700)


def _key_walk() -> str:
    """Walk from key frame to key frame: the next one is the first later frame that overlaps too little."""
    return f"""WITH RECURSIVE {FV}, n AS (SELECT scene, frame_id, count(*) AS n FROM fv GROUP BY ALL),
    c AS (SELECT a.scene, a.frame_id AS f, b.frame_id AS g, count(*) AS c FROM fv a JOIN fv b ON a.scene = b.scene AND a.node = b.node AND b.frame_id > a.frame_id GROUP BY ALL),
    i AS (SELECT a.scene, a.frame_id AS f, b.frame_id AS g, coalesce(c.c, 0)::DOUBLE / (a.n + b.n - coalesce(c.c, 0)) AS iou
      FROM n a JOIN n b ON a.scene = b.scene AND b.frame_id > a.frame_id LEFT JOIN c ON c.scene = a.scene AND c.f = a.frame_id AND c.g = b.frame_id),
    x AS (SELECT scene, f, min(g) AS g FROM i WHERE iou < 0.7::DOUBLE GROUP BY ALL),
    k(scene, frame_id) AS (SELECT scene, min(frame_id) FROM fv GROUP BY scene UNION ALL SELECT k.scene, x.g FROM k JOIN x ON x.scene = k.scene AND x.f = k.frame_id)
    SELECT scene, frame_id FROM k"""


@query(
    "incremental_map_l4",
    f"""WITH w AS ({_key_walk()}), {FV}, n AS (SELECT scene, frame_id, count(*) AS seen FROM fv GROUP BY ALL), v AS (SELECT scene, count(DISTINCT node) AS voxels FROM fv GROUP BY scene)
    SELECT scene, frame_id, seen, voxels FROM w JOIN n USING (scene, frame_id) JOIN v USING (scene)""",
)
def incremental_map(spark, sf):
    """Frames arrive in three batches, the second one twice; the state ends with the key frames and voxels of the whole run."""
    fv = cut(frame_voxels(spark, sf))
    cfg = MapConfig(res=RES, depth=DEPTH, insert_ratio=0.7)
    state, third = incremental.empty_state(spark), (fv.agg(F.max("frame_id")).first()[0] or 0) // 3 + 1
    for batch in (0, 1, 1, 2):
        rows = fv.where(F.floor(F.col("frame_id") / third) == batch)
        state, _ = incremental.insert(state, None, None, cfg, seen=rows)
    seen = state.key_voxels.groupBy("scene", "frame_id").agg(F.count("*").alias("seen"))
    voxels = state.voxels.groupBy("scene").agg(F.count("*").alias("voxels"))
    return state.keys.select("scene", "frame_id").join(seen, ["scene", "frame_id"]).join(voxels, "scene")


@query("keyframe_iou_w2", _key_walk())
def keyframe_iou(spark, sf):
    return KF.iou_key_frames(frame_voxels(spark, sf), 0.7)


def _cover_sql(steps: int) -> str:
    """The greedy picks, one CTE per step: u holds the uncovered voxels."""
    ctes = [FV, "f AS (SELECT DISTINCT frame_id, node FROM fv)", "u0 AS (SELECT DISTINCT node FROM f)"]
    for i in range(steps):
        ctes.append(
            f"g{i} AS MATERIALIZED (SELECT frame_id, count(*) AS gain FROM f WHERE node IN (SELECT node FROM u{i}) GROUP BY frame_id ORDER BY gain DESC, frame_id LIMIT 1)"
        )
        rest = f"SELECT node FROM u{i} WHERE node NOT IN (SELECT node FROM f WHERE frame_id = (SELECT frame_id FROM g{i}))"
        again = f"SELECT DISTINCT node FROM f WHERE node NOT IN (SELECT node FROM f WHERE frame_id = (SELECT frame_id FROM g{i}))"
        ctes.append(f"u{i + 1} AS MATERIALIZED (({rest}) UNION ALL (SELECT node FROM ({again}) WHERE NOT EXISTS ({rest})))")
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(f"SELECT {i} AS step, frame_id, gain FROM g{i}" for i in range(steps))


@query("greedy_cover_t4", _cover_sql(6))
def greedy_cover(spark, sf):
    return KF.greedy_cover(frame_voxels(spark, sf), 6)[0]


QUOTA = """s AS (SELECT o_custkey % 13 AS frame_id, count(*) % 97 AS samples FROM orders GROUP BY ALL)"""


def _selected(spark, sf):
    o = views.table(spark, sf, "orders").groupBy(F.pmod("o_custkey", F.lit(13)).alias("frame_id"))
    return o.agg(F.pmod(F.count("*"), F.lit(97)).alias("samples"))


@query(
    "quota_split_t5",
    f"""WITH {QUOTA}, r AS (SELECT *, row_number() OVER (ORDER BY frame_id) - 1 AS i, count(*) OVER () AS m, sum(samples) OVER () AS t FROM s),
    b AS (SELECT *, greatest(1, floor(20480 * (t - samples) / (t * (m - 1))::DOUBLE))::BIGINT AS base FROM r),
    d AS (SELECT *, 20480 - sum(base) OVER () AS off FROM b)
    SELECT frame_id, samples, (20480 // m + CASE WHEN i < 20480 % m THEN 1 ELSE 0 END)::BIGINT AS uniform,
    (CASE WHEN off >= 0 THEN base + off // m + CASE WHEN i < off % m THEN 1 ELSE 0 END
      ELSE greatest(1, base - (-off) // m - CASE WHEN i < (-off) % m THEN 1 ELSE 0 END) END)::BIGINT AS quota FROM d""",
)
def quota_split(spark, sf):
    s = _selected(spark, sf)
    even = SA.split_quota(s, 20480).withColumnRenamed("quota", "uniform")
    return even.join(SA.split_quota(s, 20480, inverse=True).select("frame_id", "quota"), "frame_id")


@query("initial_count_t5", f"WITH {QUOTA} SELECT (sum(samples) // (count(*) + 2))::BIGINT AS initial FROM s")
def initial_count(spark, sf):
    return SA.initial_count(_selected(spark, sf))


#: Number of the frame in the draws of its own points.
FRAME = f"(({hash32_sql('frame_id')}) & 2147483647)"


@query(
    "topk_sample_t1",
    f"""WITH {PTS_K}, h AS (SELECT pt_id, frame_id, {hash32_sql('pt_id', FRAME)} AS h FROM pts_k)
    SELECT frame_id, pt_id FROM h QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY h, pt_id) <= 20""",
)
def topk_sample(spark, sf):
    return SA.take_random(views.pts_k(spark, sf), 20, ("frame_id",)).select("frame_id", "pt_id")


@query(
    "ratio_sample_t1",
    f"""WITH {PTS_K}, h AS (SELECT pt_id, frame_id, {hash32_sql('pt_id', FRAME)} AS h FROM pts_k)
    SELECT frame_id, pt_id FROM h QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY h, pt_id) <= floor(count(*) OVER (PARTITION BY frame_id) * 0.25::DOUBLE)""",
)
def ratio_sample(spark, sf):
    return SA.take_random(views.pts_k(spark, sf), 0, ("frame_id",), ratio=0.25).select("frame_id", "pt_id")


@query(
    "frame_draws_t1",
    f"""WITH h AS (SELECT l_orderkey AS frame_id, l_linenumber::BIGINT AS pt_id FROM lineitem)
    SELECT frame_id, pt_id FROM h QUALIFY row_number() OVER (PARTITION BY frame_id ORDER BY {hash32_sql('pt_id', FRAME)}, pt_id) <= 2""",
)
def frame_draws(spark, sf):
    # Ids that begin anew in every frame.
    lines = views.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_id"), F.col("l_linenumber").cast("bigint").alias("pt_id"))
    return SA.take_random(lines, 2, ("frame_id",))


@query(
    "ray_draws_t2",
    f"""WITH {PTS_K}, h AS (SELECT pt_id, frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY {hash32_sql('pt_id', FRAME)}, pt_id) AS i FROM pts_k),
    n AS (SELECT frame_id, count(*) AS n FROM pts_k GROUP BY frame_id),
    d AS (SELECT frame_id, j, floor({uniform_sql(FRAME, 'j + 1')} * n)::BIGINT + 1 AS i FROM n, range(100) r(j))
    SELECT frame_id, j::INTEGER AS j, pt_id FROM d JOIN h USING (frame_id, i)""",
)
def ray_draws(spark, sf):
    return SA.draw_rays(views.pts_k(spark, sf).select("frame_id", "pt_id"), 100).select("frame_id", "j", "pt_id")


@query(
    "random_keyframes_t3",
    f"""WITH {PTS_K}, f AS (SELECT DISTINCT frame_id FROM pts_k) SELECT frame_id FROM f ORDER BY {hash32_sql('frame_id', 0, 7)}, frame_id LIMIT 10""",
)
def random_keyframes(spark, sf):
    frames = views.pts_k(spark, sf).select("frame_id").distinct()
    return SA.take_random(frames, 10, key="frame_id", seed=7)


@query("cloud_subset_t9", f"""WITH {PTS_K} SELECT pt_id FROM pts_k ORDER BY {hash32_sql('pt_id', 0, 3)}, pt_id LIMIT 5000""")
def cloud_subset(spark, sf):
    return SA.take_random(views.pts_k(spark, sf).select("pt_id"), 5000, seed=3)


@query(
    "farthest_points_t7",
    "WITH RECURSIVE " + PTS_K.replace("pts_k AS", "p0 AS") + """, c AS (SELECT min((pt_id, x, y, z)) AS p FROM p0 GROUP BY floor(x / 2.0), floor(y / 2.0), floor(z / 2.0)),
    p AS (SELECT p[1] AS pt_id, p[2] AS x, p[3] AS y, p[4] AS z FROM c),
    s0 AS MATERIALIZED (SELECT * FROM p ORDER BY pt_id LIMIT 1),
    """ + ",\n    ".join(
        f"s{i} AS MATERIALIZED (SELECT p.* FROM p ORDER BY least(" + ", ".join(
            f"(x - (SELECT x FROM s{j})) * (x - (SELECT x FROM s{j})) + (y - (SELECT y FROM s{j})) * (y - (SELECT y FROM s{j})) + (z - (SELECT z FROM s{j})) * (z - (SELECT z FROM s{j}))"
            for j in range(i)
        ) + ") DESC, pt_id LIMIT 1)" for i in range(1, 6)
    ) + " " + " UNION ALL ".join(f"SELECT {i}::INTEGER AS step, pt_id FROM s{i}" for i in range(6)),
)
def farthest_points(spark, sf):
    return SA.farthest_points(views.pts_k(spark, sf), 6, 2.0).select("step", "pt_id")


@query(
    "voxel_sets_u4_u3",
    f"""WITH {FV}, a AS (SELECT DISTINCT node FROM fv WHERE scene = 'A' AND frame_id = 1), b AS (SELECT DISTINCT node FROM fv WHERE scene = 'R' AND frame_id = 2)
    SELECT 'union' AS op, node FROM (SELECT node FROM a UNION SELECT node FROM b) UNION ALL SELECT 'both', node FROM a WHERE node IN (SELECT node FROM b)
    UNION ALL SELECT 'refill', node FROM (SELECT DISTINCT node FROM fv) WHERE node NOT IN (SELECT node FROM a)""",
)
def voxel_sets(spark, sf):
    fv = frame_voxels(spark, sf)
    a = fv.filter((F.col("scene") == "A") & (F.col("frame_id") == 1)).select("node").distinct()
    b = fv.filter((F.col("scene") == "R") & (F.col("frame_id") == 2)).select("node").distinct()
    tag = lambda op, df: df.select(F.lit(op).alias("op"), "node")
    everything = fv.select("node").distinct()
    return tag("union", KF.voxel_union(a, b)).unionByName(tag("both", KF.voxel_intersection(a, b))).unionByName(tag("refill", KF.refill(everything, a)))


@query(
    "with_current_u1",
    f"""WITH {PTS_K}, f AS (SELECT frame_id, count(*) AS n FROM pts_k GROUP BY ALL) SELECT * FROM f WHERE n > (SELECT avg(n) FROM f) OR frame_id IN (5, 6)""",
)
def with_current(spark, sf):
    f = views.pts_k(spark, sf).groupBy("frame_id").agg(F.count("*").alias("n"))
    mean = f.agg(F.avg("n").alias("_m"))
    selected = f.join(F.broadcast(mean), F.col("n") > F.col("_m")).drop("_m")
    return KF.with_current(selected, f.filter(F.col("frame_id").isin(5, 6)))


# -- rays ----------------------------------------------------------------------------------------

RAY_RES, RAY_DEPTH = 2.0, 8

# Every plane crossing of every ray, numbered along the ray; the key before crossing i is the i-th cell.
CROSS = f"""{RAYS}, e AS (SELECT *, ox + depth * dx AS ex, oy + depth * dy AS ey, oz + depth * dz AS ez FROM rays),
k AS (SELECT *, floor(ox / 2.0::DOUBLE)::BIGINT + 128 AS ax, floor(oy / 2.0::DOUBLE)::BIGINT + 128 AS ay, floor(oz / 2.0::DOUBLE)::BIGINT + 128 AS az,
  floor(ex / 2.0::DOUBLE)::BIGINT + 128 AS bx, floor(ey / 2.0::DOUBLE)::BIGINT + 128 AS by_, floor(ez / 2.0::DOUBLE)::BIGINT + 128 AS bz FROM e),
x AS (SELECT ray_id, frame_id, ax, ay, az, 0 AS axis, sign(bx - ax)::BIGINT AS s, ((CASE WHEN bx > ax THEN ax + 1 + m ELSE ax - m END - 128) * 2.0::DOUBLE - ox) / (ex - ox) AS t FROM k, range(60) r(m) WHERE m < abs(bx - ax)
  UNION ALL SELECT ray_id, frame_id, ax, ay, az, 1, sign(by_ - ay)::BIGINT, ((CASE WHEN by_ > ay THEN ay + 1 + m ELSE ay - m END - 128) * 2.0::DOUBLE - oy) / (ey - oy) FROM k, range(60) r(m) WHERE m < abs(by_ - ay)
  UNION ALL SELECT ray_id, frame_id, ax, ay, az, 2, sign(bz - az)::BIGINT, ((CASE WHEN bz > az THEN az + 1 + m ELSE az - m END - 128) * 2.0::DOUBLE - oz) / (ez - oz) FROM k, range(60) r(m) WHERE m < abs(bz - az)),
w AS (SELECT ray_id, frame_id, (row_number() OVER q - 1)::INTEGER AS pos, ax + (sum(CASE WHEN axis = 0 THEN s ELSE 0 END) OVER q - CASE WHEN axis = 0 THEN s ELSE 0 END)::BIGINT AS kx,
  ay + (sum(CASE WHEN axis = 1 THEN s ELSE 0 END) OVER q - CASE WHEN axis = 1 THEN s ELSE 0 END)::BIGINT AS ky,
  az + (sum(CASE WHEN axis = 2 THEN s ELSE 0 END) OVER q - CASE WHEN axis = 2 THEN s ELSE 0 END)::BIGINT AS kz
  FROM x WINDOW q AS (PARTITION BY ray_id ORDER BY t, axis ROWS UNBOUNDED PRECEDING)),
cells AS (SELECT *, {code_sql()} AS node FROM w)"""


@query("ray_cells_p18", f"WITH {CROSS} SELECT ray_id, pos, kx, ky, kz FROM w")
def ray_cells(spark, sf):
    return R.traverse(views.rays(spark, sf), RAY_RES, RAY_DEPTH)


@query("ray_centres_p19", f"WITH {CROSS} SELECT pos, count(*) AS n, {r6_sql('sum((kx - 127.5::DOUBLE) * 2)')} AS cx, {r6_sql('sum((kz - 127.5::DOUBLE) * 2)')} AS cz FROM w GROUP BY pos")
def ray_centres(spark, sf):
    c = R.traverse_centres(views.rays(spark, sf), RAY_RES, RAY_DEPTH)
    return c.groupBy("pos").agg(F.count("*").alias("n"), r6(F.sum("cx")).alias("cx"), r6(F.sum("cz")).alias("cz"))


OCC = f"""{PTS}, {KEYED}, occ AS (SELECT {code_sql()} AS node FROM keyed GROUP BY kx, ky, kz HAVING count(*) > 20)"""


@query(
    "ray_first_hit_j17",
    f"WITH {CROSS}, {OCC}, h AS (SELECT ray_id, pos, node FROM cells WHERE node IN (SELECT node FROM occ)) SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY ray_id ORDER BY pos) = 1",
)
def ray_first_hit(spark, sf):
    occ = V.occupied_voxels(views.pts(spark, sf), RAY_RES, RAY_DEPTH, 20)
    return R.first_hit(views.rays(spark, sf), occ, RAY_RES, RAY_DEPTH)


def _slab(a: str, k: str) -> tuple[str, str]:
    lo, hi = f"(({k} - 128) * 2.0::DOUBLE)", f"(({k} + size - 128) * 2.0::DOUBLE)"
    t1 = f"CASE WHEN o{a} = {lo} THEN 0.0::DOUBLE ELSE ({lo} - o{a}) / d{a} END"
    t2 = f"CASE WHEN o{a} = {hi} THEN 0.0::DOUBLE ELSE ({hi} - o{a}) / d{a} END"
    return f"least({t1}, {t2})", f"greatest({t1}, {t2})"


SLABS = [_slab(a, f"k{a}") for a in "xyz"]
OCC_LEAVES = f"{PTS}, {KEYED}, lf AS (SELECT kx, ky, kz, 1 AS size, {code_sql()} AS node FROM keyed GROUP BY kx, ky, kz HAVING count(*) > 25)"


@query(
    "ray_nodes_j16_t10",
    f"""WITH {RAYS}, {OCC_LEAVES}, t AS (SELECT ray_id, node, greatest({', '.join(s[0] for s in SLABS)}) AS tn, least({', '.join(s[1] for s in SLABS)}) AS tx,
      ox BETWEEN (kx-128)*2 AND (kx-127)*2 AND oy BETWEEN (ky-128)*2 AND (ky-127)*2 AND oz BETWEEN (kz-128)*2 AND (kz-127)*2 AS inside FROM rays, lf),
    h AS (SELECT ray_id, node, CASE WHEN NOT inside AND tn >= 0 THEN tn ELSE tx END AS d1 FROM t WHERE tx >= tn),
    o AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY d1 < 0, abs(d1), node) AS rank FROM h WHERE abs(d1) <= 30.0)
    SELECT ray_id, rank::INTEGER AS rank, {r6_sql('d1')} AS d1 FROM o""",
)
def ray_nodes(spark, sf):
    leaves = V.occupied_voxels(views.pts(spark, sf), RES, DEPTH, 25)
    hits = R.ray_nodes(views.rays(spark, sf), V.build_nodes(leaves, DEPTH), RES, DEPTH, bidirectional=True, max_range=30.0)
    return R.order_on_ray(hits).select("ray_id", "rank", r6(F.col("d1")).alias("d1"))


HIT, MISS, LOW, HIGH = R.log_odds(0.7), R.log_odds(0.4), -2.0, 3.5
FUSED = f"""{CROSS}, en AS (SELECT frame_id, bx AS kx, by_ AS ky, bz AS kz FROM k),
up AS (SELECT frame_id, node, max(hit) AS hit FROM (SELECT frame_id, node, 0 AS hit FROM cells UNION ALL SELECT frame_id, {code_sql()}, 1 FROM en) GROUP BY ALL),
dl AS (SELECT frame_id, node, CASE WHEN hit = 1 THEN {HIT!r}::DOUBLE ELSE {MISS!r}::DOUBLE END AS d FROM up),
fused AS (SELECT node, list_reduce(list(d ORDER BY frame_id), lambda acc, d: least({HIGH}::DOUBLE, greatest({LOW}::DOUBLE, acc + d)), 0.0::DOUBLE) AS value FROM dl GROUP BY node)"""


def _fused(spark, sf):
    updates = R.scan_updates(views.rays(spark, sf), RAY_RES, RAY_DEPTH, 0.7, 0.4)
    return R.fuse_updates(updates, LOW, HIGH)


@query(
    "occupancy_a17",
    f"WITH {FUSED} SELECT node, {r6_sql('value')} AS value, {r6_sql('1 - 1 / (1 + exp(value))')} AS p, value > 0 AS occupied, CASE WHEN value > 0 THEN 3.5::DOUBLE ELSE -2.0::DOUBLE END AS ml FROM fused",
)
def occupancy(spark, sf):
    cells = _fused(spark, sf).withColumn("old", F.col("value"))
    ml = R.most_likely(cells, LOW, HIGH)
    v = F.col("old")
    return ml.select("node", r6(v).alias("value"), r6(R.probability(v)).alias("p"), (v > 0).alias("occupied"), F.col("value").alias("ml"))


@query("inner_occupancy_a17", f"WITH {FUSED} SELECT node >> (3 * l)::INTEGER AS node, {r6_sql('max(value)')} AS value FROM fused, range(9) r(l) GROUP BY ALL")
def inner_occupancy(spark, sf):
    out = R.inner_occupancy(_fused(spark, sf), RAY_DEPTH)
    return out.select("node", r6(F.col("value")).alias("value"))


BOX2 = ((110, 110), (170, 170))


def _flat(spark, sf):
    rays = views.rays(spark, sf).drop("oz", "dz")
    updates = R.scan_updates(rays, RAY_RES, RAY_DEPTH, 0.7, 0.4, dims=2)
    return R.fuse_updates(updates, LOW, HIGH)


FLAT = f"""{RAYS}, e AS (SELECT *, ox + depth * dx AS ex, oy + depth * dy AS ey FROM rays),
k AS (SELECT *, floor(ox / 2.0::DOUBLE)::BIGINT + 128 AS ax, floor(oy / 2.0::DOUBLE)::BIGINT + 128 AS ay, floor(ex / 2.0::DOUBLE)::BIGINT + 128 AS bx, floor(ey / 2.0::DOUBLE)::BIGINT + 128 AS by_ FROM e),
x AS (SELECT ray_id, frame_id, ax, ay, 0 AS axis, sign(bx - ax)::BIGINT AS s, ((CASE WHEN bx > ax THEN ax + 1 + m ELSE ax - m END - 128) * 2.0::DOUBLE - ox) / (ex - ox) AS t FROM k, range(60) r(m) WHERE m < abs(bx - ax)
  UNION ALL SELECT ray_id, frame_id, ax, ay, 1, sign(by_ - ay)::BIGINT, ((CASE WHEN by_ > ay THEN ay + 1 + m ELSE ay - m END - 128) * 2.0::DOUBLE - oy) / (ey - oy) FROM k, range(60) r(m) WHERE m < abs(by_ - ay)),
w AS (SELECT frame_id, ax + (sum(CASE WHEN axis = 0 THEN s ELSE 0 END) OVER q - CASE WHEN axis = 0 THEN s ELSE 0 END)::BIGINT AS kx,
  ay + (sum(CASE WHEN axis = 1 THEN s ELSE 0 END) OVER q - CASE WHEN axis = 1 THEN s ELSE 0 END)::BIGINT AS ky FROM x WINDOW q AS (PARTITION BY ray_id ORDER BY t, axis ROWS UNBOUNDED PRECEDING)),
up AS (SELECT frame_id, kx, ky, max(hit) AS hit FROM (SELECT frame_id, kx, ky, 0 AS hit FROM w UNION ALL SELECT frame_id, bx, by_, 1 FROM k) GROUP BY ALL),
cell AS (SELECT kx, ky, list_reduce(list(CASE WHEN hit = 1 THEN {HIT!r}::DOUBLE ELSE {MISS!r}::DOUBLE END ORDER BY frame_id), lambda acc, d: least({HIGH}::DOUBLE, greatest({LOW}::DOUBLE, acc + d)), 0.0::DOUBLE) AS value
  FROM up WHERE kx BETWEEN 0 AND 255 AND ky BETWEEN 0 AND 255 GROUP BY ALL),
box AS (SELECT * FROM cell WHERE kx BETWEEN 110 AND 170 AND ky BETWEEN 110 AND 170)"""


@query(
    "cell_classes_a18",
    f"WITH {FLAT} SELECT count(*) FILTER (value > 0) AS occupied, count(*) FILTER (value <= 0) AS free, 61 * 61 - count(*) AS unexplored FROM box",
)
def cell_classes(spark, sf):
    return R.classify_cells(_flat(spark, sf), RAY_DEPTH, *BOX2)


@query(
    "frontier_cells_a18",
    f"""WITH {FLAT} SELECT DISTINCT b.kx, b.ky FROM box b, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(i, j) WHERE value <= 0
    AND b.kx + i BETWEEN 110 AND 170 AND b.ky + j BETWEEN 110 AND 170 AND (b.kx + i, b.ky + j) NOT IN (SELECT (kx, ky) FROM box)""",
)
def frontier_cells(spark, sf):
    return R.frontier_cells(_flat(spark, sf), RAY_DEPTH, *BOX2)


NS, NP, SIGMA = 2, 4, 0.2
SAMPLES = f"""{RAYS}, sm AS (SELECT ray_id, i::INTEGER AS s_idx, ox, oy, oz, dx, dy, dz, depth, {uniform_sql('ray_id', 'i')} AS u FROM rays, range({NS + NP + 1}) r(i) WHERE depth > 0.5 + 0.3 AND depth < 40.0),
st AS (SELECT *, CASE WHEN s_idx < 2 THEN 0.5::DOUBLE + (s_idx + u) * ((depth - 0.3::DOUBLE - 0.5::DOUBLE) / 2.0::DOUBLE) WHEN s_idx < 4 THEN depth - 0.6::DOUBLE + u * 0.4::DOUBLE
  WHEN s_idx < 6 THEN depth + 0.2::DOUBLE + u * 0.4::DOUBLE ELSE depth END AS t FROM sm),
samples AS (SELECT ray_id, s_idx, CASE WHEN s_idx < 2 THEN 'stratified' WHEN s_idx < 6 THEN 'perturbed' ELSE 'surface' END AS kind, t, ox + t * dx AS x, oy + t * dy AS y, oz + t * dz AS z,
  s_idx IN (4, 5) AS behind FROM st)"""


def samples(spark, sf):
    return R.ray_samples(views.rays(spark, sf), NS, NP, 0.5, 40.0, 0.3, SIGMA)


@query("ray_samples_r1_r3", f"WITH {SAMPLES} SELECT ray_id, s_idx, kind, behind, {r6_sql('t')} AS t, {r6_sql('x')} AS x, {r6_sql('y')} AS y, {r6_sql('z')} AS z FROM samples")
def ray_samples(spark, sf):
    s = samples(spark, sf)
    return s.select("ray_id", "s_idx", "kind", "behind", *[r6(F.col(c)).alias(c) for c in ("t", "x", "y", "z")])


@query(
    "step_samples_r5",
    f"WITH {RAYS} SELECT ray_id, s_idx, {r6_sql('ox + s_idx * 2.5::DOUBLE * dx')} AS x, {r6_sql('oz + s_idx * 2.5::DOUBLE * dz')} AS z FROM rays, range(1, 25) r(s_idx) WHERE s_idx <= floor(depth / 2.5::DOUBLE)",
)
def step_samples(spark, sf):
    s = R.step_samples(views.rays(spark, sf), 2.5)
    return s.select("ray_id", "s_idx", r6(F.col("x")).alias("x"), r6(F.col("z")).alias("z"))


@query(
    "hit_samples_r5",
    f"""WITH {RAYS} SELECT ray_id, i::INTEGER AS s_idx, {r6_sql(f"ox + depth * dx + {uniform_sql('ray_id', 'i * 3')} * 1.0::DOUBLE - 0.5::DOUBLE")} AS x,
    {r6_sql(f"oz + depth * dz + {uniform_sql('ray_id', 'i * 3 + 2')} * 1.0::DOUBLE - 0.5::DOUBLE")} AS z FROM rays, range(3) r(i)""",
)
def hit_samples(spark, sf):
    s = R.hit_samples(views.rays(spark, sf), 3, 0.5)
    return s.select("ray_id", "s_idx", r6(F.col("x")).alias("x"), r6(F.col("z")).alias("z"))


@query(
    "map_samples_r5",
    f"""WITH {PTS}, {KEYED}, v AS (SELECT DISTINCT kx, ky, kz, {code_sql()} AS node FROM keyed)
    SELECT node, i::INTEGER AS s_idx, {r6_sql(f"(kx - 127.5::DOUBLE) * 2.0::DOUBLE + ({uniform_sql('node', 'i * 3')} * 2.0::DOUBLE - 1.0::DOUBLE) * 1.0::DOUBLE")} AS x FROM v, range(2) r(i)""",
)
def map_samples(spark, sf):
    s = R.map_samples(V.occupied_voxels(views.pts(spark, sf), RES, DEPTH), RES, DEPTH, 2)
    return s.select("node", "s_idx", r6(F.col("x")).alias("x"))
