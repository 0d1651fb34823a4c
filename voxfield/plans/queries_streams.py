"""Driver queries that run the tables as streams and through the sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from voxfield.operators import field as FD
from voxfield.operators import filters, grids, metrics
from voxfield.operators import voxelmap as V
from voxfield.plans import views
from voxfield.plans.queries_metrics import ERRS, FIELD, field_rows
from voxfield.plans.queries_selection import _key_walk, frame_voxels
from voxfield.plans.registry import query
from voxfield.plans.views import DEPTH, KEYED, PTS, RES, SCANS, code_sql, r6
from voxfield.plans.queries_field import corners, point_bounds, vertex_field
from voxfield.plans.queries_voxels import MAP, _map
from voxfield.session import shared_dir
from voxfield.sources import chunks, readers, writers
from voxfield.streaming import streams as ST


HOUR = 3_600_000_000


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/run-{uuid.uuid4().hex}"


def _stream(spark, sf, name):
    schema = views.table(spark, sf, name).schema
    # A pattern, so that a table may be one file or a folder of part files.
    return ST.read_stream(spark, f"{sf}/{name}.parque[t]", schema)


@query(
    "stream_voxels_x5",
    f"WITH {PTS}, {KEYED} SELECT DISTINCT {code_sql()} AS node FROM (SELECT scene, frame_id, kx, ky, kz FROM keyed GROUP BY ALL HAVING count(*) > 1)",
)
def stream_voxels(spark, sf):
    home = _folder(spark)
    sink = ST.VoxelSink(f"{home}/map", RES, DEPTH, 1)
    rows = _stream(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("scene"), F.col("l_suppkey").alias("frame_id"), F.col("l_quantity").alias("x"),
        (F.col("l_extendedprice") / 2000.0).alias("y"), (F.col("l_discount") * 100.0).alias("z"),
    )
    ST.start_batches(rows, sink, f"{home}/checkpoint").awaitTermination()
    return sink.voxels(spark)


#: Pieces in which a table's rows arrive at a stream.
ARRIVALS = 4


def _arrive(spark, rows, t, sink, home):
    """All ``rows`` reach the sink in pieces by their bigint stamp ``t``, the earlier piece first; the query goes on from its checkpoint after each.

    Rows without a stamp come with the first piece.
    """
    cuts = rows.approxQuantile(t, [i / ARRIVALS for i in range(1, ARRIVALS)], 0.01)
    piece = sum((F.coalesce(F.col(t) > F.lit(int(c)), F.lit(False)).cast("int") for c in cuts), F.lit(0))
    rows.withColumn("piece", piece).write.partitionBy("piece").parquet(f"{home}/pieces")
    pieces = spark.read.schema(rows.withColumn("piece", piece).schema).parquet(f"{home}/pieces")
    for i in range(ARRIVALS):
        pieces.filter(F.col("piece") == i).drop("piece").write.mode("append").parquet(f"{home}/arrived")
        ST.start_batches(ST.read_stream(spark, f"{home}/arrived", rows.schema, max_files=1 << 20), sink, f"{home}/checkpoint").awaitTermination()
    sink.finish(spark)


@query("stream_key_frames_x4", _key_walk())
def stream_key_frames(spark, sf):
    home = _folder(spark)
    sink = ST.KeyFrameSink(f"{home}/keys", 0.7, delay=1)
    _arrive(spark, frame_voxels(spark, sf), "frame_id", sink, home)
    return sink.result(spark)


def _messages(spark, sf):
    ev = views.table(spark, sf, "events").filter(F.col("event_type").isin("view", "click"))
    side = F.when(F.col("event_type") == "view", "scan").otherwise("pose")
    return ev.select(F.col("user_id").alias("key"), side.alias("side"), F.col("event_id").alias("id"), views.micros("ts").alias("t"))


#: One message after the other, with the list of those that wait.
SYNC = f"""WITH RECURSIVE {SCANS}, m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, side, id) AS i FROM
      (SELECT key, 'scan' AS side, scan_id AS id, t FROM scans UNION ALL SELECT key, 'pose', pose_id, t FROM poses)),
    r(key, i, w, scan_id, pose_id, gap) AS (
      SELECT DISTINCT key, 0::BIGINT, []::STRUCT(side VARCHAR, id BIGINT, t BIGINT)[], NULL::BIGINT, NULL::BIGINT, NULL::BIGINT FROM m
      UNION ALL
      SELECT key, i, CASE WHEN b IS NULL THEN list_append(l, {{'side': side, 'id': id, 't': t}}) ELSE list_filter(l, lambda x: x.side = side OR x.id <> b.id) END,
        CASE WHEN b IS NOT NULL THEN if(side = 'scan', id, b.id) END, CASE WHEN b IS NOT NULL THEN if(side = 'scan', b.id, id) END, b.gap
      FROM (SELECT *, list_sort(list_transform(list_filter(l, lambda x: x.side <> side), lambda x: {{'gap': t - x.t, 'id': x.id}}))[1] AS b
        FROM (SELECT m.*, list_filter(r.w, lambda x: m.t - x.t <= {6 * HOUR}) AS l FROM r JOIN m ON m.key = r.key AND m.i = r.i + 1)))
    SELECT key, scan_id, pose_id, gap FROM r WHERE scan_id IS NOT NULL"""


@query("stream_sync_x2", SYNC)
def stream_sync(spark, sf):
    home = _folder(spark)
    sink = ST.PairSink(f"{home}/pairs", 6 * HOUR, delay=HOUR)
    _arrive(spark, _messages(spark, sf), "t", sink, home)
    return sink.result(spark)


@query(
    "stream_nearest_x3",
    f"""WITH {SCANS}, c AS (SELECT s.key, s.scan_id, p.pose_id, abs(p.t - s.t) AS gap, row_number() OVER (PARTITION BY s.key, s.scan_id ORDER BY abs(p.t - s.t), p.t, p.pose_id) AS i
      FROM scans s JOIN poses p ON p.key = s.key AND abs(p.t - s.t) <= {8 * HOUR})
    SELECT key, scan_id, pose_id, gap FROM c WHERE i = 1""",
)
def stream_nearest(spark, sf):
    home = _folder(spark)
    sink = ST.NearestSink(f"{home}/near", 8 * HOUR, delay=HOUR)
    _arrive(spark, _messages(spark, sf), "t", sink, home)
    return sink.result(spark).select("key", "scan_id", "pose_id", "gap")


@query(
    "stream_numbers_x1_w5",
    f"WITH {SCANS} SELECT key, t, row_number() OVER (PARTITION BY key ORDER BY t) - 1 AS seq FROM scans",
)
def stream_numbers(spark, sf):
    home = _folder(spark)
    sink = ST.NumberSink(f"{home}/seq", "key", delay=HOUR)
    _arrive(spark, _messages(spark, sf).filter(F.col("side") == "scan").select("key", "t"), "t", sink, home)
    return sink.result(spark)


@query("newest_messages_x6", f"WITH {SCANS} SELECT scan_id FROM scans ORDER BY t DESC LIMIT 500")
def newest_messages(spark, sf):
    return ST.newest(views.scans(spark, sf), 500).select("scan_id")


# -- sinks ---------------------------------------------------------------------------------------


@query(
    "trajectory_file_s16_s1",
    "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS frame_id, round(c_acctbal, 2) AS tx, (c_custkey % 7)::DOUBLE AS tz FROM customer",
)
def trajectory_file(spark, sf):
    home = _folder(spark)
    c = views.table(spark, sf, "customer")
    pose = F.array(*[F.lit(float(i % 5 == 0)) for i in range(3)], F.col("c_acctbal"), *[F.lit(0.0)] * 7, F.pmod("c_custkey", F.lit(7)).cast("double"), *[F.lit(0.0)] * 3, F.lit(1.0))
    frames = c.select(F.col("c_custkey").alias("frame_id"), pose.alias("pose"))
    writers.write_trajectory(frames, f"{home}/traj")
    # Number lines over all part files in their order.
    lines = readers.read_trajectory(spark, f"{home}/traj")
    files = lines.groupBy("path").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = files.select("path", before.alias("first"))
    out = lines.join(first, "path")
    return out.select((F.col("frame_id") + F.col("first")).alias("frame_id"), F.round(F.get("pose", 3), 2).alias("tx"), F.get("pose", 11).alias("tz"))


@query("text_lines_s1", "SELECT sum(n)::BIGINT AS n, sum(h)::BIGINT AS total FROM (SELECT count(*) AS n, sum(o_orderkey) AS h FROM orders)")
def text_lines(spark, sf):
    home = _folder(spark)
    views.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("value")).write.text(f"{home}/text")
    lines = chunks.text_lines(spark, f"{home}/text", size=4096)
    return lines.agg(F.count("*").alias("n"), F.sum(F.col("value").cast("bigint")).alias("total"))


@query(
    "metrics_row_s14",
    f"""WITH {FIELD}, {ERRS} SELECT 'run' AS subject, round(avg(abs(e)) FILTER (field = 'sdf' AND region = 'near') + 1e-9::DOUBLE, 6) AS "sdf.near.mae", round(avg(abs(e)) FILTER (field = 'sdf_prior' AND region = 'far') + 1e-9::DOUBLE, 6) AS "sdf_prior.far.mae" FROM er""",
)
def metrics_row(spark, sf):
    e = metrics.sdf_errors(field_rows(spark, sf), ("sdf", "sdf_prior"))
    long = e.select(F.lit("run").alias("subject"), "field", "region", F.lit("mae").alias("metric"), r6(F.col("mae")).alias("value"))
    return writers.metrics_row(long).select("subject", "`sdf.near.mae`", "`sdf_prior.far.mae`")


@query("grid_map_s19_g3_s20")
def grid_map(spark, sf):
    low, high = point_bounds(spark, sf)
    centre = [(a + b) / 2 for a, b in zip(low, high)]
    plane = grids.sensor_plane(spark, 60, 40, 0.5, centre)
    got = FD.service_query(plane, corners(spark, sf), RES, DEPTH, return_grad=True)
    row = writers.grid_map(got, 60, 40, 0.5)
    return row.select("resolution", "length_x", "length_y", F.explode("layers").alias("layer", "values"))


@query("snapshot_s17_x10", f"{MAP} SELECT count(*) AS n_voxels, 3::INTEGER AS epoch FROM map")
def snapshot(spark, sf):
    home = _folder(spark)
    m = _map(spark, sf)
    v = vertex_field(spark, sf)
    for epoch in (1, 3):
        if writers.due(epoch, 1):
            writers.save_snapshot(home, epoch, v, m.select("node"))
    epoch, _, voxels, _ = writers.load_snapshot(spark, home)
    return voxels.agg(F.count("*").alias("n_voxels"), F.lit(epoch).alias("epoch"))


@query("snapshot_query_x10")
def snapshot_query(spark, sf):
    home = _folder(spark)
    writers.save_snapshot(home, 1, vertex_field(spark, sf), _map(spark, sf).select("node"))
    return ST.snapshot_query(spark, home, views.pts_k(spark, sf), RES, DEPTH)


@query(
    "occupied_frames_f11",
    f"WITH {PTS}, {KEYED} SELECT DISTINCT scene, frame_id FROM keyed GROUP BY scene, frame_id, kx, ky, kz HAVING count(*) > 1",
)
def occupied_frames(spark, sf):
    p = views.pts(spark, sf)
    occ = V.occupied_voxels(p, RES, DEPTH, 1, ("scene", "frame_id"))
    return filters.occupied_frames(p.select("scene", "frame_id").distinct(), occ)


@query("frame_range_s11", f"WITH {PTS} SELECT frame_id, count(*) AS n FROM pts WHERE frame_id >= 10 AND frame_id < 30 GROUP BY frame_id")
def frame_range(spark, sf):
    return filters.frame_range(views.pts(spark, sf), 10, 30).groupBy("frame_id").agg(F.count("*").alias("n"))
