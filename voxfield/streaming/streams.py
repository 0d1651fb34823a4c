"""Streams of scans and poses (X1-X10) on Structured Streaming."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from voxfield.functions import geometry as G
from voxfield.operators import asof, keyframes
from voxfield.operators import voxelmap as V
from voxfield.session import exists
from voxfield.sources import readers

SLOP = "1 second"


# -- X1: scan source -----------------------------------------------------------------------------


def read_stream(spark: SparkSession, path: str, schema, glob: str | None = None, max_files: int = 16) -> DataFrame:
    """Files that arrive in a folder, at most ``max_files`` per trigger (back-pressure, X6)."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def scan_points(messages: DataFrame, kind: str, depth_scale: float = 1.0, camera: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Raw scan messages with a ``pose`` to points in the sensor frame; broken poses drop the frame.

    ``depth`` messages are raw images (S5) and need ``camera`` (fx, fy, cx, cy); ``cloud`` are packed points (S6).
    """
    good = messages.filter(G.finite_pose(F.col("pose")))
    if kind == "cloud":
        return readers.decode_cloud(good)
    if kind != "depth":
        raise ValueError(f"unknown scan kind: {kind}")
    pixels = readers.decode_depth(good, depth_scale).filter("depth > 0")
    at = G.back_project(G.pixel_ray(F.col("u"), F.col("v"), *camera), F.col("depth"))
    return pixels.select("frame_id", *[c.alias(a) for a, c in zip("xyz", at)])


# -- X2, X3: joining scans and poses ---------------------------------------------------------------


def stream_pairs(scans: DataFrame, poses: DataFrame, key: str, slop: str = SLOP, delay: str = SLOP, ts: str = "ts") -> DataFrame:
    """All scan/pose pairs of a key within ``slop``, as a watermarked interval join: scan columns, then
    pose columns with the prefix ``p_``."""
    left = scans.withWatermark(ts, delay)
    right = poses.select(*[F.col(c).alias(f"p_{c}") for c in poses.columns]).withWatermark(f"p_{ts}", delay)
    near = F.expr(f"p_{ts} BETWEEN {ts} - INTERVAL {slop} AND {ts} + INTERVAL {slop}")
    return left.join(right, (F.col(key) == F.col(f"p_{key}")) & near)


# -- X1-X4: results in event-time order ---------------------------------------------------------------


class OrderedSink:
    """``foreachBatch`` sink that hands rows on in event-time order, however files and triggers cut the input.

    Every batch is written to ``rows``. Rows at least ``delay`` older than the newest stamp (a bigint column ``t``) can no longer be preceded
    and go through ``step``, whose result is written to ``out``; what later steps need of them is kept in ``state``. ``finish`` hands on
    the rest at the end of the input, so no tail stays behind. With ``delay=None`` (files in no order at all) nothing is handed on before
    that. Rows that come later than ``delay`` allows are kept in ``late``.

    Folders are named ``batch=N`` and overwritten when a batch is repeated. A stream that goes on after ``finish`` overwrites
    what it wrote, so it can be called again. The rows must not have a column ``batch``.
    """

    def __init__(self, path: str, t: str, delay: int | None = None):
        self.path, self.t, self.delay = path, t, delay

    def step(self, rows: DataFrame, state: DataFrame | None, high: int, last: bool) -> DataFrame:
        """The result of ``rows``, the next ones in event time, up to ``high``."""
        raise NotImplementedError

    def carry(self, rows: DataFrame, out: DataFrame, state: DataFrame | None, high: int) -> DataFrame:
        """What the next step needs; ``out`` is the result that was just written."""
        raise NotImplementedError

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = self._write(batch, "rows", batch_id)
        before, low = self._released(spark, batch_id)
        newest = rows.agg(F.max(self.t)).first()[0]
        high = low if newest is None or self.delay is None else max(newest - self.delay, newest - self.delay if low is None else low)
        self._write(rows.filter(F.lit(False) if low is None else F.col(self.t) <= F.lit(low)), "late", batch_id)
        if high is None or high == low:
            return
        self._hand_on(spark, batch_id, before, low, high, False)
        self._write(spark.createDataFrame([(high,)], "high bigint"), "released", batch_id)

    def finish(self, spark: SparkSession) -> None:
        """Hand on all rows that are still held back."""
        if not exists(spark, f"{self.path}/rows"):
            return
        newest, n = self._read(spark, "rows").agg(F.max(self.t), F.max("batch")).first()
        if newest is not None:
            before, low = self._released(spark, n + 1)
            self._hand_on(spark, n + 1, before, low, newest, True)

    def result(self, spark: SparkSession) -> DataFrame | None:
        """Everything handed on so far; None if that is nothing."""
        return self._read(spark, "out").drop("batch") if exists(spark, f"{self.path}/out") else None

    def _hand_on(self, spark, batch_id, before, low, high, last) -> None:
        rows = self._read(spark, "rows").filter((F.col("batch") <= batch_id) & (F.col(self.t) <= F.lit(high)))
        rows = (rows if low is None else rows.filter(F.col(self.t) > F.lit(low))).drop("batch")
        state = None if before is None else spark.read.parquet(f"{self.path}/state/batch={before}")
        out = self._write(self.step(rows, state, high, last), "out", batch_id)
        if not last:
            self._write(self.carry(rows, out, state, high), "state", batch_id)

    def _released(self, spark, batch_id) -> tuple[int | None, int | None]:
        """The last batch before ``batch_id`` that handed rows on, and up to where."""
        if not exists(spark, f"{self.path}/released"):
            return None, None
        done = self._read(spark, "released").filter(F.col("batch") < batch_id).agg(F.max(F.struct("batch", "high"))).first()[0]
        return (None, None) if done is None else tuple(done)

    def _read(self, spark, name) -> DataFrame:
        return spark.read.parquet(f"{self.path}/{name}")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{self.path}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


class NumberSink(OrderedSink):
    """W5/X1 on a stream: consecutive ``seq`` from 0 per key in order of ``t``: (key, t, seq). The state is one count per key."""

    def __init__(self, path: str, key: str, t: str = "t", delay: int | None = None):
        super().__init__(path, t, delay)
        self.key = key

    def step(self, rows, state, high, last):
        block = F.floor(F.col(self.t) / F.lit(asof.TIME_BLOCK)).cast("bigint")
        out = asof.numbered(rows.select(self.key, self.t), [self.key], (self.t,), block, "_nth")
        seen = F.lit(0)
        if state is not None:
            out, seen = out.join(state, self.key, "left"), F.coalesce("_seen", F.lit(0))
        return out.select(self.key, self.t, (seen + F.col("_nth") - 1).cast("bigint").alias("seq"))

    def carry(self, rows, out, state, high):
        now = out.groupBy(self.key).agg((F.max("seq") + 1).alias("_seen"))
        return now if state is None else now.unionByName(state).groupBy(self.key).agg(F.max("_seen").alias("_seen"))


class KeyFrameSink(OrderedSink):
    """(scene, frame_id) of key frames from voxel rows (scene, frame_id, node): the first frame, then every frame whose IoU with
    the last key frame is below ``ratio``. Frames are ordered by ``frame_id`` and may arrive in pieces; ``delay`` counts
    frame ids. The state of a scene is the last key frame's voxels."""

    def __init__(self, path: str, ratio: float, delay: int | None = None):
        super().__init__(path, "frame_id", delay)
        self.ratio = ratio

    def step(self, rows, state, high, last):
        rows = rows.select("scene", "frame_id", "node")
        if state is None:
            return keyframes.iou_key_frames(rows, self.ratio)
        # The last key frame of a scene starts its chain again and is not reported twice.
        keys = keyframes.iou_key_frames(rows.unionByName(state), self.ratio)
        return keys.join(state.select("scene", "frame_id").distinct(), ["scene", "frame_id"], "left_anti")

    def carry(self, rows, out, state, high):
        rows, keys = rows.select("scene", "frame_id", "node"), out
        if state is not None:
            rows, keys = rows.unionByName(state), keys.unionByName(state.select("scene", "frame_id").distinct())
        newest = keys.groupBy("scene").agg(F.max("frame_id").alias("frame_id"))
        return rows.join(newest, ["scene", "frame_id"], "left_semi").distinct()


def sync_messages(scans: DataFrame, poses: DataFrame, key: str, scan_id: str, pose_id: str, t: str = "t") -> DataFrame:
    """Two streams as one of (key, side 'scan'|'pose', id, t), the input of the sinks below."""
    side = lambda df, name, ident: df.select(F.col(key).alias("key"), F.lit(name).alias("side"), F.col(ident).alias("id"), F.col(t).alias("t"))
    return side(scans, "scan", scan_id).unionByName(side(poses, "pose", pose_id))


class NearestSink(OrderedSink):
    """The pose nearest in time to each scan (tie: earlier, then smaller id): (key, scan_id, pose_id, t, gap). A scan is answered once
    no nearer pose can come, by a time-nearest join; scans without a pose within ``slop`` are dropped. The state
    holds the messages of the last two ``slop``."""

    def __init__(self, path: str, slop: int, delay: int | None = None):
        super().__init__(path, "t", delay)
        self.slop = slop

    def _pool(self, rows, state):
        rows = rows.select("key", "side", "id", "t")
        return rows if state is None else rows.unionByName(state)

    def step(self, rows, state, high, last):
        pool = self._pool(rows, state)
        ready = pool.filter(F.col("side") == "scan").select("key", F.col("id").alias("scan_id"), "t")
        ready = ready if last else ready.filter(F.col("t") <= F.lit(high - self.slop))
        poses = pool.filter(F.col("side") == "pose").select("key", F.col("id").alias("pose_id"), "t")
        near = asof.asof_nearest(ready, poses, ["key"], "t", ("pose_id",), self.slop)
        return near.select("key", "scan_id", "pose_id", "t", F.abs("dt").alias("gap"))

    def carry(self, rows, out, state, high):
        keep = F.when(F.col("side") == "scan", F.lit(high - self.slop)).otherwise(F.lit(high - 2 * self.slop))
        return self._pool(rows, state).filter(F.col("t") > keep - F.when(F.col("side") == "scan", 0).otherwise(1))


class PairSink(OrderedSink):
    """One-to-one pairing of two message kinds in time order (ties: pose, then id): (key, scan_id, pose_id, gap).

    A message takes the nearest waiting one of the other side within ``slop`` and both are used up; otherwise it waits until
    ``slop`` has passed, so none is lost. ``queue`` bounds the waiting messages of a side and then drops the oldest. Messages more than ``slop``
    apart never meet: such gaps cut a key into runs, which are dealt out and paired one by one.
    """

    def __init__(self, path: str, slop: int, delay: int | None = None, queue: int | None = None):
        super().__init__(path, "t", delay)
        self.slop, self.queue = slop, queue

    def _pool(self, rows, state):
        rows = rows.select("key", "side", "id", "t")
        return rows if state is None else rows.unionByName(state)

    def step(self, rows, state, high, last):
        pool = self._pool(rows, state)
        at = asof.with_previous(pool.select("key", "t").distinct(), ["key"], "t", (), asof.TIME_BLOCK)
        heads = at.withColumn("_new", F.when(F.col("t") - F.col("prev.t") <= F.lit(self.slop), 0.0).otherwise(1.0)).drop("prev")
        block = F.floor(F.col("t") / F.lit(asof.TIME_BLOCK)).cast("bigint")
        runs = asof.running_sum(heads, ["key"], ("t",), block, "_new", "_passed")
        runs = runs.select("key", "t", (F.col("_passed") + F.col("_new")).cast("bigint").alias("run"))
        kind = dict(pool.dtypes)
        schema = f"key {kind['key']}, scan_id {kind['id']}, pose_id {kind['id']}, gap bigint"
        ordered = pool.join(runs, ["key", "t"]).repartition("key", "run").sortWithinPartitions("key", "run", "t", "side", "id")
        return ordered.mapInPandas(_pairs(self.slop, self.queue), schema)

    def carry(self, rows, out, state, high):
        pool = self._pool(rows, state).filter(F.col("t") >= F.lit(high - self.slop))
        used = out.select("key", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("id")) for s in ("scan", "pose")])).alias("_u"))
        return pool.join(used.select("key", "_u.side", "_u.id"), ["key", "side", "id"], "left_anti")


def _pairs(slop: int, queue: int | None) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pairs of sorted runs, row by row: only the waiting messages of one run are held."""

    def run(batches):
        here, waiting = None, {}
        for rows in batches:
            found = []
            for key, number, side, ident, at in zip(rows["key"], rows["run"], rows["side"], rows["id"], rows["t"]):
                if (key, number) != here:
                    here, waiting = (key, number), {"scan": [], "pose": []}
                other = "pose" if side == "scan" else "scan"
                waiting = {k: [m for m in v if at - m[0] <= slop] for k, v in waiting.items()}
                best = min(waiting[other], key=lambda m: (at - m[0], m[1]), default=None)
                if best is None:
                    waiting[side] = [*waiting[side], (at, ident)][-queue if queue else None :]
                    continue
                waiting[other].remove(best)
                scan, pose = (ident, best[1]) if side == "scan" else (best[1], ident)
                found.append((key, scan, pose, at - best[0]))
            yield pd.DataFrame(found, columns=["key", "scan_id", "pose_id", "gap"])

    return run


# -- X5, X6: growing voxel table -------------------------------------------------------------------


def newest(batch: DataFrame, n: int, t: str = "t") -> DataFrame:
    """The newest n messages of a batch; older ones are dropped, as a full queue does."""
    return batch.orderBy(F.col(t).desc()).limit(n)


class VoxelSink:
    """``foreachBatch`` sink that keeps the occupied voxels and each frame's seen voxels up to date.

    Every batch writes its point counts per frame and voxel (``batch=N``) and overwrites them when it is run again, so a batch
    that is repeated after a failure changes nothing. Counts add up and the threshold applies to their sum, so a frame may
    arrive in any number of batches.
    """

    def __init__(self, path: str, res: float, depth: int, threshold: int = 0, by: tuple[str, ...] = ("scene", "frame_id")):
        self.path, self.res, self.depth, self.threshold, self.by = path, res, depth, threshold, by

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        counts = V.occupied_voxels(batch, self.res, self.depth, 0, self.by).select(*self.by, "node", "n")
        counts.write.mode("overwrite").parquet(f"{self.path}/counts/batch={batch_id}")

    def seen(self, spark: SparkSession) -> DataFrame:
        """The voxels of each frame so far."""
        counts = spark.read.parquet(f"{self.path}/counts").groupBy(*self.by, "node").agg(F.sum("n").alias("n"))
        return counts.filter(F.col("n") > self.threshold).select(*self.by, "node")

    def voxels(self, spark: SparkSession) -> DataFrame:
        """The occupied leaf voxels so far."""
        return self.seen(spark).select("node").distinct()


# -- X7-X10: running -------------------------------------------------------------------------------


class IdleStop(StreamingQueryListener):
    """Stop a query after ``seconds`` without new rows, then call ``after`` (final evaluation) once."""

    def __init__(self, query_id: str, seconds: float, after: Callable[[], None] | None = None):
        self.query_id, self.seconds, self.after = query_id, seconds, after
        self.last = time.monotonic()
        self.expired = False

    def onQueryStarted(self, event) -> None:
        if str(event.id) == self.query_id:
            self.last = time.monotonic()

    def onQueryProgress(self, event) -> None:
        if str(event.progress.id) == self.query_id and event.progress.numInputRows > 0:
            self.last = time.monotonic()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def watch(self, query: StreamingQuery, poll: float = 0.2) -> None:
        """Wait for the query to end, or stop it when it has been idle for too long."""
        while query.isActive:
            if time.monotonic() - self.last > self.seconds:
                self.expired = True
                query.stop()
                break
            query.awaitTermination(poll)
        if self.after:
            self.after()


def run_until_idle(query: StreamingQuery, seconds: float, after: Callable[[], None] | None = None) -> bool:
    """Run a started query until no data came for ``seconds``; True if it was stopped for that."""
    spark = query.sparkSession if hasattr(query, "sparkSession") else SparkSession.getActiveSession()
    guard = IdleStop(query.id, seconds, after)
    spark.streams.addListener(guard)
    try:
        guard.watch(query)
    finally:
        spark.streams.removeListener(guard)
    return guard.expired


def refine_between(start: Callable[[], StreamingQuery], refine: Callable[[int], None], rounds: int) -> int:
    """Alternate draining all available data with a refinement of what is there; stops after ``rounds``.

    ``start`` starts the query with ``availableNow``. Returns the rounds in which data came in.
    """
    busy = 0
    for n in range(rounds):
        query = start()
        query.awaitTermination()
        busy += any(p["numInputRows"] for p in query.recentProgress)
        refine(n)
    return busy


def publish_periodically(spark: SparkSession, publish: Callable[[int], None], seconds: float, checkpoint: str | None = None) -> StreamingQuery:
    """Call ``publish(tick)`` at a fixed rate. Batches of one query never overlap, so at most one
    publication is in flight and late ticks are skipped."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = ticks.writeStream.trigger(processingTime=f"{seconds} seconds").foreachBatch(lambda _, n: publish(n))
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()


def snapshot_query(spark: SparkSession, path: str, points: DataFrame, res: float, depth: int, return_grad: bool = False) -> DataFrame:
    """Answer a point query from the newest complete snapshot while mapping goes on."""
    from voxfield.operators import field as FD
    from voxfield.sources.writers import load_snapshot

    _, vertices, voxels, _ = load_snapshot(spark, path)
    return FD.service_query(points, FD.corner_rows(voxels, vertices, res, depth), res, depth, return_grad)


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream to Parquet, draining what is available."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)


def start_batches(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand a stream to a ``foreachBatch`` sink, draining what is available."""
    return df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(sink).start()
