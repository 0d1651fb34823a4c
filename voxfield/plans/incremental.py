"""L4: a map that remembers. One state is carried over batches of frames, whatever their number.

The state of a run lies in the shared folder:

* voxels of every scene and the voxel sets of its key frames; the chain of key frames goes on from the last one, so batches of any
  size give the key frames of the whole run;
* coverage (which voxels no selection has covered) and how many rays each key frame was asked for;
* rays of the key frames, so that later batches fit earlier key frames again;
* vertices with their Adam moments and the step they stand at, in parts by the high bits of their position. A batch reads and writes only the parts
  around its samples; what other vertices would have moved meanwhile, with moments but no pull, is caught up when they are next
  read (``fit.idle_steps``). The result is that of Adam over all vertices in every step.

A frame that the state already holds is skipped, so a repeated batch changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.operators import field as FD
from voxfield.operators import filters, frames, keyframes, sampling
from voxfield.operators import rays as R
from voxfield.operators import voxelmap as V
from voxfield.plans import fit
from voxfield.plans.mapping import Map, MapConfig, frame_rays
from voxfield.session import cut, free, remove, shared_dir

PARAMS = ["sdf", "gx", "gy", "gz"]
STORED = ", ".join(["ns string, vx int, vy int, vz int", *[f"{c} double" for c in PARAMS], *[f"{m}_{c} double" for c in PARAMS for m in "mv"], "at int"])
#: Vertices per edge of a part, as a power of two.
PART_BITS = 5


def part_of(bits: int = PART_BITS) -> F.Column:
    """Number of the part that holds a vertex."""
    x, y, z = (F.shiftright(F.col(f"v{a}").cast("bigint"), bits) for a in "xyz")
    return F.shiftleft(x, 40) + F.shiftleft(y, 20) + z


class Parts:
    """A table in parts. ``put`` writes the parts it is given anew, and nothing else; older versions of them go."""

    def __init__(self, spark: SparkSession, path: str, columns: str):
        self.spark, self.path, self.columns, self.versions = spark, path, columns, 0
        self.index = cut(spark.createDataFrame([], "part bigint, version int"))

    def get(self, parts: DataFrame | None = None) -> DataFrame:
        """Rows of the named parts (column ``part``), of all parts by default."""
        if not self.versions:
            return self.spark.createDataFrame([], f"{self.columns}, part bigint")
        stored = self.spark.read.schema(f"{self.columns}, version int, part bigint").parquet(self.path)
        wanted = self.index if parts is None else self.index.join(parts.select("part"), "part", "left_semi")
        return stored.join(wanted, ["part", "version"]).drop("version")

    def put(self, rows: DataFrame) -> None:
        """Store ``rows`` (with ``part``) in place of what their parts held."""
        version = self.versions
        rows.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{self.path}/version={version}")
        written = self.spark.read.schema(f"{self.columns}, part bigint").parquet(f"{self.path}/version={version}").select("part").distinct()
        old = self.index
        self.index = cut(old.join(written, "part", "left_anti").unionByName(written.withColumn("version", F.lit(version))))
        free(old)
        self.versions = version + 1
        # One row per version that something still refers to.
        live = {r["version"] for r in self.index.select("version").distinct().collect()}
        for v in range(self.versions):
            if v not in live:
                remove(self.spark, f"{self.path}/version={v}")


@dataclass
class MapState:
    """What a run knows after some batches. ``frames`` counts the frames of each scene."""

    home: str
    known: DataFrame  # scene, frame_id of every frame taken
    voxels: DataFrame  # scene, node
    keys: DataFrame  # scene, frame_id, samples
    key_voxels: DataFrame  # scene, frame_id, node
    replay: DataFrame  # rays of the key frames
    batch: int = 0
    steps: dict[str, int] = field(default_factory=dict)
    open_pairs: dict[str, DataFrame | None] = field(default_factory=dict)
    vertices: dict[str, Parts] = field(default_factory=dict)


RAYS = "scene string, frame_id bigint, pt_id bigint, ox double, oy double, oz double, dx double, dy double, dz double, depth double"


def empty_state(spark: SparkSession) -> MapState:
    make = lambda schema: cut(spark.createDataFrame([], schema))
    home = f"{shared_dir(spark).rstrip('/')}/map-{uuid.uuid4().hex}"
    frame = "scene string, frame_id bigint"
    return MapState(home, make(frame), make("scene string, node bigint"), make(f"{frame}, samples bigint"), make(f"{frame}, node bigint"), make(RAYS))


def _grown(old: DataFrame, new: DataFrame) -> DataFrame:
    out = cut(old.unionByName(new.select(*old.columns)))
    free(old)
    return out


def next_key_frames(keys: DataFrame, key_voxels: DataFrame, seen: DataFrame, ratio: float) -> DataFrame:
    """W2 carried on: key frames (scene, frame_id) among the frames of ``seen`` that come after each scene's last key frame.

    The chain starts at that key frame (or, without one, at the first frame). A frame that arrives with a smaller number than the last key frame
    adds its voxels to the map but can no longer become a key frame.
    """
    last = keys.groupBy("scene").agg(F.max("frame_id").alias("_last"))
    start = key_voxels.join(last, "scene").where("frame_id = _last").select("scene", "frame_id", "node")
    later = seen.join(last, "scene", "left").where("_last IS NULL OR frame_id > _last").select("scene", "frame_id", "node")
    chain = keyframes.iou_key_frames(start.unionByName(later), ratio)
    return chain.join(last, "scene", "left").where("_last IS NULL OR frame_id > _last").select("scene", "frame_id")


def insert(state: MapState, points: DataFrame, poses: DataFrame, cfg: MapConfig, seen: DataFrame | None = None) -> tuple[MapState, DataFrame]:
    """One batch of frames of any scenes into the voxels, key frames and replay rays: (state, new frames).

    ``points`` (scene, frame_id, pt_id, x, y, z) are in the sensor frame, ``poses`` hold a pose per frame. ``seen`` (scene, frame_id, node) may
    be given instead of ``points`` and ``poses``: then there are no rays to replay.
    """
    if seen is None:
        poses = filters.finite_poses(poses)
        points = points.join(state.known, ["scene", "frame_id"], "left_anti")
        world = frames.world_points(points, poses)
        if cfg.low is not None:
            world = filters.crop_box(world, cfg.low, cfg.high)
        seen = V.occupied_voxels(world, cfg.res, cfg.depth, cfg.threshold, ("scene", "frame_id")).select("scene", "frame_id", "node")
    else:
        seen = seen.join(state.known, ["scene", "frame_id"], "left_anti")
    seen = cut(seen)
    new = cut(seen.select("scene", "frame_id").distinct())
    picked = cut(next_key_frames(state.keys, state.key_voxels, seen, cfg.insert_ratio))
    nodes = seen.select("scene", "node").distinct()
    missing = nodes.join(state.voxels, ["scene", "node"], "left_anti")
    state.voxels = _grown(state.voxels, missing)
    state.keys = _grown(state.keys, _with_start_counts(state.keys, picked))
    state.key_voxels = _grown(state.key_voxels, seen.join(picked, ["scene", "frame_id"], "left_semi"))
    if points is not None:
        state.replay = _grown(state.replay, frame_rays(points.join(picked, ["scene", "frame_id"], "left_semi"), poses))
    for scene, still in state.open_pairs.items():
        mine = state.key_voxels.where(F.col("scene") == scene)
        again = keyframes.reopen(still, mine, picked.where(F.col("scene") == scene))
        state.open_pairs[scene] = cut(again) if again is not None else None
        if still is not None:
            free(still)
    state.known = _grown(state.known, new)
    state.batch += 1
    free(seen, picked)
    return state, new


def _with_start_counts(keys: DataFrame, picked: DataFrame) -> DataFrame:
    """T5: a new key frame starts with sum // (frames + 2) samples; several of one batch do so one after the other, by frame."""
    before = keys.groupBy("scene").agg(F.count("*").alias("n"), F.sum("samples").alias("total"))
    lists = picked.groupBy("scene").agg(F.sort_array(F.collect_list("frame_id")).alias("ids")).join(before, "scene", "left")
    # The frames of one batch and scene.
    step = """aggregate(ids, named_struct('n', coalesce(n, 0L), 'total', coalesce(total, 0L), 'out', cast(array() AS array<struct<frame_id: bigint, samples: bigint>>)),
        (s, f) -> named_struct('n', s.n + 1, 'total', s.total + s.total DIV (s.n + 2), 'out', concat(s.out, array(named_struct('frame_id', f, 'samples', s.total DIV (s.n + 2))))), s -> s.out)"""
    return lists.select("scene", F.explode(F.expr(step)).alias("r")).select("scene", "r.frame_id", "r.samples")


def train(
    state: MapState, scene: str, new: DataFrame, points: DataFrame, poses: DataFrame, cfg: MapConfig, inverse: bool = False,
    on_start: Callable[[MapState, str], bool] | None = None, on_step: Callable[[int, DataFrame], None] | None = None, on_end: Callable[[MapState, str], None] | None = None,
) -> MapState:
    """Fit one scene after ``insert``: a covering window of all its key frames and the newest frame give rays by quota (T4, T5, U1), samples inside
    the bounds and the map (F8) give pulls, and the vertices around them move.

    ``on_start(state, scene)`` may return False: the batch stays inserted, but nothing is fitted (V3). ``on_step(step, losses)`` gets the losses of each
    step, ``on_end(state, scene)`` the finished state.
    """
    ids = [r["frame_id"] for r in new.where(F.col("scene") == scene).orderBy("frame_id").collect()]  # one batch's frames
    if not ids or (on_start and not on_start(state, scene)):
        return state
    spark = new.sparkSession
    poses = filters.finite_poses(poses)
    held = state.known.where(F.col("scene") == scene).count() - len(ids)
    steps = sum(fit.iteration_schedule(held + i, first_steps=cfg.steps) for i in range(len(ids)))
    keys = state.keys.where(F.col("scene") == scene)
    picks, still = keyframes.greedy_cover(state.key_voxels.where(F.col("scene") == scene), cfg.window, state.open_pairs.get(scene))
    state.open_pairs[scene] = still
    chosen = keys.join(picks.select("frame_id").distinct(), "frame_id", "left_semi").select("frame_id", "samples")
    chosen = keyframes.with_current(chosen, spark.createDataFrame([(ids[-1], 0)], "frame_id bigint, samples bigint"))
    quota = cut(sampling.split_quota(chosen, cfg.rays, inverse).select("frame_id", "quota"))
    asked = state.keys.join(quota.select(F.lit(scene).alias("scene"), "frame_id", "quota"), ["scene", "frame_id"], "left")
    counted = cut(asked.select("scene", "frame_id", (F.col("samples") + F.coalesce("quota", F.lit(0))).alias("samples")))
    free(state.keys)
    state.keys = counted
    current = points.where((F.col("scene") == scene) & (F.col("frame_id") == ids[-1]))
    rays = state.replay.where((F.col("scene") == scene) & (F.col("frame_id") != ids[-1])).unionByName(frame_rays(current, poses).select(*state.replay.columns))
    drawn = sampling.take_random(rays.join(quota, "frame_id"), "quota", ("frame_id",), seed=state.batch)
    drawn = cut(drawn.withColumn("ray_id", F.shiftleft(F.col("frame_id"), 32) + F.col("pt_id")))
    samples = cut(R.ray_samples(drawn, cfg.n_stratified, cfg.n_perturbed, cfg.depth_min, cfg.depth_max, cfg.margin, cfg.sigma, seed=state.batch))
    nodes = cut(scene_nodes(state, scene, cfg))
    low, high = cfg.low or (-float("inf"),) * 3, cfg.high or (float("inf"),) * 3
    labelled = cut(FD.valid_samples(R.sdf_labels(samples), nodes, cfg.res, cfg.depth, low, high))
    free(drawn, samples, quota)

    table = state.vertices.setdefault(scene, Parts(spark, f"{state.home}/vertices-{uuid.uuid4().hex}", STORED))
    at = state.steps.get(scene, 0)
    corners = V.voxel_corners(labelled.select("node").distinct(), cfg.depth, separate_leaves=cfg.separate_leaves)
    parts = cut(corners.select(part_of().alias("part")).distinct())
    wanted = fit.initial_vertices(nodes, cfg.depth, cfg.separate_leaves).withColumn("part", part_of()).join(parts, "part", "left_semi")
    had = cut(fit.idle_steps(table.get(parts), at, cfg.rate))
    fresh = wanted.join(had.select("ns", "vx", "vy", "vz"), ["ns", "vx", "vy", "vz"], "left_anti")
    fresh = fresh.withColumns({f"{m}_{c}": F.lit(0.0) for c in PARAMS for m in "mv"}).withColumn("at", F.lit(at))
    start = cut(had.select(*fresh.columns).unionByName(fresh))
    moved = fit.fit_vertices(
        labelled.drop("node"), nodes, start, cfg.res, cfg.depth, steps, cfg.rate, cfg.losses, separate_leaves=cfg.separate_leaves, on_step=on_step, done=at, moments=True
    )
    state.steps[scene] = at + steps
    moved = moved.withColumn("at", F.lit(at + steps)).withColumn("part", part_of())
    names = [f.name for f in table.get().schema]
    table.put(moved.select(*[F.col(c).cast("int").alias(c) if c in ("vx", "vy", "vz") else F.col(c) for c in names]))
    free(parts, had, start, labelled, nodes)
    if on_end:
        on_end(state, scene)
    return state


def scene_nodes(state: MapState, scene: str, cfg: MapConfig) -> DataFrame:
    """The voxel table of one scene, completed below the full depth (O1, O2)."""
    leaves = state.voxels.where(F.col("scene") == scene).select("node")
    return V.semi_sparse(V.build_nodes(leaves, cfg.depth), cfg.depth, cfg.full_depth).select("node")


def scene_vertices(state: MapState, scene: str, cfg: MapConfig) -> DataFrame:
    """Every vertex of a scene where the last step left it; those that no batch has reached are at zero."""
    table = state.vertices.get(scene)
    start = fit.initial_vertices(scene_nodes(state, scene, cfg), cfg.depth, cfg.separate_leaves)
    if table is None:
        return start
    held = fit.idle_steps(table.get(), state.steps.get(scene, 0), cfg.rate).select("ns", "vx", "vy", "vz", *PARAMS)
    return held.unionByName(start.join(held.select("ns", "vx", "vy", "vz"), ["ns", "vx", "vy", "vz"], "left_anti").select(*held.columns))


def snapshot(state: MapState, scene: str, cfg: MapConfig) -> Map:
    """The map of one scene as it is now, for queries, meshes and publication."""
    nodes = cut(scene_nodes(state, scene, cfg))
    mine = lambda df: df.where(F.col("scene") == scene)
    return Map(nodes, cut(scene_vertices(state, scene, cfg)), mine(state.key_voxels), mine(state.keys).select("scene", "frame_id"), mine(state.replay))


def update(state: MapState, points: DataFrame, poses: DataFrame, cfg: MapConfig, **hooks) -> MapState:
    """One batch: insert its frames, then fit every scene it holds. Usable as the body of ``foreachBatch``."""
    state, new = insert(state, points, poses, cfg)
    for scene in sorted(r["scene"] for r in new.select("scene").distinct().collect()):  # scenes of one batch
        state = train(state, scene, new, points, poses, cfg, **hooks)
    free(new)
    return state
