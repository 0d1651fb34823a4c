"""Entry points: batch mapping and evaluation. Mapping batch by batch is in ``incremental``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.operators import field as FD
from voxfield.operators import filters, frames, grids, keyframes, mesh, metrics, sampling, surface
from voxfield.operators import nearest as N
from voxfield.operators import rays as R
from voxfield.operators import voxelmap as V
from voxfield.plans import fit
from voxfield.session import cut
from voxfield.sources import writers


@dataclass
class MapConfig:
    """Sizes and rates of a mapping run."""

    res: float = 0.1
    depth: int = 8
    full_depth: int = 5
    threshold: int = 0
    separate_leaves: bool = False
    insert_ratio: float = 0.7
    window: int = 10
    rays: int = 20480
    n_stratified: int = 1
    n_perturbed: int = 2
    depth_min: float = 0.0
    depth_max: float = float("inf")
    margin: float = 0.1
    sigma: float = 0.1
    rate: float = 0.01
    steps: int = 10
    losses: fit.Losses = field(default_factory=fit.Losses)
    low: tuple[float, float, float] | None = None
    high: tuple[float, float, float] | None = None


@dataclass
class Map:
    """Tables of a finished map."""

    voxels: DataFrame
    vertices: DataFrame
    frame_voxels: DataFrame
    key_frames: DataFrame
    samples: DataFrame


def frame_rays(points: DataFrame, poses: DataFrame) -> DataFrame:
    """World rays of LiDAR points: origin at the sensor, unit direction, depth = range."""
    joined = frames.join_poses(points, poses)
    reach, direction = G.range_and_direction(G.vec("x", "y", "z"))
    origin, turned = G.ray_to_world(F.col("pose"), direction)
    named = [c.alias(f"o{a}") for a, c in zip("xyz", origin)] + [c.alias(f"d{a}") for a, c in zip("xyz", turned)]
    return joined.select("scene", "frame_id", "pt_id", *named, reach.alias("depth"))


def build_map(points: DataFrame, poses: DataFrame, cfg: MapConfig, on_step: Callable[[int, DataFrame], None] | None = None) -> Map:
    """Scans (scene, frame_id, pt_id, x, y, z in the sensor frame) and poses to a fitted field of one scene.

    World points fill the voxel table; frames that overlap too little with the last key frame become key
    frames; a covering window of them gives rays, samples and labels; the vertex field is fitted to those.
    """
    poses = filters.finite_poses(poses)
    world = frames.world_points(points, poses)
    if cfg.low is not None:
        world = filters.crop_box(world, cfg.low, cfg.high)
    seen = cut(V.occupied_voxels(world, cfg.res, cfg.depth, cfg.threshold, ("scene", "frame_id")).select("scene", "frame_id", "node"))
    voxels = cut(V.semi_sparse(V.build_nodes(seen, cfg.depth), cfg.depth, cfg.full_depth).select("node"))
    keys = cut(keyframes.iou_key_frames(seen, cfg.insert_ratio))
    key_sets = seen.join(keys, ["scene", "frame_id"], "left_semi")
    picks, _ = keyframes.greedy_cover(key_sets, cfg.window)
    chosen = picks.select("frame_id").distinct()
    quota = sampling.split_quota(chosen.withColumn("samples", F.lit(0)), cfg.rays).select("frame_id", "quota")
    # The window is a handful of frames.
    mine = points.join(F.broadcast(quota), "frame_id")
    drawn = sampling.take_random(mine, "quota", ("frame_id",)).drop("quota")
    rays = frame_rays(drawn, poses)
    rays = cut(rays.withColumn("ray_id", F.shiftleft(F.col("frame_id").cast("bigint"), 32) + F.col("pt_id")))
    samples = R.ray_samples(rays, cfg.n_stratified, cfg.n_perturbed, cfg.depth_min, cfg.depth_max, cfg.margin, cfg.sigma)
    samples = cut(R.sdf_labels(cut(samples)))
    low, high = cfg.low or (-float("inf"),) * 3, cfg.high or (float("inf"),) * 3
    samples = cut(FD.valid_samples(samples, voxels, cfg.res, cfg.depth, low, high).drop("node"))
    start = fit.initial_vertices(voxels, cfg.depth, cfg.separate_leaves)
    vertices = fit.fit_vertices(
        samples, voxels, start, cfg.res, cfg.depth, cfg.steps, cfg.rate, cfg.losses, separate_leaves=cfg.separate_leaves, on_step=on_step
    )
    return Map(voxels, vertices, seen, keys, samples)


def field_of(m: Map, cfg: MapConfig) -> Callable[[DataFrame], DataFrame]:
    """The map as a function points -> points with node, sdf and gradient (V1)."""
    corners = cut(FD.corner_rows(m.voxels, m.vertices, cfg.res, cfg.depth, cfg.separate_leaves))

    def query(points: DataFrame) -> DataFrame:
        return FD.compose(FD.query_sdf(points, corners, cfg.res, cfg.depth), prior_only=True)

    return query


def evaluate_field(
    test_set: DataFrame, field_fn: Callable[[DataFrame], DataFrame], angle_limit: float = 3.2, absolute: bool = False
) -> DataFrame:
    """Long metrics (field, region, metric, value) against a test set (i, j, k, x, y, z, truth, tx, ty, tz, region)."""
    got = field_fn(test_set).filter(F.col("sdf").isNotNull())
    errors = metrics.sdf_errors(got, ("sdf", "sdf_prior"), absolute=absolute)
    got = got.withColumn("angle", G.gradient_angle(G.vec("grad_x", "grad_y", "grad_z"), G.vec("tx", "ty", "tz")))
    kept = filters.comparable_gradients(got, F.col("sdf"), F.col("truth"), F.col("angle"), angle_limit)
    angles = metrics.gradient_errors(kept.withColumn("field", F.lit("sdf")))
    items = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("mae", "rmse")])
    long = errors.select("field", "region", F.explode(items).alias("_i")).select("field", "region", "_i.*")
    return long.unionByName(angles.select("field", "region", F.lit("angle").alias("metric"), F.col("angle").alias("value")))


def make_test_set(grid: DataFrame, corners: DataFrame, eps: float, near: tuple[float, float], extent: float, key: str = "id") -> DataFrame:
    """Ground truth of a grid from a closed mesh: signed distance, unit gradient by central differences, region."""
    sign = mesh.outward_sign(corners)
    truth = mesh.mesh_sdf(grid, corners, key).select(key, (F.col("sdf") * F.lit(sign)).alias("truth"))
    moved = G.offset_points(grid.select(key, "x", "y", "z"), eps)
    slot = F.col("axis") * 2 + F.when(F.col("side") > 0, 0).otherwise(1)
    moved = cut(moved.withColumn("_q", F.col(key) * 6 + slot))
    at = mesh.mesh_sdf(moved, corners, "_q").select("_q", (F.col("sdf") * F.lit(sign)).alias("_s"))
    at = moved.select("_q", key, "axis", "side").join(at, "_q")
    slopes = at.groupBy(key).agg(
        *[(F.sum(F.when(F.col("axis") == n, F.col("side") * F.col("_s"))) / F.lit(2 * eps)).alias(f"g{a}") for n, a in enumerate("xyz")]
    )
    unit = G.normalised(G.vec("gx", "gy", "gz"))
    slopes = slopes.select(key, *[c.alias(f"t{a}") for a, c in zip("xyz", unit)])
    out = grid.join(truth, key).join(slopes, key)
    return out.withColumn("region", filters.region(F.col("truth"), near[0], near[1], extent))


def evaluate_surface(prediction: DataFrame, truth: DataFrame, samples: int = 200_000, threshold: float = 0.05) -> DataFrame:
    """Surface metrics between two triangle tables (with corners), each sampled by area."""
    a = mesh.sample_surface(prediction, samples, 1).select("sample_id", "x", "y", "z")
    b = mesh.sample_surface(truth, samples, 2).select(F.col("sample_id").alias("other_id"), "x", "y", "z")
    return metrics.surface_metrics(N.both_ways(cut(a), cut(b), "sample_id", "other_id"), threshold)


def extract_mesh(m: Map, cfg: MapConfig, low, high, res: float, sizes: tuple[int, int] = (1, 2), iso: float = 0.0):
    """The iso-surface of a map: grid, vertex filter, query, surface: (vertices, triangles)."""
    shape = [grids.steps(l, h, res) for l, h in zip(low, high)]
    grid = grids.grid_3d(m.voxels.sparkSession, low, high, res)
    kept = FD.filtered_grid(grid, m.voxels, cfg.res, cfg.depth, *sizes, shape)
    return surface.iso_surface(cut(field_of(m, cfg)(kept).select("i", "j", "k", "sdf")), low, res, shape, iso=iso)


def publish_map(m: Map, cfg: MapConfig, path: str, x_cells: int, y_cells: int, res: float, pose=None) -> None:
    """The field on a plane around the sensor as one grid-map row and as a cloud."""
    plane = grids.sensor_plane(m.voxels.sparkSession, x_cells, y_cells, res, pose=pose)
    got = cut(field_of(m, cfg)(plane))
    writers.grid_map(got, x_cells, y_cells, res).write.mode("overwrite").parquet(f"{path}/grid_map")
    writers.field_cloud(got).write.mode("overwrite").parquet(f"{path}/cloud")
