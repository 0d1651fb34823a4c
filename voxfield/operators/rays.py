"""Rays against the voxel table: traversal, hits, occupancy, and samples along rays."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.functions import keys as K
from voxfield.functions import shapes as S
from voxfield.functions.hashing import uniform
from voxfield.operators.filters import valid_rays
from voxfield.session import cut, spread

AXES = K.AXES


def with_ends(rays: DataFrame, dims: int = 3) -> DataFrame:
    """Add the end point ex, ey(, ez) = origin + depth * direction."""
    return rays.withColumns({f"e{a}": F.col(f"o{a}") + F.col("depth") * F.col(f"d{a}") for a in AXES[:dims]})


def traverse(
    rays: DataFrame, res: float, depth: int, ray_id: str = "ray_id", dims: int = 3, carry: Sequence[str] = ()
) -> DataFrame:
    """Cells a ray passes in order: (ray_id, pos, kx, ky(, kz)) and the integer columns ``carry``.

    The first cell is in, the last one out; a ray within one cell or with an end outside the key range has
    no cells. Equal crossings go x before y before z. A whole Arrow batch of rays is merged at once, with no
    shuffle.
    """
    axes = AXES[:dims]
    cols = [f"o{a}" for a in axes] + [f"e{a}" for a in axes]
    rays = with_ends(rays, dims).select(
        *[F.col(c).cast("bigint").alias(c) for c in (ray_id, *carry)], *cols
    )
    off, top = 1 << (depth - 1), (1 << depth) - 1
    named = [ray_id, *carry]
    schema = ", ".join([f"{c} bigint" for c in named] + ["pos int"] + [f"k{a} bigint" for a in axes])

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            start = pdf[[f"o{a}" for a in axes]].to_numpy(float)
            end = pdf[[f"e{a}" for a in axes]].to_numpy(float)
            ok = np.isfinite(start).all(1) & np.isfinite(end).all(1)
            ids, start, end = pdf[named].to_numpy(np.int64)[ok], start[ok], end[ok]
            k0 = np.floor(start / res).astype(np.int64) + off
            k1 = np.floor(end / res).astype(np.int64) + off
            ok = ((k0 >= 0) & (k0 <= top) & (k1 >= 0) & (k1 <= top)).all(1)
            ids, start, end, k0, k1 = ids[ok], start[ok], end[ok], k0[ok], k1[ok]
            sign = np.sign(k1 - k0)
            n = np.abs(k1 - k0)
            ray, axis, when = [], [], []
            for a in range(dims):
                r = np.repeat(np.arange(len(ids)), n[:, a])
                nth = np.arange(len(r)) - np.repeat(np.cumsum(n[:, a]) - n[:, a], n[:, a])
                # Planes are entered upwards at key + 1, downwards at the key itself.
                plane = np.where(sign[r, a] > 0, k0[r, a] + 1 + nth, k0[r, a] - nth)
                span = end[r, a] - start[r, a]
                ray.append(r)
                axis.append(np.full(len(r), a))
                when.append(((plane - off) * res - start[r, a]) / span)
            ray, axis, when = np.concatenate(ray), np.concatenate(axis), np.concatenate(when)
            order = np.lexsort((axis, when, ray))
            ray, axis = ray[order], axis[order]
            total = n.sum(1)
            first = np.repeat(np.cumsum(total) - total, total)
            out = {c: ids[ray, i] for i, c in enumerate(named)}
            out["pos"] = (np.arange(len(ray)) - first).astype(np.int32)
            for a, name in enumerate(axes):
                moves = np.where(axis == a, sign[ray, a], 0)
                before = np.cumsum(moves) - moves
                out[f"k{name}"] = k0[ray, a] + before - (before[first] if len(ray) else 0)
            yield pd.DataFrame(out)

    return spread(rays).mapInPandas(walk, schema)


def traverse_centres(rays: DataFrame, res: float, depth: int, ray_id: str = "ray_id") -> DataFrame:
    """Centres of the passed cells."""
    cells = traverse(rays, res, depth, ray_id)
    return cells.select(ray_id, "pos", *[K.voxel_centre(F.col(f"k{a}"), 0, res, depth).alias(f"c{a}") for a in AXES])


def passed_nodes(
    rays: DataFrame, res: float, depth: int, ray_id: str = "ray_id", dims: int = 3, carry: Sequence[str] = ()
) -> DataFrame:
    """P18 with leaf codes instead of keys."""
    cells = traverse(rays, res, depth, ray_id, dims, carry)
    return cells.select(ray_id, *carry, "pos", K.location_code(K.key_columns(dims), depth).alias("node"))


def first_hit(rays: DataFrame, occupied: DataFrame, res: float, depth: int, ray_id: str = "ray_id") -> DataFrame:
    """The first occupied leaf on each ray: (ray_id, pos, node). Rays that meet none are absent."""
    met = passed_nodes(rays, res, depth, ray_id).join(occupied.select("node"), "node")
    return met.groupBy(ray_id).agg(F.min(F.struct("pos", "node")).alias("_b")).select(ray_id, "_b.pos", "_b.node")


SENT = 100_000  # boxes of a level, or of a whole tree, that every task may hold
RAYS = 1 << 16  # rays of a task: its hits are sorted by partition in memory
SLICE, PAIRS = 1024, 1 << 20  # rays that walk down together, and pairs (ray, box) held at once


def _walk_whole(rays: DataFrame, boxes: DataFrame, ray_id: str, bidirectional: bool, max_range: float) -> DataFrame:
    """(ray_id, node, d1, d2) of the lines of ``rays`` and the leaves that they meet in a tree that every task holds.

    Slices of rays go down from node 1 together and keep what ``ray_nodes`` keeps: axes without an inverse direction are tested by place, the
    slack only keeps a few more. Distances are those of ``shapes.ray_box``; a missing coordinate leaves its axis out.
    """
    geo = [f"{p}{a}" for p in ("o", "d") for a in AXES]
    tree = boxes.filter("node is not null").select("node", "half", *[f"c{a}" for a in AXES]).toArrow().sort_by("node")
    node, half, *mid = (tree.column(c).to_numpy() for c in ("node", "half", *[f"c{a}" for a in AXES]))
    first, last = np.searchsorted(node, node * 8), np.searchsorted(node, node * 8 + 8)
    roots = np.flatnonzero(node == 1)
    far = max_range + 1e-9 * (1.0 + max_range) if max_range > 0 else np.inf
    back = far if bidirectional else min(far, 1e-9)

    def meets(o, d, who, at):
        into, out, on = np.full(len(who), -np.inf), np.full(len(who), np.inf), np.ones(len(who), bool)
        h, inv = half[at], np.where(d == 0, np.nan, 1.0 / d)
        for a in range(3):
            gap, i = mid[a][at] - o[a][who], inv[a][who]
            on &= ~np.isnan(i) | (np.abs(gap) <= h)
            gap *= i
            width = h * np.abs(i)
            np.fmax(into, gap - width, out=into)
            np.fmin(out, gap + width, out=out)
        return on & (out - into >= -1e-9 * (1.0 + np.abs(into) + np.abs(out))) & ~np.isinf(into) & (into <= far) & (out >= -back)

    def walk(o, d):
        n = o.shape[1]
        who, at = np.repeat(np.arange(n), len(roots)), np.tile(roots, n)
        found = [(who[:0], at[:0])]
        while len(who):
            on = meets(o, d, who, at)
            who, at = who[on], at[on]
            kids = last[at] - first[at]
            found.append((who[kids == 0], at[kids == 0]))
            if kids.sum() > PAIRS and n > 1:
                (w, k), (v, l) = (walk(o[:, part], d[:, part]) for part in (slice(n // 2), slice(n // 2, n)))
                return np.r_[w, v + n // 2], np.r_[k, l]
            at = np.repeat(first[at] - np.cumsum(kids) + kids, kids) + np.arange(kids.sum())
            who = np.repeat(who, kids)
        return tuple(np.concatenate(x) for x in zip(*found))

    def distances(o, d):
        near, away, outside = -np.inf, np.inf, False
        for a in range(3):
            low, high = mid[a][d[3]] - half[d[3]], mid[a][d[3]] + half[d[3]]
            t = [np.where(o[a] == side, 0.0, np.where(d[a] == 0, np.where(side > o[a], np.inf, -np.inf), (side - o[a]) / d[a])) for side in (low, high)]
            near, away = np.fmax(near, np.fmin(*t)), np.fmin(away, np.fmax(*t))
            outside = outside | (o[a] < low) | (o[a] > high)
        ahead = outside & (near >= 0)
        return away >= near, np.where(ahead, near, away), np.where(ahead, away, near)

    def run(batches):
        for batch in batches:
            g = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in geo])
            for i in range(0, g.shape[1], SLICE):
                o, d = g[:3, i : i + SLICE], g[3:, i : i + SLICE]
                with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
                    who, at = walk(o, d)
                    hit, d1, d2 = distances(o[:, who], [*d[:, who], at])
                columns = [batch.column(ray_id).take(pa.array(who[hit] + i)), *(pa.array(x[hit]) for x in (node[at], d1, d2))]
                yield pa.RecordBatch.from_arrays(columns, names=[ray_id, "node", "d1", "d2"])

    tasks = -(-rays.count() // RAYS)
    rays = rays.repartition(tasks, ray_id) if tasks > rays.rdd.getNumPartitions() else rays
    return rays.select(ray_id, *geo).mapInArrow(run, f"`{ray_id}` {rays.schema[ray_id].dataType.simpleString()}, node bigint, d1 double, d2 double")


def ray_nodes(
    rays: DataFrame,
    nodes: DataFrame,
    res: float,
    depth: int,
    ray_id: str = "ray_id",
    leaves_only: bool = True,
    bidirectional: bool = False,
    max_range: float = 0.0,
    pad: float = 0.0,
) -> DataFrame:
    """Voxels met by the endless line of each ray: (ray_id, node, d1, d2), d1 as in ``shapes.ray_box``.

    Rays walk down the voxel table level by level, each step an equi-join on the parent, keeping only boxes
    that the line meets (grown by ``pad``). Without ``bidirectional`` boxes behind the origin are dropped.
    A level of few boxes is sent to the rays: shuffled, all rays of the upper levels would meet in a few tasks. A whole tree of few boxes is
    walked in one job, and nothing is written on the way.
    """
    from voxfield.operators.voxelmap import describe_nodes

    geo = [f"{p}{a}" for p in ("o", "d") for a in AXES]
    ray = [ray_id, *geo, *[f"i{a}" for a in AXES]]
    inner = nodes.filter(F.col("node") > 1).select(K.ancestor(F.col("node"), 1).alias("node")).distinct()
    boxes = describe_nodes(nodes.select("node"), res, depth).join(inner.withColumn("_in", F.lit(True)), "node", "left")
    box = [*[f"c{a}" for a in AXES], "half"]
    boxes = boxes.select("node", F.col("_in").isNull().alias("leaf"), "cx", "cy", "cz", (F.col("half") + F.lit(pad)).alias("half"))
    boxes = cut(boxes.withColumn("parent", K.ancestor(F.col("node"), 1)))
    sizes = {r["d"]: r["n"] for r in boxes.groupBy(K.node_depth(F.col("node")).alias("d")).agg(F.count("*").alias("n")).collect()}

    # Entry and exit of the line through the slabs from its inverse direction; a NULL inverse (a line along
    # the slab) drops out of greatest/least and is tested by place. The slack only keeps a few more rows.
    into = F.greatest(*[(F.col(f"c{a}") - F.col(f"o{a}")) * F.col(f"i{a}") - F.col("half") * F.abs(f"i{a}") for a in AXES])
    out_of = F.least(*[(F.col(f"c{a}") - F.col(f"o{a}")) * F.col(f"i{a}") + F.col("half") * F.abs(f"i{a}") for a in AXES])
    beside = F.lit(True)
    for a in AXES:
        beside = beside & (F.col(f"i{a}").isNotNull() | (F.abs(F.col(f"c{a}") - F.col(f"o{a}")) <= F.col("half")))

    def meets(df: DataFrame) -> DataFrame:
        df = df.withColumn("_in", into).withColumn("_out", out_of)
        near = F.col("_out") - F.col("_in") >= -1e-9 * (1.0 + F.abs("_in") + F.abs("_out"))
        kept = df.filter(beside & near)
        kept = kept if bidirectional else kept.filter(F.col("_out") >= -1e-9)
        return kept.select(*ray, "node", "leaf", *box)

    def kept_hits(hits: DataFrame) -> DataFrame:
        hits = hits.filter(F.col("d1").isNotNull())
        if not bidirectional:
            hits = hits.filter(F.col("d1") >= 0)
        if max_range > 0:
            hits = hits.filter(F.abs("d1") <= max_range)
        return hits.select(ray_id, "node", "d1", "d2")

    start = cut(spread(rays.select(ray_id, *geo)))
    if leaves_only and sum(sizes.values()) <= SENT:
        return kept_hits(_walk_whole(start, boxes, ray_id, bidirectional, max_range))
    start = start.select("*", *[G.safe_div(F.lit(1.0), F.col(f"d{a}")).alias(f"i{a}") for a in AXES])
    start = start.withColumn("node", F.lit(1).cast("bigint"))
    level = meets(start.join(F.broadcast(boxes.filter(F.col("node") == 1).drop("parent")), "node"))
    step = boxes.select(F.col("parent").alias("_p"), "node", "leaf", *box)

    def below(d: int) -> DataFrame:
        kids = step.filter(F.col("node").between(1 << 3 * (d + 1), (1 << 3 * (d + 2)) - 1))
        return F.broadcast(kids) if sizes.get(d + 1, 0) <= SENT else kids

    done: DataFrame | None = None
    for d in range(depth + 1):
        # Two levels per written table.
        level = cut(level) if d % 2 == 0 else level
        found = level.filter("leaf") if leaves_only else level
        done = found if done is None else done.unionByName(found)
        inner_rows = level.filter(~F.col("leaf")).select(*ray, F.col("node").alias("_p"))
        if d == depth or (d % 2 == 0 and inner_rows.isEmpty()):
            break
        level = meets(inner_rows.join(below(d), "_p").drop("_p"))
    low = [F.col(f"c{a}") - F.col("half") for a in AXES]
    high = [F.col(f"c{a}") + F.col("half") for a in AXES]
    d1, d2, hit, _ = S.ray_box([F.col(c) for c in geo[:3]], [F.col(c) for c in geo[3:]], low, high)
    # Written before the filters, which would work the distances out anew for every condition.
    return kept_hits(cut(done.select(ray_id, "node", d1.alias("d1"), d2.alias("d2"))))


def order_on_ray(hits: DataFrame, ray_id: str = "ray_id") -> DataFrame:
    """Boxes ahead by distance, then boxes behind by distance. One window per ray."""
    # Dealt before the window adds its keys to every row.
    hits = hits.repartition(ray_id)
    w = Window.partitionBy(ray_id).orderBy((F.col("d1") < 0), F.abs("d1"), "node")
    return hits.withColumn("rank", F.row_number().over(w))


# -- A17, A18: occupancy ---------------------------------------------------------------------------

FOLD = 1024  # updates folded per array


def log_odds(p: float) -> float:
    return math.log(p / (1.0 - p))


def scan_updates(rays: DataFrame, res: float, depth: int, hit: float, miss: float, dims: int = 3) -> DataFrame:
    """One log-odds update per (frame, cell): a hit if any ray of the scan ends there, else a miss."""
    ends = with_ends(rays, dims)
    keys = [K.point_key(F.col(f"e{a}"), res, depth) for a in AXES[:dims]]
    for a, k in zip(AXES, keys):
        ends = ends.withColumn(f"k{a}", k).filter(F.col(f"k{a}").between(0, (1 << depth) - 1))
    hits = ends.select("frame_id", K.location_code(K.key_columns(dims), depth).alias("node"), F.lit(1).alias("hit"))
    passed = passed_nodes(rays, res, depth, dims=dims, carry=("frame_id",))
    misses = passed.select("frame_id", "node", F.lit(0).alias("hit"))
    seen = hits.unionByName(misses).groupBy("frame_id", "node").agg(F.max("hit").alias("hit"))
    delta = F.when(F.col("hit") == 1, F.lit(log_odds(hit))).otherwise(F.lit(log_odds(miss)))
    return seen.select("frame_id", "node", delta.alias("delta"))


def fuse_updates(updates: DataFrame, low: float, high: float, order: str = "frame_id") -> DataFrame:
    """Clamped log-odds per cell, updates applied in ``order`` from 0: (node, value).

    A clamped addition is x -> min(max(x + a, lo), hi), and two of them in a row are again of that form, so
    the updates of a cell fold in blocks of bounded length, then the blocks fold, however many scans saw it.
    """
    updates = cut(updates)  # read twice: for the last frame, and to fold
    span = updates.agg(F.max(order)).first()[0] or 0
    steps = updates.select(
        "node", F.col(order).cast("bigint").alias("_o"), F.col("delta").alias("a"), F.lit(low).alias("lo"), F.lit(high).alias("hi")
    )

    def clamp(v: Column, s: Column) -> Column:
        return F.least(F.greatest(v, s["lo"]), s["hi"])

    def then(f: Column, g: Column) -> Column:
        return F.struct(
            (f["a"] + g["a"]).alias("a"), clamp(f["lo"] + g["a"], g).alias("lo"), clamp(f["hi"] + g["a"], g).alias("hi")
        )

    inf = float("inf")
    same = F.struct(F.lit(0.0).alias("a"), F.lit(-inf).alias("lo"), F.lit(inf).alias("hi"))
    while True:
        steps = steps.withColumn("_b", F.floor(F.col("_o") / F.lit(FOLD)).cast("bigint"))
        packed = steps.groupBy("node", "_b").agg(F.array_sort(F.collect_list(F.struct("_o", "a", "lo", "hi"))).alias("_l"))
        folded = packed.select("node", F.col("_b").alias("_o"), F.aggregate("_l", same, then).alias("_f"))
        steps = folded.select("node", "_o", "_f.*")
        span //= FOLD
        if span == 0:
            break
    value = F.least(F.greatest(F.col("a"), F.col("lo")), F.col("hi"))
    return steps.select("node", value.alias("value"))


def probability(value: Column) -> Column:
    return F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + F.exp(value))


def most_likely(cells: DataFrame, low: float, high: float, threshold: float = 0.0) -> DataFrame:
    """Every cell set to the clamping bound on its side of the threshold."""
    return cells.withColumn("value", F.when(F.col("value") > threshold, F.lit(high)).otherwise(F.lit(low)))


def inner_occupancy(cells: DataFrame, depth: int, dims: int = 3) -> DataFrame:
    """Value of every ancestor = the largest below it, by one roll-up over (node, ancestor)."""
    from voxfield.operators.voxelmap import with_ancestors

    return with_ancestors(cells.select("node", "value"), dims=dims).groupBy("node").agg(F.max("value").alias("value"))


def classify_cells(cells: DataFrame, depth: int, low: Sequence[int], high: Sequence[int], threshold: float = 0.0) -> DataFrame:
    """Numbers of occupied, free and unexplored cells of a planar key box."""
    inside = _planar(cells, depth, low, high)
    total = (high[0] - low[0] + 1) * (high[1] - low[1] + 1)
    counts = inside.agg(
        F.sum(F.when(F.col("value") > threshold, 1).otherwise(0)).alias("occupied"),
        F.sum(F.when(F.col("value") <= threshold, 1).otherwise(0)).alias("free"),
    )
    known = F.coalesce(F.col("occupied"), F.lit(0)) + F.coalesce(F.col("free"), F.lit(0))
    return counts.select(F.coalesce("occupied", F.lit(0)).alias("occupied"), F.coalesce("free", F.lit(0)).alias("free"), (F.lit(total) - known).alias("unexplored"))


def _planar(cells: DataFrame, depth: int, low: Sequence[int], high: Sequence[int]) -> DataFrame:
    out = cells.select("*", *[k.alias(f"k{a}") for a, k in zip("xy", K.leaf_keys(F.col("node"), depth, 2))])
    return out.filter(F.col("kx").between(low[0], high[0]) & F.col("ky").between(low[1], high[1]))


def frontier_cells(cells: DataFrame, depth: int, low: Sequence[int], high: Sequence[int], threshold: float = 0.0) -> DataFrame:
    """Free cells with an unexplored face neighbour inside the box: (kx, ky)."""
    known = _planar(cells, depth, low, high)
    free = known.filter(F.col("value") <= threshold).select("kx", "ky")
    around = K.explode_neighbours(free, depth, 2)
    around = around.filter(F.col("nx").between(low[0], high[0]) & F.col("ny").between(low[1], high[1]))
    seen = known.select(F.col("kx").alias("nx"), F.col("ky").alias("ny"))
    return around.join(seen, ["nx", "ny"], "left_anti").select("kx", "ky").distinct()


# -- R1-R5: samples along rays ---------------------------------------------------------------------


def ray_samples(
    rays: DataFrame,
    n_stratified: int = 1,
    n_perturbed: int = 2,
    depth_min: float = 0.0,
    depth_max: float = float("inf"),
    margin: float = 0.0,
    sigma: float = 0.1,
    seed: int = 0,
) -> DataFrame:
    """Samples of every valid ray in the order stratified, perturbed, surface.

    (ray_id, s_idx, kind, t, x, y, z, behind). Stratified: one draw in each of n equal bins of
    [depth_min, depth - margin]; perturbed: the first half in [-3 sigma, -sigma] around the surface, the
    rest in [sigma, 3 sigma] behind it; then the surface itself.
    """
    rays = valid_rays(rays, depth_min, depth_max, margin)
    total = n_stratified + n_perturbed + 1
    before = n_perturbed // 2
    out = spread(rays).withColumn("s_idx", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    i, d = F.col("s_idx"), F.col("depth")
    out = out.withColumn("_u", uniform(F.col("ray_id"), F.col("s_idx"), seed))
    u = F.col("_u")
    width = (d - F.lit(margin) - F.lit(depth_min)) / F.lit(float(max(n_stratified, 1)))
    t = (
        F.when(i < n_stratified, F.lit(depth_min) + (i + u) * width)
        .when(i < n_stratified + before, d + F.lit(-3.0 * sigma) + u * F.lit(2.0 * sigma))
        .when(i < n_stratified + n_perturbed, d + F.lit(sigma) + u * F.lit(2.0 * sigma))
        .otherwise(d)
    )
    kind = F.when(i < n_stratified, "stratified").when(i < total - 1, "perturbed").otherwise("surface")
    behind = (i >= n_stratified + before) & (i < total - 1)
    out = out.withColumn("t", t)
    at = [(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(a) for a in AXES]
    return out.select("ray_id", "s_idx", kind.alias("kind"), "t", *at, behind.alias("behind"))


def step_samples(rays: DataFrame, step: float, depth_max: float = float("inf")) -> DataFrame:
    """Samples every ``step`` metres along each ray, from the first step up to its depth."""
    rays = valid_rays(rays, 0.0, depth_max, 0.0)
    n = F.floor(F.col("depth") / F.lit(step)).cast("bigint")
    out = rays.filter(F.col("depth") >= step).withColumn("s_idx", F.explode(F.sequence(F.lit(1).cast("bigint"), n)))
    at = [(F.col(f"o{a}") + F.col("s_idx") * F.lit(step) * F.col(f"d{a}")).alias(a) for a in AXES]
    return out.select("ray_id", "s_idx", *at)


def hit_samples(rays: DataFrame, n: int, radius: float, seed: int = 0) -> DataFrame:
    """N points spread uniformly in the cube of half width ``radius`` around each ray's end point."""
    out = with_ends(rays).withColumn("s_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    draw = lambda j: uniform(F.col("ray_id"), F.col("s_idx") * 3 + j, seed) * F.lit(2.0 * radius) - F.lit(radius)
    return out.select("ray_id", "s_idx", *[(F.col(f"e{a}") + draw(j)).alias(a) for j, a in enumerate(AXES)])


def map_samples(voxels: DataFrame, res: float, depth: int, per_voxel: int, seed: int = 0) -> DataFrame:
    """Uniform random positions inside the mapped leaf voxels, ``per_voxel`` each."""
    from voxfield.operators.voxelmap import describe_nodes

    boxes = describe_nodes(voxels.select("node"), res, depth)
    out = boxes.withColumn("s_idx", F.explode(F.sequence(F.lit(0), F.lit(per_voxel - 1))))
    draw = lambda j: (uniform(F.col("node"), F.col("s_idx") * 3 + j, seed) * 2.0 - 1.0) * F.col("half")
    return out.select("node", "s_idx", *[(F.col(f"c{a}") + draw(j)).alias(a) for j, a in enumerate(AXES)])


def sdf_labels(samples: DataFrame, surface: DataFrame | None = None) -> DataFrame:
    """Label of each sample = distance to the nearest surface sample (and extra ``surface`` points),
    negative behind the surface; 0 on it. Adds ``label``."""
    from voxfield.operators.nearest import nearest_points

    # Only the distance is used, so targets need no ids of their own.
    samples = samples.withColumn("_q", F.struct("ray_id", "s_idx"))
    targets = samples.filter(F.col("kind") == "surface").select(F.lit(0).alias("_t"), *AXES)
    if surface is not None:
        targets = targets.unionByName(surface.select(F.lit(0).alias("_t"), *AXES))
    asked = samples.filter(F.col("kind") != "surface")
    near = nearest_points(asked.select("_q", *AXES), targets, "_q", "_t").select("_q", "dist")
    out = samples.join(near, "_q", "left").drop("_q")
    label = F.when(F.col("kind") == "surface", F.lit(0.0)).when(F.col("behind"), -F.col("dist")).otherwise(F.col("dist"))
    return out.withColumn("label", label).drop("dist")
