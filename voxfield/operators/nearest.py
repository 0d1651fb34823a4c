"""Exact nearest-neighbour joins (J10-J13, J22, J23) without all-pairs work in any cell.

The target side becomes a bucket tree: points are reduced to distinct coordinates, cut into cells of a depth
that fits their number, and cells that are still too full are refined until they are not, so that a dense
spot (or a pile of copies) never makes a large bucket. A query row carries an upper bound on its distance
and keeps only tree nodes that could hold something closer; every step is an equi-join against a side that
is unique per node. The tables written between steps carry their true sizes, so small ones are broadcast
and large ones shuffled by the planner's own check.

Many target points are dealt to large leaves, so few that every task may hold their boxes. A query is shuffled to
the leaf around it, which gives a tight bound, and then only to the leaves within that bound. Inside a leaf, slices of
queries walk a tree of small boxes together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.functions import keys as K
from voxfield.functions import shapes as S
from voxfield.operators.voxelmap import deepest_of
from voxfield.session import cut, free, spread

AXES = "xyz"
TOP = 20  # finest depth of a 60-bit code
PER_CELL = 4  # wanted targets per cell
BUCKET = 32  # a cell with more targets than this is refined
SLACK = 1.0 + 1e-9  # keeps rounding from pruning an exact tie

#: Node columns: the tight box, and one location (``at_``) that really holds a target.
BOX = [f"{s}{a}" for a in AXES for s in ("lo_", "hi_", "at_")]
PICK = {"lo": F.min, "hi": F.max, "at": F.first}


def _extent(*sides: DataFrame) -> tuple[list[float], float]:
    """Origin and edge of the cube around all sides."""
    both = None
    for side in sides:
        part = side.agg(*[f(a).alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))])
        both = part if both is None else both.unionByName(part)
    row = both.agg(*[f(f"{n}{a}").alias(f"{n}{a}") for a in AXES for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if row["lox"] is None:
        return [0.0, 0.0, 0.0], 1.0
    low = [float(row[f"lo{a}"]) for a in AXES]
    edge = max(float(row[f"hi{a}"]) - l for a, l in zip(AXES, low))
    return low, edge * (1 + 1e-9) if edge > 0 else 1.0


def _keys(low: Sequence[float], edge: float, depth: int = TOP) -> list[Column]:
    scale = float(1 << depth) / edge
    cap = (1 << depth) - 1
    return [
        F.least(F.lit(cap), F.greatest(F.lit(0), F.floor((F.col(a) - F.lit(l)) * F.lit(scale)))).cast("bigint")
        for a, l in zip(AXES, low)
    ]


def _code(keys: Sequence[Column]) -> Column:
    return K.location_code(keys, TOP)


def _up(code: Column, depth: int) -> Column:
    return F.shiftright(code, 3 * (TOP - depth)) if depth < TOP else code


def _boxes(boxes: dict[str, Column]) -> list[Column]:
    return [PICK[name[:2]](c).alias(name) for name, c in boxes.items()]


def _base_depth(targets: DataFrame, per_cell: int) -> int:
    """Deepest level whose cells still hold several targets on average (one pass of small sketches)."""
    depths = range(1, TOP + 1)
    counts = [F.approx_count_distinct(_up(F.col("code"), d), 0.1).alias(f"c{d}") for d in depths]
    row = targets.agg(F.count("*").alias("n"), *counts).first()
    return max([d for d in depths if row[f"c{d}"] * per_cell <= row["n"]], default=1)


def _build(targets: DataFrame, boxes: dict[str, Column], per_cell: int = PER_CELL, bucket: int = BUCKET) -> tuple[DataFrame, DataFrame, int, int]:
    """Bucket tree over ``targets`` (with ``code``): (nodes, targets with ``node``, base depth, last depth).

    ``nodes``: node, parent, leaf flag and the tight box around everything below it.
    """
    base = _base_depth(targets, per_cell)
    depth, still = base, targets
    leaves: DataFrame | None = None
    placed: DataFrame | None = None
    while True:
        tagged = still.withColumn("node", _up(F.col("code"), depth))
        cells = cut(tagged.groupBy("node").agg(F.count("*").alias("n"), *_boxes(boxes)))
        full = cells.filter(F.col("n") > bucket)
        if depth >= TOP or full.isEmpty():
            full = None
        calm = cells if full is None else cells.filter(F.col("n") <= bucket)
        leaves = calm if leaves is None else leaves.unionByName(calm)
        here = tagged if full is None else tagged.join(full.select("node"), "node", "left_anti")
        placed = here if placed is None else placed.unionByName(here.select(placed.columns))
        if full is None:
            break
        still = cut(tagged.join(full.select("node"), "node", "left_semi").drop("node"))
        depth = min(TOP, depth + 1)
    up = F.explode(F.sequence(F.lit(0), K.node_depth(F.col("node"))))
    chain = leaves.select("node", *BOX, up.alias("_up"))
    chain = chain.select(K.ancestor(F.col("node"), F.col("_up")).alias("node"), (F.col("_up") == 0).alias("leaf"), *BOX)
    nodes = chain.groupBy("node").agg(F.max("leaf").alias("leaf"), *_boxes({b: F.col(b) for b in BOX}))
    nodes = cut(nodes.withColumn("parent", K.ancestor(F.col("node"), 1)))
    return nodes, placed, base, depth


def _near2() -> Column:
    """Squared distance from (x, y, z) to the node box."""
    parts = []
    for a in AXES:
        lo, hi = F.col(f"lo_{a}"), F.col(f"hi_{a}")
        d = F.greatest(lo - F.col(a), F.col(a) - hi, F.lit(0.0))
        parts.append(d * d)
    return parts[0] + parts[1] + parts[2]


def _sure2() -> Column:
    """Squared distance to the node's sample location: some target is at least this near."""
    parts = [(F.col(a) - F.col(f"at_{a}")) * (F.col(a) - F.col(f"at_{a}")) for a in AXES]
    return parts[0] + parts[1] + parts[2]


KEPT = ["qid", *AXES, "ub2", "node", "leaf"]


def _tighten(met: DataFrame, settled: Column | None = None) -> DataFrame:
    """Lower each query's bound by the nodes it meets, then drop the nodes beyond it; ``settled`` rows take no part."""
    settled = F.lit(False) if settled is None else settled
    met = met.withColumn("_near", _near2()).filter(settled | (F.col("_near") <= F.col("ub2") * SLACK))
    nearest = F.min(F.when(~settled, _sure2())).over(Window.partitionBy("qid"))
    met = met.withColumn("ub2", F.when(settled, F.col("ub2")).otherwise(F.least(F.col("ub2"), nearest)))
    return met.filter(settled | (F.col("_near") <= F.col("ub2") * SLACK))


STEPS = 2  # tree levels per written table
SENT = 100_000  # tree nodes that every task may hold, and a quarter of the targets


def _sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def _dealt(queries: DataFrame) -> DataFrame:
    """Dealt by query, over as many tasks as a shuffle has: few bytes here become many rows."""
    spark = queries.sparkSession
    return queries.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "qid")


def _descend(frontier: DataFrame, nodes: DataFrame, few: bool, levels: int) -> DataFrame:
    """Replace inner nodes by their children until only leaves are left, dropping nodes that are too far.

    Leaves step to themselves, so several levels run in one job; settled rows leave the loop after it. A tree of few
    nodes is sent to the queries: all ``levels`` are then one job over a frontier that is dealt by query already.
    """
    kids = nodes.select(F.col("parent").alias("node"), F.col("node").alias("child"), F.col("leaf").alias("child_leaf"), *BOX)
    own = nodes.filter("leaf").select("node", F.col("node").alias("child"), F.lit(True).alias("child_leaf"), *BOX)
    step = kids.unionByName(own)
    if few:
        for i in range(levels):
            frontier = frontier if i % STEPS else frontier.withColumn("settled", F.col("leaf"))
            met = frontier.select("qid", *AXES, "ub2", "node", "settled").join(F.broadcast(step), "node")
            frontier = _tighten(met, F.col("settled")).select("qid", *AXES, "ub2", F.col("child").alias("node"), F.col("child_leaf").alias("leaf"), "settled")
        return frontier.select("qid", *AXES, "ub2", "node")
    frontier = cut(frontier)
    done = frontier.filter("leaf")
    frontier = frontier.filter(~F.col("leaf"))
    while not frontier.isEmpty():
        for _ in range(STEPS):
            met = frontier.select("qid", *AXES, "ub2", "node").join(step, "node")
            frontier = _tighten(met).select("qid", *AXES, "ub2", F.col("child").alias("node"), F.col("child_leaf").alias("leaf"))
        frontier = cut(frontier)
        done = done.unionByName(frontier.filter("leaf"))
        frontier = frontier.filter(~F.col("leaf"))
    return done.select("qid", *AXES, "ub2", "node")


PER_LEAF = 8192  # wanted targets per large leaf
MANY = 2 * PER_LEAF  # target points from which both sides are dealt to large leaves
LEAVES = 4096  # large leaves at most, about: every task holds their boxes
DRAWN = 16  # targets per leaf that the cuts between the leaves come from
GROUP = 1 << 15  # queries of one leaf that a task holds
SLICE, PAIRS = 4096, 1 << 20  # queries that walk a tree of boxes together, and pairs (query, box) held at once
CELL, FAN = 16, 4  # items of a smallest box, and children of each other box


def _cuts(drawn: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Axis, value and children of each cut; a child below 0 is the leaf of that complement. Leaves hold ``most`` of the drawn points, if these differ."""
    axis, value, kids, n_leaves = [], [], [], 0
    todo = [(drawn, None)]
    while todo:
        p, above = todo.pop()
        gap = p.max(0) - p.min(0)
        if len(p) <= most or not gap.max() > 0:
            name, n_leaves = ~n_leaves, n_leaves + 1
        else:
            name, a = len(axis), int(gap.argmax())
            x = np.sort(p[:, a])
            at = x[(len(x) - 1) // 2]
            at = at if at < x[-1] else x[np.searchsorted(x, at) - 1]
            axis.append(a)
            value.append(at)
            kids.append([0, 0])
            todo += [(p[p[:, a] <= at], (name, 0)), (p[p[:, a] > at], (name, 1))]
        if above:
            kids[above[0]][above[1]] = name
    return np.array(axis, np.int64), np.array(value), np.array(kids, np.int64).reshape(-1, 2)


def _leaf_of(cuts: tuple[np.ndarray, np.ndarray, np.ndarray], p: np.ndarray) -> np.ndarray:
    axis, value, kids = cuts
    at = np.full(len(p), 0 if len(axis) else ~0)
    on = np.arange(len(p) if len(axis) else 0)
    while len(on):
        k = at[on]
        at[on] = kids[k, (p[on, axis[k]] > value[k]).astype(np.int64)]
        on = on[at[on] >= 0]
    return ~at


def _box_tree(low: np.ndarray, high: np.ndarray, cell: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Items (as rows of ``cell`` at most; some come twice to fill them), and lows and highs of the boxes on each level by parent: (2, 3, parent, FAN)."""
    n, steps = len(low), 0
    while n > cell * FAN**steps:
        steps += 1
    rows = FAN**steps
    item = np.arange(rows * -(-n // rows)) * n // (rows * -(-n // rows))
    mid = low + high
    halvings = steps * (FAN.bit_length() - 1)
    for i in range(halvings):
        part = mid[item].reshape(1 << i, -1, 3)
        a = (part.max(1) - part.min(1)).argmax(1)
        by = np.take_along_axis(part, a[:, None, None], 2)[:, :, 0]
        by = np.argpartition(by, by.shape[1] // 2, axis=1)
        item = np.take_along_axis(item.reshape(1 << i, -1), by, 1).ravel()
    levels = []
    for i in range(1, steps + 1):
        shape = (FAN ** (i - 1), FAN, -1, 3)
        levels.append(np.stack([low[item].reshape(shape).min(2), high[item].reshape(shape).max(2)]).transpose(0, 3, 1, 2).copy())
    return item.reshape(rows, -1), levels


def _gaps(level: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of points to the FAN boxes below ``at``."""
    out = 0.0
    for a in range(3):
        x = q[a][:, None]
        g = np.maximum(level[0, a][at] - x, x - level[1, a][at])
        np.maximum(g, 0.0, out=g)
        g *= g
        out = out + g
    return out


def _met(levels: list[np.ndarray], q: np.ndarray, bound: np.ndarray):
    """(query, smallest box) of every box within ``bound`` (squared) of a query, in the order of the queries; None if too many meet."""
    who, at = np.arange(q.shape[1]), np.zeros(q.shape[1], np.int64)
    for level in levels:
        if len(who) * FAN > PAIRS and q.shape[1] > 1:
            return None
        i, k = np.nonzero(_gaps(level, at, q[:, who]) <= bound[who][:, None])
        who, at = who[i], at[i] * FAN + k
    return who, at


def _parts(n: int):
    """Places of the queries, a slice at a time; a slice that is sent back goes on in halves."""
    todo = [(i, min(i + SLICE, n)) for i in range(0, n, SLICE)][::-1]
    while todo:
        a, b = todo.pop()
        if (yield a, b):
            todo += [((a + b) // 2, b), (a, (a + b) // 2)]
            yield


def _closest(q: np.ndarray, bound: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared distance, place) of the nearest of ``points`` within ``bound`` (squared), the first on ties; infinite and -1 without."""
    d2, place = np.full(q.shape[1], np.inf), np.full(q.shape[1], -1)
    item, levels = _box_tree(points, points, CELL)
    cells = [points[item, a] for a in range(3)]
    parts = _parts(q.shape[1])
    for a, b in parts:
        x = q[:, a:b]
        home = np.zeros(b - a, np.int64)
        for level in levels:
            home = home * FAN + _gaps(level, home, x).argmin(1)
        ub = np.minimum(bound[a:b], sum((x[k][:, None] - cells[k][home]) ** 2 for k in range(3)).min(1))
        met = _met(levels, x, ub * SLACK)
        if met is None or (len(met[0]) * item.shape[1] > 2 * PAIRS and b - a > 1):
            parts.send(True)
            continue
        who, at = met
        if not len(who):
            continue
        e = [x[k][who][:, None] - cells[k][at] for k in range(3)]
        d = e[0] * e[0] + e[1] * e[1] + e[2] * e[2]
        heads = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
        low = np.minimum.reduceat(d.min(1), heads)
        first = np.where(d == np.repeat(low, np.diff(np.r_[heads, len(who)]))[:, None], item[at], len(points)).min(1)
        on = low <= bound[a + who[heads]]
        to = a + who[heads][on]
        d2[to], place[to] = low[on], np.minimum.reduceat(first, heads)[on]
    return d2, place


def _leaves_met(tree: tuple[np.ndarray, list[np.ndarray]], q: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, leaf) of every leaf box within ``bound`` (squared), sorted."""
    item, levels = tree
    out, parts = [np.zeros((0, 2), np.int64)], _parts(q.shape[1])
    for a, b in parts:
        met = _met(levels, q[:, a:b], bound[a:b])
        if met is None:
            parts.send(True)
            continue
        # Items come twice where they fill a row.
        out.append(np.unique(np.c_[a + met[0], item[met[1], 0]], axis=0))
    return tuple(np.concatenate(out).T)


def _xyz(t: pa.Table | pa.RecordBatch, names: Sequence[str] = AXES) -> np.ndarray:
    return np.stack([t.column(c).to_numpy(zero_copy_only=False) for c in names])


def _spread(queries: DataFrame) -> DataFrame:
    """``session.spread`` by query: dealing rows out in turn would sort them first."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    return queries.repartition(cores, "qid") if 0 < len(queries._jdf.inputFiles()) < cores else queries


def _in_leaves(pairs: DataFrame, targets: DataFrame, search: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``search`` over the queries and the targets of each leaf. Leaves with many queries are dealt out in parts."""
    many = cut(pairs.groupBy("node").agg(F.ceil(F.count("*") / F.lit(GROUP)).cast("int").alias("_parts")))
    src = pairs.join(many, "node").withColumn("_part", F.pmod(F.xxhash64("qid"), F.col("_parts"))).drop("_parts")
    dst = targets.join(many, "node").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_parts") - 1))).drop("_parts")
    return src.groupBy("node", "_part").cogroup(dst.groupBy("node", "_part")).applyInArrow(search, schema)


def _nearest_of_many(src: DataFrame, points: DataFrame, n_points: int) -> DataFrame:
    """(qid, d2, tid) of the nearest of many points. Two shuffles of the queries: to the leaf around each, then to the other
    leaves within the distance found there. Cuts between leaves come from a bounded draw of the points; every point is in a leaf."""
    known = F.lit(True)
    for a in AXES:
        known = known & F.col(a).isNotNull()
    points = points.filter(known)
    per_leaf = max(PER_LEAF, -(-n_points // LEAVES))
    one_in = max(1, per_leaf // DRAWN)
    drawn = points.filter(F.pmod(F.xxhash64(*AXES), F.lit(one_in)) == 0).select(*AXES).toArrow()
    drawn = drawn if drawn.num_rows else points.select(*AXES).limit(1).toArrow()
    if not drawn.num_rows:
        return src.select("qid", F.lit(0.0).alias("d2"), F.lit(None).cast(points.schema["tid"].dataType).alias("tid")).limit(0)
    cuts = _cuts(_xyz(drawn).T, per_leaf / one_in)

    def place(batches):
        for batch in batches:
            leaf = pa.array(_leaf_of(cuts, _xyz(batch).T.astype(float)), pa.int32())
            yield pa.RecordBatch.from_arrays([leaf, *batch.columns], names=["node", *batch.schema.names])

    def placed(df: DataFrame) -> DataFrame:
        kinds = [f"{f.name} {f.dataType.simpleString()}" for f in df.schema]
        return cut(df.mapInArrow(place, ", ".join(["node int", *kinds])))

    targets = placed(points.select(*[F.col(a).cast("double").alias(a) for a in AXES], "tid"))
    sides = targets.groupBy("node").agg(*[f(a).alias(f"{n}{a}") for n, f in (("lo", F.min), ("hi", F.max)) for a in AXES]).toArrow()
    name = sides.column("node").to_numpy()
    leaves = _box_tree(*[_xyz(sides, [f"{n}{a}" for a in AXES]).T for n in ("lo", "hi")], 1)
    at = placed(src.filter(known).select("qid", *[F.col(a).cast("double").alias(a) for a in AXES]))
    kind = {f.name: f.dataType.simpleString() for f in [*at.schema, *targets.schema]}
    cols = ["qid", *AXES]

    def near(src: pa.Table, dst: pa.Table, bound: np.ndarray):
        dst = dst.take(pa.compute.sort_indices(dst, [("tid", "ascending")], null_placement="at_start"))
        d2, at = _closest(_xyz(src), bound, _xyz(dst).T.copy())
        # Only a place that is not a number is at no distance from anything.
        return np.where(at < 0, np.nan, d2), np.maximum(at, 0), dst.column("tid")

    def around(src: pa.Table, dst: pa.Table) -> pa.Table:
        if not src.num_rows or not dst.num_rows:
            return pa.table([*src.slice(0, 0).select(cols).columns, pa.array([], pa.float64()), dst.slice(0, 0).column("tid"), pa.array([], pa.list_(pa.int32()))], names=[*cols, "d2", "tid", "others"])
        d2, at, tid = near(src, dst, np.full(src.num_rows, np.inf))
        who, leaf = _leaves_met(leaves, _xyz(src), d2 * SLACK)
        who, leaf = (x[name[leaf] != src.column("node")[0].as_py()] for x in (who, name[leaf]))
        ends = np.searchsorted(who, np.arange(src.num_rows + 1))
        others = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf, pa.int32()))
        return pa.table([*src.select(cols).columns, pa.array(d2), tid.take(pa.array(at)), others], names=[*cols, "d2", "tid", "others"])

    def beyond(src: pa.Table, dst: pa.Table) -> pa.Table:
        if not src.num_rows or not dst.num_rows:
            return pa.table([src.slice(0, 0).column("qid"), pa.array([], pa.float64()), dst.slice(0, 0).column("tid")], names=["qid", "d2", "tid"])
        had = src.column("d2").to_numpy()
        d2, at, tid = near(src, dst, had)
        on = np.flatnonzero(d2 <= had)
        return pa.table([src.column("qid").take(pa.array(on)), pa.array(d2[on]), tid.take(pa.array(at[on]))], names=["qid", "d2", "tid"])

    first = cut(_in_leaves(at, targets, around, f"qid {kind['qid']}, x double, y double, z double, d2 double, tid {kind['tid']}, others array<int>"))
    free(at)
    more = _in_leaves(first.select(*cols, "d2", F.explode("others").alias("node")), targets, beyond, f"qid {kind['qid']}, d2 double, tid {kind['tid']}")
    found = first.select("qid", "d2", "tid").unionByName(more).select("qid", F.struct("d2", "tid").alias("_b"))
    return found.groupBy("qid").agg(F.min("_b").alias("_b")).select("qid", "_b.d2", "_b.tid")


def nearest_points(src: DataFrame, dst: DataFrame, src_id: str, dst_id: str) -> DataFrame:
    """(src_id, dst_id, dist) of the nearest dst point; equal distances give the smallest dst id.

    ``src_id`` must be unique in src; coordinates are x, y, z. Empty if dst is empty.
    """
    src = src.select(F.col(src_id).alias("qid"), *AXES)
    points = cut(dst.groupBy(*AXES).agg(F.min(dst_id).alias("tid")))
    n_points = points.count()
    if n_points > MANY:
        best = _nearest_of_many(_spread(src), points, n_points)
        return best.select(F.col("qid").alias(src_id), F.col("tid").alias(dst_id), F.sqrt("d2").alias("dist"))
    src = cut(spread(src))
    low, edge = _extent(src, points)
    points = points.withColumn("code", _code(_keys(low, edge)))
    box = {name: F.col(name[-1]) for name in BOX}
    nodes, placed, base, deepest = _build(points, box)
    few = nodes.count() <= SENT

    # Upper bound per query: the deepest target node on its own path.
    # Codes of the depth that is used, no deeper: the generated code stays small.
    src = src.withColumn("leaf", K.location_code(_keys(low, edge, deepest), deepest))
    start = deepest_of(src.select("leaf").distinct(), nodes).join(nodes.select("node", *BOX), "node")
    seeded = src.join(start.drop("node"), "leaf").withColumn("ub2", _sure2()).select("qid", *AXES, "ub2")
    # Shuffled once here, before rows multiply: the bound below is per query row.
    seeded = _dealt(seeded)

    # All cells that the ball of the bound can touch, at the depth where cells are about its size.
    seeded = seeded.withColumn("_r", F.sqrt("ub2") * (1 + 1e-9) + F.lit(edge * 1e-9))
    fit = F.floor(F.log2(F.lit(edge) / F.col("_r"))).cast("int")
    seeded = seeded.withColumn("_d", F.greatest(F.lit(0), F.least(F.lit(base), fit)))
    around = seeded.withColumn("_scale", F.pow(F.lit(2.0), F.col("_d")) / F.lit(edge))
    for a, l in zip(AXES, low):
        first = F.floor((F.col(a) - F.col("_r") - F.lit(l)) * F.col("_scale"))
        last = F.floor((F.col(a) + F.col("_r") - F.lit(l)) * F.col("_scale"))
        top = F.pow(F.lit(2.0), F.col("_d")).cast("bigint") - 1
        span = F.sequence(F.greatest(first, F.lit(0).cast("bigint")), F.least(last, top))
        around = around.withColumn(f"n{a}", F.explode(span))
    prefix = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_d") * 3)
    around = around.withColumn("node", prefix.bitwiseOR(K.morton([F.col(f"n{a}") for a in AXES], base)))
    frontier = around.select("qid", *AXES, "ub2", "node").join(_sent(nodes.select("node", "leaf", *BOX), few), "node")
    frontier = _tighten(frontier).select(*KEPT)

    pairs = _descend(frontier, nodes, few, deepest)
    targets = placed.select("node", "tid", *[F.col(a).alias(f"t{a}") for a in AXES])
    diff = [F.col(a) - F.col(f"t{a}") for a in AXES]
    found = pairs.join(_sent(targets, few and n_points <= 4 * SENT), "node").select("qid", F.struct(G.dot(diff, diff).alias("d2"), F.col("tid")).alias("_b"))
    best = found.groupBy("qid").agg(F.min("_b").alias("_b"))
    return best.select(F.col("qid").alias(src_id), F.col("_b.tid").alias(dst_id), F.sqrt("_b.d2").alias("dist"))


def nearest_shapes(
    src: DataFrame,
    shapes: DataFrame,
    src_id: str,
    shape_id: str,
    corners: Sequence[Sequence[str]],
    distance: Callable[[list[Column], list[list[Column]]], Column],
) -> DataFrame:
    """Nearest shape (segment, triangle) to each point: (src_id, shape_id, dist), smallest id on ties.

    ``corners`` names the coordinate columns of each corner. Shapes are bucketed by their centre, and node
    boxes enclose whole shapes, so a shape of any size is found from any distance.
    """
    dims = len(corners[0])
    flat = [c for corner in corners for c in corner]
    shapes = cut(shapes.select(F.col(shape_id).alias("tid"), *flat))
    if dims == 2:
        src = src.withColumn("z", F.lit(0.0))
    src = cut(spread(src.select(F.col(src_id).alias("qid"), *AXES)))
    n_shapes = shapes.count()
    mids, box = {}, {}
    for i, a in enumerate(AXES):
        cols = [F.col(corner[i]) for corner in corners] if i < dims else [F.lit(0.0), F.lit(0.0)]
        mids[a] = (F.least(*cols) + F.greatest(*cols)) / 2.0
        box[f"lo_{a}"], box[f"hi_{a}"], box[f"at_{a}"] = F.least(*cols), F.greatest(*cols), cols[0]
    centred = shapes.select("*", *[c.alias(a) for a, c in mids.items()])
    low, edge = _extent(centred)
    centred = centred.withColumn("code", _code(_keys(low, edge))).drop(*AXES)
    nodes, placed, _, deepest = _build(centred, box)
    few = nodes.count() <= SENT
    root = nodes.filter(F.col("node") == 1).select("node", "leaf", *BOX)
    # One row: the root of the tree. Dealt by query before rows multiply.
    frontier = _dealt(src).withColumn("node", F.lit(1).cast("bigint")).join(F.broadcast(root), "node")
    frontier = frontier.withColumn("ub2", _sure2()).select(*KEPT)
    pairs = _descend(frontier, nodes, few, deepest)
    found = pairs.join(_sent(placed.select("node", "tid", *flat), few and n_shapes <= 4 * SENT), "node")
    d = distance([F.col(a) for a in AXES[:dims]], [[F.col(c) for c in corner] for corner in corners])
    best = found.groupBy("qid").agg(F.min(F.struct(d.alias("d"), F.col("tid"))).alias("_b"))
    return best.select(F.col("qid").alias(src_id), F.col("_b.tid").alias(shape_id), F.col("_b.d").alias("dist"))


# -- users of the joins ----------------------------------------------------------------------------


def cloud_labels(grid: DataFrame, cloud: DataFrame, eps: float, grid_id: str, cloud_id: str) -> DataFrame:
    """Distance to the cloud and its central-difference gradient (unit length) at every grid point.

    The seven neighbours searches per point are one join over the point and its six offsets.
    """
    here = grid.select(F.col(grid_id).alias("_g"), F.lit(-1).alias("axis"), F.lit(0).alias("side"), *AXES)
    moved = G.offset_points(grid.select(F.col(grid_id).alias("_g"), *AXES), eps)
    probes = here.unionByName(moved)
    slot = F.when(F.col("axis") < 0, F.lit(0)).otherwise(F.col("axis") * 2 + F.when(F.col("side") > 0, 1).otherwise(2))
    probes = probes.select((F.col("_g") * 7 + slot).alias("_q"), *AXES)
    near = nearest_points(probes, cloud, "_q", cloud_id)
    g = F.floor(F.col("_q") / F.lit(7)).cast("bigint")
    at = lambda i: F.max(F.when(F.col("_q") - g * 7 == i, F.col("dist")))
    out = near.groupBy(g.alias(grid_id)).agg(
        at(0).alias("sdf"), *[((at(2 * i + 1) - at(2 * i + 2)) / F.lit(2 * eps)).alias(f"g{a}") for i, a in enumerate(AXES)]
    )
    unit = G.normalised(G.vec("gx", "gy", "gz"), 1e-6)
    return out.select(grid_id, "sdf", *[c.alias(f"g{a}") for a, c in zip(AXES, unit)])


def both_ways(a: DataFrame, b: DataFrame, a_id: str, b_id: str) -> DataFrame:
    """Nearest distances in both directions, tagged ``side`` (a_to_b, b_to_a)."""
    one = nearest_points(a, b, a_id, b_id).select(F.lit("a_to_b").alias("side"), F.col(a_id).alias("id"), "dist")
    two = nearest_points(b, a, b_id, a_id).select(F.lit("b_to_a").alias("side"), F.col(b_id).alias("id"), "dist")
    return one.unionByName(two)


def triangle_distance(p: list[Column], corners: list[list[Column]]) -> Column:
    return S.point_triangle_distance(p, *corners)


def segment_distance(p: list[Column], corners: list[list[Column]]) -> Column:
    return S.point_segment_distance(p, *corners)


TRIANGLE = [[f"{c}{a}" for a in AXES] for c in "abc"]
SEGMENT = [[f"{c}{a}" for a in "xy"] for c in "ab"]
