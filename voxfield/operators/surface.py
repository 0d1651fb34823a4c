"""Surfaces from grids: iso-surface, iso-lines and voxel wireframes."""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.functions import keys as K

AXES = "xyz"


@lru_cache
def cell_edges(dims: int) -> list[tuple[int, int, int]]:
    """Edges of the unit cell as (axis, lower corner, upper corner); corner i has bits x, y, z."""
    return [(a, c, c | 1 << a) for a in range(dims) for c in range(1 << dims) if not c >> a & 1]


def _cycle(corners: Sequence[int], free: tuple[int, int]) -> list[int]:
    """The four corners of a face in ring order."""
    at = {((c >> free[0]) & 1, (c >> free[1]) & 1): c for c in corners}
    return [at[k] for k in ((0, 0), (1, 0), (1, 1), (0, 1))]


def _face_links(ring: Sequence[int], inside: set[int], edge_of: dict) -> list[tuple[int, int]]:
    """Line pieces across a face. Inside corners that only touch diagonally are kept apart, a choice that
    depends on the face alone, so neighbouring cells agree and the surface has no holes."""
    links = []
    if len({c in inside for c in ring}) == 1:
        return links
    lone = [n for n, c in enumerate(ring) if c in inside and ring[n - 1] not in inside and ring[(n + 1) % 4] not in inside]
    edge = lambda n: edge_of[frozenset((ring[n % 4], ring[(n + 1) % 4]))]
    if lone:
        return [(edge(n - 1), edge(n)) for n in lone]
    cut = [n for n in range(4) if (ring[n] in inside) != (ring[(n + 1) % 4] in inside)]
    return [(edge(cut[0]), edge(cut[1]))]


@lru_cache
def triangle_cases() -> list[list[tuple[int, int, int]]]:
    """Triangles (as edge numbers) for each of the 256 sign patterns, built from the faces.

    The crossed edges of every face are linked, the links close into rings, and rings become fans.
    """
    edges = cell_edges(3)
    edge_of = {frozenset((lo, hi)): n for n, (_, lo, hi) in enumerate(edges)}
    cases = []
    for pattern in range(256):
        inside = {c for c in range(8) if pattern >> c & 1}
        links: dict[int, list[int]] = {}
        for axis, side in itertools.product(range(3), (0, 1)):
            free = tuple(a for a in range(3) if a != axis)
            ring = _cycle([c for c in range(8) if (c >> axis & 1) == side], free)
            for p, q in _face_links(ring, inside, edge_of):
                links.setdefault(p, []).append(q)
                links.setdefault(q, []).append(p)
        triangles, left = [], set(links)
        while left:
            start = min(left)
            ring, here, last = [start], start, None
            while True:
                left.discard(here)
                step = [n for n in links[here] if n != last] or links[here]
                here, last = step[0], here
                if here == start:
                    break
                ring.append(here)
            triangles += [(ring[0], ring[n], ring[n + 1]) for n in range(1, len(ring) - 1)]
        cases.append(triangles)
    return cases


def _cells(grid: DataFrame, axes: Sequence[str], value: str, iso: float) -> DataFrame:
    """Cells whose corners are all present and not all on one side: index columns and s0.. corner values."""
    dims = len(axes)
    n = 1 << dims
    corner = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = grid.filter(F.col(value).isNotNull()).select(*axes, F.col(value).alias("_s")).withColumn("_c", corner)
    for b, a in enumerate(axes):
        rows = rows.withColumn(a, F.col(a) - F.shiftright(F.col("_c"), b).bitwiseAND(F.lit(1)))
    picks = [F.max(F.when(F.col("_c") == i, F.col("_s"))).alias(f"s{i}") for i in range(n)]
    cells = rows.groupBy(*axes).agg(F.count("*").alias("_n"), *picks).filter(F.col("_n") == n).drop("_n")
    low, high = F.least(*[f"s{i}" for i in range(n)]), F.greatest(*[f"s{i}" for i in range(n)])
    return cells.filter((low < iso) & (high >= iso))


def _edge_points(cells: DataFrame, axes: Sequence[str], origin: Sequence[float], res: float, iso: float, edge: str) -> DataFrame:
    """For rows with an edge number: lower grid corner e_i.., edge axis and the crossing point."""
    dims = len(axes)
    edges = cell_edges(dims)
    pick = lambda f: F.element_at(F.array(*[f(e) for e in edges]), F.col(edge) + 1)
    low = pick(lambda e: F.lit(e[1]))
    cells = cells.withColumns({"axis": pick(lambda e: F.lit(e[0])), "_lo": pick(lambda e: F.col(f"s{e[1]}")), "_hi": pick(lambda e: F.col(f"s{e[2]}"))})
    cells = cells.withColumn("_low", low)
    t = F.try_divide(F.lit(iso) - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    cells = cells.withColumn("_t", F.coalesce(t, F.lit(0.5)))
    out = {}
    for b, a in enumerate(axes):
        index = F.col(a) + F.shiftright(F.col("_low"), b).bitwiseAND(F.lit(1))
        out[f"e{a}"] = index
        out[AXES[b]] = F.lit(float(origin[b])) + (index + F.when(F.col("axis") == b, F.col("_t")).otherwise(F.lit(0.0))) * F.lit(float(res))
    return cells.withColumns(out)


def _vertex_id(axes: Sequence[str], shape: Sequence[int]) -> Column:
    """Id of a grid edge: its lower corner's index times the number of axes, plus the axis."""
    code = F.col(f"e{axes[0]}").cast("bigint")
    for a, n in zip(axes[1:], shape[1:]):
        code = code * F.lit(n) + F.col(f"e{a}")
    return code * F.lit(len(axes)) + F.col("axis")


def iso_surface(
    grid: DataFrame, origin: Sequence[float], res: float, shape: Sequence[int], value: str = "sdf", iso: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y, z) and triangles (fid, a, b, c, nx, ny, nz) of the iso-surface.

    Each cell that has all eight corners and straddles the value looks up its pattern; vertices sit on grid
    edges and carry the edge's number, so cells share them without any search. Normals point to larger values.
    """
    axes = ("i", "j", "k")
    cells = _cells(grid, axes, value, iso)
    pattern = sum((F.when(F.col(f"s{i}") < iso, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(1, 8)), F.when(F.col("s0") < iso, F.lit(1)).otherwise(F.lit(0)))
    cases = [(p, n, *t) for p, tris in enumerate(triangle_cases()) for n, t in enumerate(tris)]
    spark = grid.sparkSession
    table = spark.createDataFrame(cases, "pattern int, n int, e0 int, e1 int, e2 int")
    # The lookup has a fixed number of rows.
    tri = cells.withColumn("pattern", pattern).join(F.broadcast(table), "pattern")
    number = (F.col("i").cast("bigint") * F.lit(shape[1]) + F.col("j")) * F.lit(shape[2]) + F.col("k")
    tri = tri.withColumn("fid", number * F.lit(16) + F.col("n"))
    # Slope of the field across the cell, to orient the triangle.
    for b, a in enumerate(AXES):
        up = sum((F.col(f"s{c}") for c in range(1, 8) if c >> b & 1 and c != 1 << b), F.col(f"s{1 << b}"))
        down = sum((F.col(f"s{c}") for c in range(1, 8) if not c >> b & 1), F.col("s0"))
        tri = tri.withColumn(f"_g{a}", up - down)
    corner = F.posexplode(F.array("e0", "e1", "e2"))
    long = tri.select("fid", *axes, *[f"s{i}" for i in range(8)], *[f"_g{a}" for a in AXES], corner.alias("_w", "_e"))
    long = _edge_points(long, axes, origin, res, iso, "_e").withColumn("vid", _vertex_id(axes, shape))
    vertices = long.groupBy("vid").agg(*[F.min(a).alias(a) for a in AXES])
    at = lambda w, c: F.max(F.when(F.col("_w") == w, F.col(c)))
    faces = long.groupBy("fid").agg(
        *[at(w, "vid").alias(f"v{w}") for w in range(3)],
        *[at(w, a).alias(f"{a}{w}") for w in range(3) for a in AXES],
        *[F.max(f"_g{a}").alias(f"_g{a}") for a in AXES],
    )
    p = [[F.col(f"{a}{w}") for a in AXES] for w in range(3)]
    n = G.cross(G.sub(p[1], p[0]), G.sub(p[2], p[0]))
    faces = faces.withColumns({f"_n{a}": c for a, c in zip(AXES, n)})
    normal = [F.col(f"_n{a}") for a in AXES]
    faces = faces.withColumn("_turn", G.dot(normal, [F.col(f"_g{a}") for a in AXES]) < 0)
    flip = F.when(F.col("_turn"), F.lit(-1.0)).otherwise(F.lit(1.0))
    length = G.norm(normal)
    unit = [(F.coalesce(G.safe_div(c, length), F.lit(0.0)) * flip).alias(f"n{a}") for a, c in zip(AXES, normal)]
    b, c = F.col("v1"), F.col("v2")
    faces = faces.select(
        "fid", F.col("v0").alias("a"), F.when(F.col("_turn"), c).otherwise(b).alias("b"), F.when(F.col("_turn"), b).otherwise(c).alias("c"), *unit
    )
    return vertices, faces


def iso_lines(
    grid: DataFrame, origin: Sequence[float], res: float, shape: Sequence[int], value: str = "sdf", iso: float = 0.0
) -> tuple[DataFrame, DataFrame]:
    """Vertices (vid, x, y) and segments (sid, a, b) of the iso-lines of a 2-D grid (i, j)."""
    axes = ("i", "j")
    cells = _cells(grid, axes, value, iso)
    edge_of = {frozenset((lo, hi)): n for n, (_, lo, hi) in enumerate(cell_edges(2))}
    cases = []
    for pattern in range(16):
        inside = {c for c in range(4) if pattern >> c & 1}
        for n, (p, q) in enumerate(_face_links(_cycle(range(4), (0, 1)), inside, edge_of)):
            cases.append((pattern, n, p, q))
    pattern = sum((F.when(F.col(f"s{i}") < iso, F.lit(1 << i)).otherwise(F.lit(0)) for i in range(1, 4)), F.when(F.col("s0") < iso, F.lit(1)).otherwise(F.lit(0)))
    table = grid.sparkSession.createDataFrame(cases, "pattern int, n int, e0 int, e1 int")
    seg = cells.withColumn("pattern", pattern).join(F.broadcast(table), "pattern")
    seg = seg.withColumn("sid", (F.col("i").cast("bigint") * F.lit(shape[1]) + F.col("j")) * F.lit(2) + F.col("n"))
    long = seg.select("sid", *axes, *[f"s{i}" for i in range(4)], F.posexplode(F.array("e0", "e1")).alias("_w", "_e"))
    long = _edge_points(long, axes, origin, res, iso, "_e").withColumn("vid", _vertex_id(axes, shape))
    vertices = long.groupBy("vid").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    ends = [F.max(F.when(F.col("_w") == w, F.col("vid"))).alias(c) for w, c in ((0, "a"), (1, "b"))]
    return vertices, long.groupBy("sid").agg(*ends)


# -- wireframes ----------------------------------------------------------------------------------


def unique_edges(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Undirected edges, once each, smaller id first."""
    return edges.select(F.least(a, b).alias(a), F.greatest(a, b).alias(b)).distinct()


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """The edges of a triangle table."""
    sides = F.array(*[F.struct(F.col(p).alias("a"), F.col(q).alias("b")) for p, q in ("ab", "bc", "ca")])
    return unique_edges(triangles.select(F.explode(sides).alias("_s")).select("_s.*"))


def wire_edges(nodes: DataFrame, depth: int) -> DataFrame:
    """The 12 edges of every voxel in corner keys, once each: (axis, x, y, z, length), start to end along +axis."""
    boxes = nodes.select("node").withColumn("level", (F.lit(depth) - K.node_depth(F.col("node"))).cast("int"))
    boxes = boxes.select("level", *[k.alias(f"k{a}") for a, k in zip(AXES, K.node_keys(F.col("node"), depth))])
    boxes = boxes.withColumn("length", K.discrete_size(F.col("level")))
    options = []
    for axis, low, _ in cell_edges(3):
        start = [(F.col(f"k{a}") + F.col("length") * (low >> b & 1)).alias(a) for b, a in enumerate(AXES)]
        options.append(F.struct(F.lit(axis).alias("axis"), *start))
    return boxes.select("length", F.explode(F.array(*options)).alias("_e")).select("_e.*", "length").distinct()


def crop_edges(edges: DataFrame, low: Sequence[float], high: Sequence[float], res: float, depth: int) -> DataFrame:
    """Edges with both ends inside a metric box."""
    for b, a in enumerate(AXES):
        first = K.corner_coord(F.col(a), res, depth)
        last = first + F.when(F.col("axis") == b, F.col("length")).otherwise(F.lit(0)) * F.lit(float(res))
        edges = edges.filter((first >= low[b]) & (last <= high[b]))
    return edges


def longest_edges(edges: DataFrame) -> DataFrame:
    """Of the edges with the same axis and end point only the longest."""
    ends = {f"_e{a}": F.col(a) + F.when(F.col("axis") == b, F.col("length")).otherwise(F.lit(0)) for b, a in enumerate(AXES)}
    best = edges.withColumns(ends).groupBy("axis", *ends).agg(F.max("length").alias("length"))
    starts = [(F.col(f"_e{a}") - F.when(F.col("axis") == b, F.col("length")).otherwise(F.lit(0))).alias(a) for b, a in enumerate(AXES)]
    return best.select("axis", *starts, "length")


