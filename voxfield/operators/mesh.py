"""Triangle meshes and polygons: corner lookup, areas, surface samples, inside tests, signed distances.

A mesh is two tables, ``vertices(vid, x, y, z)`` and ``triangles(fid, a, b, c)``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxfield.functions import geometry as G
from voxfield.functions.hashing import uniform
from voxfield.operators.asof import ID_BLOCK, running_sum
from voxfield.operators.nearest import SEGMENT, TRIANGLE, nearest_shapes, segment_distance, triangle_distance

CORNERS = [c for t in TRIANGLE for c in t]


def triangle_corners(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Corner coordinates ax..cz of every triangle, by one join on the three exploded vertex ids.

    Tables of several files, with a ``path`` in both, meet file by file and keep it. The sides are shuffled:
    the planner takes a table of exploded rows for no larger than its source, and would send it whole through the driver.
    """
    file = ["path"] if "path" in triangles.columns and "path" in vertices.columns else []
    ids = F.array(*[F.struct(F.lit(c).alias("corner"), F.col(c).alias("vid")) for c in "abc"])
    long = triangles.select(*file, "fid", "a", "b", "c", F.explode(ids).alias("_v")).select(*file, "fid", "a", "b", "c", "_v.*")
    placed = long.join(vertices.select(*file, "vid", "x", "y", "z").hint("merge"), [*file, "vid"])
    picks = [F.max(F.when(F.col("corner") == c, F.col(x))).alias(f"{c}{x}") for c in "abc" for x in "xyz"]
    out = placed.groupBy(*file, "fid", "a", "b", "c").agg(F.count("*").alias("_n"), *picks)
    return out.filter(F.col("_n") == 3).drop("_n")


def _normal() -> list[Column]:
    a, b, c = [G.vec(*t) for t in TRIANGLE]
    return G.cross(G.sub(b, a), G.sub(c, a))


def with_area(corners: DataFrame) -> DataFrame:
    """Area and unit normal (0 for a triangle without area)."""
    n = _normal()
    length = G.norm(n)
    unit = [F.coalesce(G.safe_div(v, length), F.lit(0.0)).alias(f"n{a}") for a, v in zip("xyz", n)]
    return corners.select("*", (length / 2.0).alias("area"), *unit)


def sample_surface(corners: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """N points spread uniformly over the area: (sample_id, fid, x, y, z).

    Draw j falls at j + u_j on the running area scaled to n, so each triangle owns the draws that fall in
    its stretch. The draws of a triangle are made in chunks: one that holds a third of the surface is no
    long list in one row, and chunks are spread before they are filled.
    """
    faces = with_area(corners).select("fid", *CORNERS, "area").filter(F.col("area") > 0)
    total = float(faces.agg(F.sum("area")).first()[0] or 0.0)
    if total <= 0.0:
        return faces.select(F.lit(0).cast("bigint").alias("sample_id"), "fid", *[F.lit(0.0).alias(a) for a in "xyz"]).limit(0)
    block = F.floor(F.col("fid") / F.lit(ID_BLOCK)).cast("bigint")
    faces = running_sum(faces, (), ("fid",), block, "area", "_from")
    scale = F.lit(n / total)
    faces = faces.withColumn("_a", F.col("_from") * scale).withColumn("_b", (F.col("_from") + F.col("area")) * scale)
    chunk = 4096
    first, last = F.floor("_a").cast("bigint"), F.least(F.floor("_b").cast("bigint"), F.lit(n - 1))
    faces = faces.withColumn("_lo", first).withColumn("_hi", last).filter(F.col("_lo") <= F.col("_hi"))
    starts = faces.withColumn("_s", F.explode(F.sequence(F.col("_lo"), F.col("_hi"), F.lit(chunk).cast("bigint"))))
    starts = starts.repartition("fid", "_s")
    ends = F.least(F.col("_s") + F.lit(chunk - 1), F.col("_hi"))
    draws = starts.withColumn("sample_id", F.explode(F.sequence(F.col("_s"), ends)))
    at = F.col("sample_id") + uniform(F.col("sample_id"), 0, seed)
    draws = draws.filter((at >= F.col("_a")) & (at < F.col("_b")))
    # Square-root mapping of two draws to uniform barycentric weights.
    draws = draws.withColumn("_r", F.sqrt(uniform(F.col("sample_id"), 1, seed))).withColumn("_t", uniform(F.col("sample_id"), 2, seed))
    wa, wb, wc = 1.0 - F.col("_r"), F.col("_r") * (1.0 - F.col("_t")), F.col("_r") * F.col("_t")
    at3 = [(wa * F.col(f"a{x}") + wb * F.col(f"b{x}") + wc * F.col(f"c{x}")).alias(x) for x in "xyz"]
    return draws.select("sample_id", "fid", *at3)


# -- inside tests --------------------------------------------------------------------------------


def _grid(shapes: DataFrame, ends: dict[str, list[str]], per_axis: float) -> dict[str, tuple[float, float]]:
    """Cell origin and width per axis so that the grid has about as many cells as there are shapes."""
    aggs = [F.count("*").alias("n")]
    for a, cols in ends.items():
        aggs += [F.min(F.least(*cols)).alias(f"lo{a}"), F.max(F.greatest(*cols)).alias(f"hi{a}")]
    row = shapes.agg(*aggs).first()
    cells = max(1, int(max(row["n"], 1) ** per_axis))
    return {
        a: (float(row[f"lo{a}"] or 0.0), max((float(row[f"hi{a}"] or 0.0) - float(row[f"lo{a}"] or 0.0)) / cells, 1e-9))
        for a in ends
    }


def _spread(shapes: DataFrame, points: DataFrame, ends: dict[str, list[str]], per_axis: float):
    grid = _grid(shapes, ends, per_axis)
    cells = []
    for a, cols in ends.items():
        low, width = grid[a]
        cell = lambda v: F.floor((v - F.lit(low)) / F.lit(width)).cast("bigint")  # noqa: B023
        shapes = shapes.withColumn(f"_cell_{a}", F.explode(F.sequence(cell(F.least(*cols)), cell(F.greatest(*cols)))))
        points = points.withColumn(f"_cell_{a}", cell(F.col(a)))
        cells.append(f"_cell_{a}")
    return shapes, points, cells


def _passes(p: str, q: str, along: str, across: str) -> Column:
    """The edge pq crosses the point's ``across`` line (half-open) on the far side in ``along``."""
    pa, qa, pl, ql = F.col(f"{p}{across}"), F.col(f"{q}{across}"), F.col(f"{p}{along}"), F.col(f"{q}{along}")
    span = (pa > F.col(across)) != (qa > F.col(across))
    return span & (pl + (ql - pl) * G.safe_div(F.col(across) - pa, qa - pa) > F.col(along))


def inside_mesh(points: DataFrame, corners: DataFrame, point_id: str) -> DataFrame:
    """(point_id, inside): whether a ray along +x leaves through an odd number of triangles.

    Points meet only the triangles over their own (y, z) column. Edges are half-open, so a ray through a
    shared edge counts one triangle.
    """
    ends = {a: [f"{c}{a}" for c in "abc"] for a in "yz"}
    tri, pts, cells = _spread(corners.select(*CORNERS), points.select(point_id, "x", "y", "z"), ends, 0.5)
    over = None
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        hit = F.when(_passes(p, q, "y", "z"), 1).otherwise(0)
        over = hit if over is None else over + hit
    n = _normal()
    # Where the ray meets the triangle's plane.
    x = F.col("ax") - G.safe_div(n[1] * (F.col("y") - F.col("ay")) + n[2] * (F.col("z") - F.col("az")), n[0])
    hits = pts.join(tri, cells).filter((F.pmod(over, F.lit(2)) == 1) & (x > F.col("x")))
    odd = hits.groupBy(point_id).agg((F.pmod(F.count("*"), F.lit(2)) == 1).alias("inside"))
    return points.select(point_id).join(odd, point_id, "left").select(point_id, F.coalesce("inside", F.lit(False)).alias("inside"))


def mesh_sdf(points: DataFrame, corners: DataFrame, point_id: str) -> DataFrame:
    """Signed distance to a closed mesh, negative inside: (point_id, fid, sdf)."""
    near = nearest_shapes(points, corners, point_id, "fid", TRIANGLE, triangle_distance)
    sign = inside_mesh(points, corners, point_id)
    out = near.join(sign, point_id)
    return out.select(point_id, "fid", F.when(F.col("inside"), -F.col("dist")).otherwise(F.col("dist")).alias("sdf"))


def outward_sign(corners: DataFrame, offset: float = 0.01, samples: int = 1000) -> float:
    """-1 if points moved off the faces along their normals come out negative on average, else 1."""
    faces = with_area(corners)
    probes = sample_surface(corners, samples).join(faces.select("fid", "nx", "ny", "nz"), "fid")
    probes = probes.select("sample_id", *[(F.col(a) + offset * F.col(f"n{a}")).alias(a) for a in "xyz"])
    mean = mesh_sdf(probes, corners, "sample_id").agg(F.avg("sdf")).first()[0]
    return -1.0 if mean is not None and mean < 0 else 1.0


def inside_polygon(points: DataFrame, edges: DataFrame, point_id: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Winding number of closed polygons ``edges(ax, ay, bx, by_...)`` around each point, non-zero = inside.

    Edge columns are ax, ay, bx, by. Points meet only edges over their own y cell; upward edges to the right
    count +1, downward ones -1.
    """
    cols = [c for s in SEGMENT for c in s]
    seg, pts, cells = _spread(edges.select(*by, *cols), points.select(*by, point_id, "x", "y"), {"y": ["ay", "by"]}, 1.0)
    met = pts.join(seg, [*by, *cells]).filter(_passes("a", "b", "x", "y"))
    turn = met.groupBy(*by, point_id).agg(F.sum(F.when(F.col("by") > F.col("ay"), 1).otherwise(-1)).alias("winding"))
    out = points.select(*by, point_id).join(turn, [*by, point_id], "left")
    winding = F.coalesce("winding", F.lit(0).cast("bigint"))
    return out.select(*by, point_id, winding.alias("winding"), (winding != 0).alias("inside"))


def polygon_sdf(points: DataFrame, edges: DataFrame, point_id: str, edge_id: str) -> DataFrame:
    """Distance to the nearest edge, negative inside the polygon: (point_id, sdf)."""
    near = nearest_shapes(points, edges, point_id, edge_id, SEGMENT, segment_distance)
    out = near.join(inside_polygon(points, edges, point_id), point_id)
    return out.select(point_id, F.when(F.col("inside"), -F.col("dist")).otherwise(F.col("dist")).alias("sdf"))
