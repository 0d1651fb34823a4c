"""Exact top-k by inner product with an M-tree searched best first.

Inner products become distances: with one more coordinate sqrt(M - |x|^2), M the largest squared length, the distance of a
stored vector to a query (whose extra coordinate is 0) falls as the inner product grows. The tree has a directory of routing
objects (a bounded sample), under each of them leaf pages that hold a ring of distances to it: every entry stores its distance to the
routing object, every page the least and largest of these (its covering ring).

The directory is one flat level, not a tree of nested nodes. Neighbouring subtrees share a bin, a large one is dealt over several; a query is sent to a
bin once, whatever it visits there. It first visits the bin of its nearest routing object, which gives a k-th
best distance; in a second round it visits all bins with a subtree that the triangle inequality does not exclude then, each in a task that does not see what the
others find, and inside them, nearest pages first, only the pages and entries whose stored
parent distance is within the current k-th distance of its own. Bounds are slack by a rounding margin; scores are whole numbers, so
results are exact. Where a score may not be exact in a double, what the bounds let through is scored anew in Python's whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxfield import session

#: Routing objects at most; the sample that they come from is as large (by hash of the id).
MAX_ROUTERS = 1024
#: Vectors per routing object that the number of routing objects aims at, and entries of a page.
CELL, PAGE = 1024, 128
#: Rows of one bin and queries of one block that meet in a task, at most; bins are smaller, down to ``SMALL`` rows, for more parallel work.
SUBTREE, QUERIES, SMALL = 1 << 15, 1 << 13, 1 << 10
#: Rows that are compared with all routing objects at once, rows that are sent on at once, and finds that are kept before they are sifted.
SLICE, SENT, FOUND = 1 << 10, 1 << 12, 1 << 19
SLACK = 1e-7
#: Squared lengths up to which every sum of products is exact in doubles.
EXACT = 2.0**52


def whole_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of every component as a double.

    Null vectors, vectors that hold a null or non-finite component, and rows without an id are left out. Of rows that share a vec_id
    the one with the smallest vector stays.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors are filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _lift(x: np.ndarray, square: float) -> np.ndarray:
    """Stored vectors with the coordinate that makes all of length sqrt(square)."""
    return np.hstack([x, np.sqrt(np.maximum(square - (x * x).sum(1), 0.0))[:, None]])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(d, 0.0))


def _best(query: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best per query: highest score, then smallest id."""
    order = np.lexsort((vec, ~score, query))
    q = query[order]
    heads = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(heads, np.diff(np.r_[heads, len(q)]))
    return order[rank < k]


def _slack(width: int, square: float) -> float:
    """Rounding margin of distances, as a part of the lengths: wider where squared lengths are rounded themselves."""
    return SLACK if square <= EXACT else SLACK * float(np.sqrt(width + 1))


def _whole(column, width: int) -> np.ndarray:
    """Rows of a list column as Python's whole numbers; shorter vectors are filled with zeros."""
    out = np.zeros((len(column), width), object)
    for i, row in enumerate(column.to_pylist()):
        out[i, : len(row)] = row
    return out


def _search(pages: pa.Table, asks: pa.Table, routers: np.ndarray, width: int, square: float, k: int) -> pa.Table:
    """The k best entries of one bin for each query of a block, as far as they beat what the query has."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not pages.num_rows or not asks.num_rows:
        return schema.empty_table()
    pages = pages.take(np.lexsort((pages.column("parent").to_numpy(), pages.column("cell").to_numpy())))
    entries, vec, parent, cell = _matrix(pages.column("v"), width), *(pages.column(c).to_numpy() for c in ("vec_id", "parent", "cell"))
    wide = (_whole(pages.column("v"), width), _whole(asks.column("v"), width)) if square > EXACT else None
    queries, ids = _matrix(asks.column("v"), width), asks.column("vec_id").to_numpy()
    # Pages are of one subtree each.
    heads = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    starts = np.concatenate([np.arange(a, b, PAGE) for a, b in zip(heads, np.r_[heads[1:], len(vec)])])
    ends = np.r_[starts[1:], len(vec)]
    low, high, under = parent[starts], parent[ends - 1], np.searchsorted(heads, starts, "right") - 1
    own = _distances(np.hstack([queries, np.zeros((len(ids), 1))]), routers[cell[heads]])
    length = (queries * queries).sum(1)
    # Distance of the k-th best so far, infinite if there are fewer than k.
    reach = asks.column("reach").to_numpy().copy()
    margin = _slack(width, square) * (1.0 + np.sqrt(square + length))
    found: list[tuple] = []
    held = np.zeros(len(ids), np.int64)
    # Pages nearest to where the queries are come first.
    least = np.array([np.maximum(np.maximum(low[p] - own[:, c], own[:, c] - high[p]), 0.0).mean() for p, c in enumerate(under)])
    for p in np.argsort(least, kind="stable"):
        to = own[:, under[p]]
        on = np.flatnonzero(np.maximum(low[p] - to, to - high[p]) <= reach + margin)
        if not len(on):
            continue
        # Entries whose stored distance excludes them for every query still here are not computed.
        a, b = starts[p], ends[p]
        a, b = a + np.searchsorted(parent[a:b], (to[on] - reach[on] - margin[on]).min()), a + np.searchsorted(parent[a:b], (to[on] + reach[on] + margin[on]).max(), "right")
        if a >= b:
            continue
        score = np.rint(queries[on] @ entries[a:b].T)
        squared = square + length[on][:, None] - 2.0 * score
        hit = (squared <= ((reach[on] + margin[on]) ** 2)[:, None]) & (vec[None, a:b] != ids[on][:, None])
        q, e = np.nonzero(hit)
        if not len(q):
            continue
        if wide is None:
            exact = score[q, e].astype(np.int64)
        else:
            # Scores beyond a bigint count as the nearest one.
            exact = np.array([min(max(int((wide[1][i] * wide[0][j]).sum()), -(1 << 63)), (1 << 63) - 1) for i, j in zip(on[q], a + e)], np.int64)
        found.append((on[q], exact, vec[a + e]))
        np.add.at(held, on[q], 1)
        if len(found) > 8 or sum(len(f[0]) for f in found) > FOUND:
            found = [_tighten(found, held, reach, square, length, k)]
    if not found:
        return schema.empty_table()
    q, score, v = _tighten(found, held, reach, square, length, k)
    return pa.table([pa.array(ids[q]), pa.array(v), pa.array(score)], schema=schema)


def _tighten(found, held, reach, square, length, k):
    """Keep the k best of every query and shorten its reach to the k-th."""
    q, score, v = (np.concatenate(x) for x in zip(*found))
    at = _best(q, score, v, k)
    q, score, v = q[at], score[at], v[at]
    held[:] = np.bincount(q, minlength=len(held))
    last = np.flatnonzero(np.r_[q[1:] != q[:-1], True])
    # A score at the least bigint may stand for a smaller one and bounds nothing.
    full = last[(held[q[last]] >= k) & (score[last] > -(1 << 63))]
    reach[q[full]] = np.minimum(reach[q[full]], np.sqrt(np.maximum(square + length[q[full]] - 2.0 * score[full], 0.0)))
    return q, score, v


def _bins(objects: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bin, number of bins) of each subtree: neighbours share a bin of ``most`` rows, a larger subtree has bins of its own."""
    base, parts, n = np.zeros(len(count), np.int64), np.ones(len(count), np.int64), 0
    todo = [np.flatnonzero(count > 0)]
    while todo:
        at = todo.pop()
        if len(at) > 1 and count[at].sum() > most:
            side = np.ptp(objects[at], axis=0).argmax()
            at = at[np.argsort(objects[at, side], kind="stable")]
            half = np.searchsorted(np.cumsum(count[at]), count[at].sum() / 2, "right")
            half = min(max(1, half), len(at) - 1)
            todo += [at[half:], at[:half]]
        elif len(at):
            base[at], parts[at] = n, max(1, -(-count[at].sum() // most))
            n += parts[at[0]]
    return base, parts


def top_k(vectors: DataFrame, is_query, k: int = 20, routers: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k stored vectors with the highest inner product for every query.

    ``vectors`` holds (vec_id bigint, v array<bigint>) with distinct ids (``whole_vectors``); ``is_query`` is a condition on it. A query's own row is no
    candidate. Ties go to the smaller vec_id; with fewer than k candidates all come. Shorter vectors count as filled with zeros. Scores are exact
    whatever their size; those beyond a bigint count as the nearest bigint. An empty table, or one without queries, gives an empty result.
    """
    spark = vectors.sparkSession
    vectors = session.cut(vectors)
    squares = vectors.select(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("s"), F.size("v").alias("w"))
    n, square, width, asked = [*squares.agg(F.count("*"), F.max("s"), F.max("w")).first(), vectors.where(is_query).count()]
    result = "query_id bigint, vec_id bigint, score bigint"
    if not n or not asked:
        return spark.createDataFrame([], result).select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    wanted = routers or int(np.clip(-(-n // CELL), 1, MAX_ROUTERS))
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).toArrow()
    objects = _lift(_matrix(sample.column("v"), width), square)

    def assign(batches):
        for batch in (big.slice(i, SLICE) for big in batches for i in range(0, big.num_rows, SLICE)):
            d = _distances(_lift(_matrix(batch.column("v"), width), square), objects)
            cell = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), batch.column("vec_id"), pa.array(d[np.arange(len(cell)), cell]), batch.column("v")], names=["cell", "vec_id", "parent", "v"])

    entries = session.cut(vectors.mapInArrow(assign, "cell int, vec_id bigint, parent double, v array<bigint>"))
    # One row per routing object: its ring and the bins that its subtree is in.
    rings = {r["cell"]: r for r in entries.groupBy("cell").agg(F.count("*").alias("n"), F.min("parent").alias("low"), F.max("parent").alias("high")).collect()}
    blocks = -(-asked // QUERIES)
    rows = int(np.clip(n * blocks // (4 * spark.sparkContext.defaultParallelism), SMALL, SUBTREE))
    base, parts = _bins(objects, np.array([rings[c]["n"] if c in rings else 0 for c in range(len(objects))]), rows)
    cells = np.array(sorted(rings))
    cells = cells[np.argsort(base[cells], kind="stable")]
    low, high = (np.array([rings[c][x] for c in cells]) for x in ("low", "high"))
    heads = np.flatnonzero(np.r_[True, base[cells][1:] != base[cells][:-1]])
    shares = parts[cells[heads]]

    cell = F.col("cell")
    stored = entries.withColumn("bin", (F.lit(base.tolist())[cell] + F.pmod(F.xxhash64("vec_id"), F.lit(parts.tolist())[cell])).cast("int"))
    stored = stored.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visits(first: bool):
        def run(batches):
            for batch in (big.slice(i, SLICE) for big in batches for i in range(0, big.num_rows, SLICE)):
                x = _matrix(batch.column("v"), width)
                d = _distances(np.hstack([x, np.zeros((len(x), 1))]), objects[cells])
                bound = np.maximum(np.maximum(low[None, :] - d, d - high[None, :]), 0.0)
                if first:
                    nearest = np.lexsort((d, bound), axis=1)[:, 0] if len(x) else np.zeros(0, np.int64)
                    q, b = np.arange(len(x)), np.searchsorted(heads, nearest, "right") - 1
                    part = np.zeros(len(x), np.int64)
                    reach = np.full(len(x), np.inf)
                else:
                    reach = batch.column("reach").to_numpy()
                    on = np.minimum.reduceat(bound, heads, axis=1) <= (reach + _slack(width, square) * (1.0 + np.sqrt(square + (x * x).sum(1))))[:, None]
                    q, b = np.nonzero(on)
                    times = shares[b]
                    q, b = np.repeat(q, times), np.repeat(b, times)
                    part = np.arange(len(q)) - np.repeat(np.cumsum(times) - times, times)
                to = base[cells[heads]][b] + part
                for i in range(0, len(q), SENT):
                    rows = batch.take(pa.array(q[i : i + SENT]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(to[i : i + SENT].astype(np.int32)), rows.column("vec_id"), pa.array(reach[q[i : i + SENT]]), rows.column("v")],
                        names=["bin", "vec_id", "reach", "v"],
                    )

        return run

    asks = "bin int, vec_id bigint, reach double, v array<bigint>"
    key = ["bin", "block"]
    block_of = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")

    def search(pages: pa.Table, queries: pa.Table) -> pa.Table:
        return _search(pages, queries, objects, width, square, k)

    queries = vectors.where(is_query)
    near = queries.mapInArrow(visits(True), asks).select("*", block_of)
    first = stored.groupBy(*key).cogroup(near.groupBy(*key)).applyInArrow(search, result)
    kth = first.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    reach = F.when((F.col("n") >= k) & (F.col("kth") > -(1 << 63)), F.sqrt(F.greatest(F.lit(float(square)) + length - 2.0 * F.col("kth"), F.lit(0.0)))).otherwise(F.lit(float("inf")))
    queries = queries.join(kth, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", reach.alias("reach"))
    rest = queries.mapInArrow(visits(False), asks).select("*", block_of)
    found = stored.groupBy(*key).cogroup(rest.groupBy(*key)).applyInArrow(search, result)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vec_id"))
    return found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
