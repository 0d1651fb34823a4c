"""Hard negatives by a vertical scan with branch-and-bound on dimensions (BOND).

Vectors lie in pages, column by column. An anchor reads a page's columns in the order of its own components' magnitude, largest first, a
few at a time, and adds their products to the partial scores of the candidates in its bitmap. What the unread columns can still add
lies between sums of least and greatest products, known from each column's minimum and maximum. A candidate goes once its score can
reach no window any more, or once enough others are sure to lie in the window and above the best it can reach. What is left after the last
column has its exact score.

The scan runs twice: for the positives (candidates of the anchor's label, one window without bounds) and, with their scores, for the negatives
(candidates of other labels, one window per positive).
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxfield import session
from voxfield.llm import blocks as B

#: Rows of a page, anchors of a chunk, and rows below which no further page is made for more parallel work.
PAGE, CHUNK, SMALL = 1 << 16, 1 << 13, 1 << 11
#: Columns read between two looks at the bounds.
COLUMNS = 16
#: Components are held within +-2^55, so that scores of up to 2^16 components fit 38 digits.
LARGEST = float(1 << 55)
SCORE = pa.decimal128(38, 0)


def whole_rows(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v array<bigint>): floor(scale * x) of every component as a double, components beyond 2^55 as 2^55.

    Rows without an id or label, null vectors and vectors that hold a null or non-finite component are left out. Of rows that share a
    vec_id the one with the smallest vector, then the smallest label, stays. ``vectors`` holds vec_id, embedding and label.
    """
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    whole = F.transform("embedding", lambda x: F.floor(F.greatest(F.least(x.cast("double") * scale, F.lit(LARGEST)), F.lit(-LARGEST))).cast("bigint"))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.struct(whole.alias("v"), F.col("label").cast("bigint").alias("label")).alias("r"))
    return rows.groupBy("vec_id").agg(F.min("r").alias("r")).select("vec_id", "r.label", "r.v")


def _columns(v: pa.ChunkedArray, width: int) -> np.ndarray:
    """One row per dimension, in the smallest whole type; shorter vectors are filled with zeros."""
    v = v.combine_chunks()
    size = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False)
    out = np.zeros((len(size), width), np.int64)
    out[np.arange(width) < size[:, None]] = v.flatten().to_numpy(zero_copy_only=False)
    low, high = (out.min(), out.max()) if out.size else (0, 0)
    kind = next(k for k in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
    return out.T.astype(kind)


def _packed(rows: DataFrame, key: str, width: int) -> DataFrame:
    """(key, body): the rows of each key, column by column; ``goals`` (positives and their scores, as text) go along."""

    def run(t: pa.Table) -> pa.Table:
        body = B.arrays_to_bytes(vec=t.column("vec_id").to_numpy(), label=t.column("label").to_numpy(), v=_columns(t.column("v"), width).ravel())
        goals = t.column("goals").combine_chunks() if "goals" in t.column_names else pa.nulls(t.num_rows, pa.string())
        return pa.table([t.column(key).slice(0, 1), pa.array([body], pa.binary()), pa.array([goals.to_pylist()], pa.list_(pa.string()))], names=[key, "body", "goals"])

    return rows.groupBy(key).applyInArrow(B.one(run), f"{key} int, body binary, goals array<string>")


def scan(columns: np.ndarray, anchor: np.ndarray, on: np.ndarray, vec: np.ndarray, windows: list[tuple], k: int, read: list | None = None) -> list[tuple]:
    """For each window (low, high; None: no bound) the places and scores of the k best candidates inside it, best first.

    ``columns`` are whole numbers, (dimensions, rows); ``on`` are the places of the candidates. Higher scores come first, ties by
    smaller ``vec``. Numbers are doubles where every sum is exact in them, else Python's whole numbers.
    """
    low, high = (columns.min(1), columns.max(1)) if columns.shape[1] else (columns[:, :0].sum(1),) * 2
    least, most = np.minimum(anchor * low, anchor * high), np.maximum(anchor * low, anchor * high)
    order = np.argsort(-np.abs(anchor.astype(np.float64)), kind="stable")
    rest_low = np.append(np.cumsum(least[order][::-1])[::-1], 0)
    rest_high = np.append(np.cumsum(most[order][::-1])[::-1], 0)
    part = np.zeros(len(on), columns.dtype)
    for a in range(0, len(order), COLUMNS):
        dims = order[a : a + COLUMNS]
        if read is not None:
            read.append(len(dims) * len(on))
        part = part + anchor[dims] @ (columns[dims] if len(on) == columns.shape[1] else columns[np.ix_(dims, on)])
        below, above = part + rest_low[a + len(dims)], part + rest_high[a + len(dims)]
        keep = np.zeros(len(on), bool)
        for lo, hi in windows:
            fits, sure = np.ones(len(on), bool), np.ones(len(on), bool)
            if lo is not None:
                fits &= above >= lo
                sure &= below >= lo
            if hi is not None:
                fits &= below <= hi
                sure &= above <= hi
            if np.count_nonzero(sure) >= k:
                found = below[sure]
                kth = np.partition(found, len(found) - k)[len(found) - k] if found.dtype != object else np.sort(found)[-k]
                fits &= above >= kth
            keep |= fits
        on, part = on[keep], part[keep]
        if not len(on):
            break
    out = []
    for lo, hi in windows:
        inside = np.ones(len(on), bool)
        if lo is not None:
            inside &= part >= lo
        if hi is not None:
            inside &= part <= hi
        at = np.flatnonzero(inside)
        at = at[np.lexsort((vec[on[at]], -part[at]))][:k] if len(at) else at
        out.append((on[at], part[at]))
    return out


def window_of(score: int, low: int, high: int) -> tuple[int, int]:
    """Whole scores s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def _meet(pages: DataFrame, chunks: DataFrame, n_pages: int, n_chunks: int, width: int, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, positive_id, positive_score, vec_id, score): the k best of every page for each anchor, or each of its positives."""
    schema = pa.schema([("anchor_id", pa.int64()), ("positive_id", pa.int64()), ("positive_score", SCORE), ("vec_id", pa.int64()), ("score", SCORE)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {c: [] for c in schema.names}
        if left.num_rows and right.num_rows:
            p, a = (B.arrays_from_bytes(t.column("body")[0].as_py()) for t in (left, right))
            stored, asked = p["v"].reshape(width, -1), a["v"].reshape(width, -1)
            bound = width * float(np.abs(stored.astype(np.float64)).max(initial=0)) * float(np.abs(asked.astype(np.float64)).max(initial=0))
            kind = np.float64 if bound < 2**52 else object
            stored, asked = stored.astype(kind), asked.astype(kind)
            for i, goals in enumerate(right.column("goals")[0].as_py()):
                same = p["label"] == a["label"][i]
                if goals is None:
                    on, aims, windows = np.flatnonzero(same & (p["vec"] != a["vec"][i])), [(None, None)], [(None, None)]
                else:
                    aims = [tuple(map(int, g.split(":"))) for g in goals.split(",")]
                    windows = [window_of(score, low, high) for _, score in aims]
                    on = np.flatnonzero(~same)
                if len(on):
                    for (positive, reached), (at, score) in zip(aims, scan(stored, asked[:, i], on, p["vec"], windows, k)):
                        rows["anchor_id"] += [int(a["vec"][i])] * len(at)
                        rows["positive_id"] += [positive] * len(at)
                        rows["positive_score"] += [None if reached is None else Decimal(reached)] * len(at)
                        rows["vec_id"] += p["vec"][at].tolist()
                        rows["score"] += [Decimal(int(s)) for s in score]
        return pa.table(rows, schema=schema)

    pages = pages.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    chunks = chunks.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(n_pages - 1))))
    out = "anchor_id bigint, positive_id bigint, positive_score decimal(38,0), vec_id bigint, score decimal(38,0)"
    return pages.groupBy("page", "chunk").cogroup(chunks.groupBy("page", "chunk")).applyInArrow(B.two(run), out)


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, page: int = PAGE, chunk: int = CHUNK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows (vec_id, label, v) of ``whole_rows``.

    A score is the inner product with the anchor, exact for any size; higher scores come first, ties by smaller vec_id. The positives of an anchor
    (a row for which the condition ``is_anchor`` holds) are its first ``positives`` other rows of the same label. For each, the first
    ``negatives`` rows of another label whose score is ``low`` to ``high`` per cent of the positive's come, in ranks from 1. A positive with
    a negative score has none. Scores beyond a bigint are returned as the nearest one. Shorter vectors count as filled with zeros. An
    empty table, one without anchors, or one of a single label gives an empty result.

    Pages hold about ``page`` rows by hash of the id, chunks about ``chunk`` anchors; every page meets every chunk once in each scan and
    returns a bounded number of rows per anchor.
    """
    spark = vectors.sparkSession
    vectors = session.cut(vectors)
    n, width, asked = vectors.agg(F.count("*"), F.max(F.size("v")), F.count_if(is_anchor)).first()
    if not n or not asked:
        session.free(vectors)
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    tasks = 2 * spark.sparkContext.defaultParallelism
    n_pages, n_chunks = max(-(-n // page), min(tasks, -(-n // SMALL))), -(-asked // chunk)
    place = lambda m, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(m)).cast("int")
    pages = session.cut(_packed(vectors.withColumn("page", place(n_pages, 1)), "page", width))
    anchors = vectors.where(is_anchor).withColumn("chunk", place(n_chunks, 2))

    found = _meet(pages, _packed(anchors, "chunk", width), n_pages, n_chunks, width, positives, low, high)
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
    goal = F.concat(F.col("vec_id"), F.lit(":"), F.col("score"))
    goals = found.groupBy("anchor_id").agg(F.array_join(F.sort_array(F.collect_list(goal)), ",").alias("goals"))
    anchors = session.cut(anchors.join(goals, F.col("vec_id") == F.col("anchor_id")).select("vec_id", "label", "v", "chunk", "goals"))

    found = _meet(pages, _packed(anchors, "chunk", width), n_pages, n_chunks, width, negatives, low, high)
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "vec_id")
    within = lambda c: F.greatest(F.least(c, F.lit(2**63 - 1).cast("decimal(38,0)")), F.lit(-(2**63)).cast("decimal(38,0)")).cast("bigint")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    out = found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), *[within(F.col(c)).alias(d) for c, d in (("positive_score", "positive_score"), ("score", "negative_score"))])
    out = session.cut(out)
    session.free(vectors, pages, anchors)
    return out
