"""Mixing sources to target weights by the cube method.

Each source gets a target share of all words; a document is taken floor(target / size) times for sure and once more with a
probability, the same for all documents of its source. Which documents are taken once more is drawn by balanced
sampling: the flight phase moves the vector of probabilities along the null space of the constraints (expected words, expected
documents) until all but a few are 0 or 1, so each source keeps its expected words and documents exactly; the landing phase
rounds the few that are left.

Documents fly in blocks of bounded size. A block leaves at most as many open documents as there are
constraints; the open ones of many blocks meet in the next round, until one block per source is left, which lands.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxfield import session

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3.0
#: Documents that fly together.
BLOCK = 4096
#: Blocks whose open documents meet in the next round.
FAN = 512
#: Sources are a short list that the driver sees as a whole (names and sums only).
MAX_SOURCES = 100_000
EPS = 1e-9


def words(text) -> F.Column:
    """Number of runs of characters that are not ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("bigint")


def targets(sizes: list[int], weights=WEIGHTS, most: float = MOST) -> list[float]:
    """Words that each source gives: shares by weight of all words, none above ``most`` times its own size.

    What a full source cannot take is shared out again among the others by weight, until no target is above its limit.
    """
    total, w = float(sum(sizes)), [weights[i % len(weights)] for i in range(len(sizes))]
    full: set[int] = set()
    while True:
        left = total - sum(most * sizes[i] for i in full)
        weight = sum(w[i] for i in range(len(sizes)) if i not in full)
        out = [most * s if i in full else left * w[i] / weight for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if i not in full and out[i] > most * s}
        if not over:
            return out
        full |= over


def _flight(p: np.ndarray, size: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Flight phase: sum(p) and sum(p * size) stay as they are while all units but two or so become 0 or 1.

    Units come by falling size. Each moves until it is 0 or 1, along its own axis projected onto the null space of both
    constraints over the units still open, so the many open ones each make up for a little of it; up or down with the chances that
    keep every expectation. What stays open at the end is small.
    """
    p = np.where(p < EPS, 0.0, np.where(p > 1 - EPS, 1.0, p))
    scaled = size / max(size.max(initial=0.0), 1.0)
    for i in range(len(p)):
        tries = 0
        while 0.0 < p[i] < 1.0:
            q, s = p[i:], scaled[i:]
            m = ((q > 0) & (q < 1)).astype(float)
            n, s1, s2 = m.sum(), m @ s, m @ (s * s)
            det = n * s2 - s1 * s1
            if det > 1e-12 * max(n * s2, 1.0):
                u = -m * ((s2 - s1 * s[0] + (n * s[0] - s1) * s) / det)
            else:
                u = -m / n
            u[0] += 1.0
            if u[0] < 1e-7:
                break
            u[np.abs(u) < 1e-15] = 0.0
            at = np.flatnonzero(u)
            rate = u[at]
            up = np.where(rate > 0, 1 - q[at], q[at]) / np.abs(rate)
            down = np.where(rate > 0, q[at], 1 - q[at]) / np.abs(rate)
            up, down = up.min(), down.min()
            chance = (draws[i] + tries * 0.6180339887498949) % 1.0
            q[at] += (up if chance * (up + down) < down else -down) * rate
            q[q < EPS] = 0.0
            q[q > 1 - EPS] = 1.0
            tries += 1
    return p


def _land(p: list[float], size: list[float]) -> list[float]:
    """Landing phase: the choice of the few open units nearest to the expected words, then to the expected number."""
    open_ = [i for i, x in enumerate(p) if 0.0 < x < 1.0]
    words_due, units_due = sum(p[i] * size[i] for i in open_), sum(p[i] for i in open_)
    choices = ([float(c >> k & 1) for k in range(len(open_))] for c in range(1 << len(open_)))
    best = min(choices, key=lambda c: (abs(sum(x * size[i] for x, i in zip(c, open_)) - words_due), abs(sum(c) - units_due)))
    for i, x in zip(open_, best):
        p[i] = x
    return p


def _fly(pdf: pd.DataFrame) -> pd.DataFrame:
    return _flown(pdf, last=False)


def _flown(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "seed"], ascending=False, kind="stable").reset_index(drop=True)
    size = pdf["size"].to_numpy(float)
    draws = (pdf["seed"].to_numpy(np.int64) & ((1 << 53) - 1)) / float(1 << 53)
    p = _flight(pdf["p"].to_numpy(float), size, draws)
    pdf["p"] = _land(p.tolist(), size.tolist()) if last else p
    return pdf


def _fly_last(pdf: pd.DataFrame) -> pd.DataFrame:
    return _flown(pdf, last=True)


def _plan(sums: list, weights, most: float) -> list[tuple]:
    """(source, size, target, sure copies, chance of one more, blocks) for every source."""
    sums = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    out = []
    for r, goal in zip(sums, targets([r["size"] for r in sums], weights, most) if sums else []):
        ratio = goal / r["size"] if r["size"] else 0.0
        sure = int(np.floor(ratio + EPS))
        extra = max(ratio - sure, 0.0)
        out.append((r["source"], r["size"], float(goal), sure, 0.0 if extra < EPS else extra, -(-r["n"] // BLOCK)))
    return out


def draw(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 11) -> DataFrame:
    """(doc_id, source, row_hash, size, source_size, target, copies): how often the mix takes each row of ``docs``.

    ``docs`` needs ``doc_id``, ``text`` and ``source``; sources go by code point, null last, with ``weights`` in turn. One row
    per input row. Equal rows are drawn each for itself. A null or empty text has no words and may be taken, which adds none; a source without
    words has target 0 and is not taken. An empty table gives an empty result. Draws are hashes of the rows, so
    reruns agree.
    """
    spark = docs.sparkSession
    own = [c for c in docs.columns if c in ("doc_id", "text", "source")]
    rows = docs.select("doc_id", "source", F.xxhash64(*own).alias("row_hash"), words("text").alias("size"))
    rows = session.cut(rows.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "source", "row_hash").orderBy("size"))))
    sums = rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(sums) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    found = _plan(sums, weights, most)
    plan = spark.createDataFrame(found, "source_name string, source_size bigint, target double, sure int, p double, blocks int")
    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("source_name")))
    rows = rows.withColumn("seed", F.xxhash64(F.lit(seed), "doc_id", "source", "row_hash", "size", "k"))

    schema = "source string, seed bigint, size bigint, p double, block int"
    units = rows.where("p > 0").select("source", "seed", "size", "p", F.pmod(F.xxhash64("seed"), F.col("blocks")).cast("int").alias("block"))
    blocks, picked = max([r[5] for r in found], default=0), []
    while True:
        last = blocks <= 1
        flown = session.cut(units.groupBy("source", "block").applyInPandas(_fly_last if last else _fly, schema))
        picked.append(flown.where("p = 1").select(F.col("source").alias("s"), F.col("seed").alias("sd"), F.lit(1).alias("more")))
        if last:
            break
        units = flown.where("p > 0 AND p < 1").withColumn("block", F.floor(F.col("block") / FAN).cast("int"))
        blocks = -(-blocks // FAN)
    more = reduce(DataFrame.unionByName, picked)
    rows = rows.join(more, F.col("source").eqNullSafe(F.col("s")) & (F.col("seed") == F.col("sd")), "left")
    copies = (F.col("sure") + F.coalesce("more", F.lit(0))).alias("copies")
    return rows.select("doc_id", "source", "row_hash", "size", "source_size", "target", copies)


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST, seed: int = 11) -> DataFrame:
    """The mixed documents: each row of ``docs``, all its columns, as often as ``draw`` takes it."""
    own = [c for c in docs.columns if c in ("doc_id", "text", "source")]
    drawn = draw(docs, weights, most, seed).groupBy("doc_id", "source", "row_hash").agg(F.sum("copies").alias("_c"), F.count("*").alias("_n"))
    drawn = drawn.where("_c > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("row_hash").alias("_r"), "_c", "_n")
    rows = docs.withColumn("_h", F.xxhash64(*own))
    rows = rows.join(drawn, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_r")))
    # Rows alike in id, source and text share their copies out: the first ones get one more.
    rows = rows.withColumn("_k", F.row_number().over(Window.partitionBy("_d", "_s", "_r").orderBy("_h")))
    times = F.floor(F.col("_c") / F.col("_n")) + F.when(F.col("_k") <= F.col("_c") % F.col("_n"), 1).otherwise(0)
    return rows.withColumn("_t", times).where("_t > 0").withColumn("_t", F.explode(F.sequence(F.lit(1), F.col("_t").cast("int")))).select(*[F.col(c) for c in docs.columns])
