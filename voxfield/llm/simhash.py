"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has 64 bits; bit b is 1 if it is 1 in more than half of the hashes of a text's shingles. Fingerprints link
if they differ in at most ``RADIUS`` bits; classes are the connected components of the links.

Equal fingerprints are one node. Six bands of bits: two fingerprints that differ in at most four bits agree on at least two whole bands, so they
meet under one of 15 band pairs. Under a key they are compared bit-sliced: plane b holds bit b of all
fingerprints, one per lane of a 64-bit word; a plane XOR itself shifted by d lanes gives bit b of the difference of all pairs d apart, which
carry-save counters add up, 64 pairs at a time. Blocks of lanes whose counts all exceed the radius are abandoned.
Only links that join two components of their key leave the task, so a group of n copies gives n - 1 links, not n squared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield import session
from voxfield.llm.blocks import give_back, parts
from voxfield.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: First bits of the bands.
BANDS = (0, 11, 22, 33, 44, 54, 64)
#: Fingerprints under one key that are compared in one task; a larger key is compared block by block.
BLOCK = 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: Hashes whose bits are counted at once.
COUNT = 1 << 16
#: Planes between two looks for blocks to abandon.
LOOK = 8


def fingerprint(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text; 0 for a text without words."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(size)
    starts, ends = (end - size)[: len(words) - width + 1].tolist(), (end[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_digest
    ones = np.zeros(64, np.int64)
    for a in range(0, len(starts), COUNT):
        raw = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[a : a + COUNT], ends[a : a + COUNT])])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every text as a signed 64-bit number."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "fp"])
            give_back()

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id bigint, fp bigint")


def _planes(fp: np.ndarray) -> np.ndarray:
    """64 planes of one bit per fingerprint, in words of 64 lanes and one word more."""
    n = len(fp)
    bits = np.zeros((64, (n // 64 + 2) * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def _exceeds(ones, twos, fours, more, radius: int):
    """Lanes whose count is over ``radius`` (below 8)."""
    over, even = more.copy(), ~more
    for bit, plane in ((4, fours), (2, twos), (1, ones)):
        if radius & bit:
            even &= plane
        else:
            over |= even & plane
            even &= ~plane
    return over


def _near(planes: np.ndarray, lanes: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Lanes i, among those set in ``lanes``, whose fingerprint and the one ``shift`` lanes on differ in at most ``radius`` bits."""
    at = np.flatnonzero(lanes)
    alive = lanes[at]
    skip, bit = np.uint64(shift // 64), np.uint64(shift % 64)
    low = at + int(skip)
    high = np.minimum(low + 1, planes.shape[1] - 1)
    ones, twos, fours, more = (np.zeros(len(at), np.uint64) for _ in range(4))
    for b in range(0, 64, 2):
        x, y = (planes[c, at] ^ ((planes[c, low] >> bit) | (planes[c, high] << (np.uint64(64) - bit) if bit else np.uint64(0))) for c in (b, b + 1))
        # Carry-save step: ones + x + y = 2 * carry + ones'.
        half = ones ^ x
        carry = (ones & x) | (half & y)
        ones = half ^ y
        next_carry = twos & carry
        twos ^= carry
        more |= fours & next_carry
        fours ^= next_carry
        if b % LOOK == LOOK - 2:
            alive &= ~_exceeds(ones, twos, fours, more, radius)
            hold = np.flatnonzero(alive)
            if not len(hold):
                return hold
            if len(hold) < len(at):
                at, low, high, alive, ones, twos, fours, more = (v[hold] for v in (at, low, high, alive, ones, twos, fours, more))
    word, lane = np.nonzero(np.unpackbits(alive.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return at[word] * 64 + lane


def _lanes(on: np.ndarray, words: int) -> np.ndarray:
    out = np.zeros(words * 64, np.uint8)
    out[: len(on)] = on
    return np.packbits(out, bitorder="little").view("<u8")


def spanning_links(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links (first, second) that connect what is within ``radius`` inside each group: a spanning forest of each component.

    ``group`` is sorted. All pairs ``shift`` places apart are compared at once, for shift 1, 2, ... Pairs already in one component are not
    compared, and groups that are one component, or have no more pairs, are left out from time to time.
    """
    root = np.arange(len(fp))
    at, first, second, shift = root.copy(), [], [], 1
    planes = _planes(fp)
    while shift < len(at):
        same = group[at[:-shift]] == group[at[shift:]]
        if not same.any():
            break
        apart = same & (root[at[:-shift]] != root[at[shift:]])
        hit = _near(planes, _lanes(apart, planes.shape[1]), shift, radius)
        for i, j in zip(at[hit].tolist(), at[hit + shift].tolist()):
            a, b = i, j
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                first.append(i)
                second.append(j)
        while len(hit) and (root[root] != root).any():
            root = root[root]
        shift += 1
        if shift >= 4 and shift & (shift - 1) == 0:
            heads = np.flatnonzero(np.r_[True, group[at[1:]] != group[at[:-1]]])
            size = np.diff(np.r_[heads, len(at)])
            done = (size <= shift) | (np.minimum.reduceat(root[at], heads) == np.maximum.reduceat(root[at], heads))
            if done.any():
                at = at[~np.repeat(done, size)]
                planes = _planes(fp[at])
    return np.array(first, np.int64), np.array(second, np.int64)


def _links(table: pa.Table) -> pa.Table:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    key, fp = table.column("key").to_numpy(), table.column("fp").to_numpy()
    order = np.lexsort((fp, key))
    key, fp = key[order], fp[order]
    twin = key[1:] == key[:-1]
    at = np.flatnonzero(np.r_[False, twin] | np.r_[twin, False])
    if not len(at):
        return schema.empty_table()
    a, b = spanning_links(key[at], fp[at].view(np.uint64))
    return pa.table([fp[at][a], fp[at][b]], schema=schema)


def links(fps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, b): links between different fingerprints, enough to connect every class. ``fps`` holds distinct ``fp``."""
    n = parts(fps.sparkSession)
    masks = [sum(((1 << BANDS[i + 1]) - (1 << BANDS[i])) for i in pair) for pair in combinations(range(len(BANDS) - 1), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = fps.select("fp", F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m).cast("bigint"))) for i, m in enumerate(signed)])).alias("key"))
    # A key of many fingerprints is dealt into blocks, and every pair of blocks is a task's work of its own.
    big = keys.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > block).select(F.col("key").alias("big"), F.ceil(F.col("size") / block).alias("blocks"))
    keys = keys.join(big, F.col("key") == F.col("big"), "left").withColumn("s", F.pmod(F.xxhash64("fp"), F.coalesce("blocks", F.lit(1))))
    keys = keys.withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("blocks", F.lit(1)) - 1)))
    keys = keys.select("fp", F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("s", "p"), F.greatest("s", "p"))).alias("key"))
    return keys.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).groupBy("part").applyInArrow(_links, "a bigint, b bigint")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): the near-duplicate class of every document, named by its smallest doc_id.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. One row per input row, equal rows included. Texts without words, null ones
    too, have fingerprint zero and link like any other. Rows without a doc_id take part; a class of such rows
    only has a null component_id. An empty table gives an empty result.
    """
    found = session.cut(fingerprints(docs))
    reps = session.cut(found.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    nodes = components(links(reps.select("fp")))
    reps = reps.join(nodes, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    least = reps.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = reps.join(least, "component").select(F.col("fp").alias("f"), "component_id")
    return found.join(named, F.col("fp") == F.col("f")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
