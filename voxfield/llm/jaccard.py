"""Near-duplicates by the Jaccard similarity of word shingles.

Two texts link if their sets of ``WIDTH``-word shingles have a similarity of ``SIMILARITY`` or more; classes are the connected components
of the links. Equal sets are one node. Candidates are nodes that agree in one of ``BANDS`` keys of ``ROWS`` MinHash minima: at similarity 0.8 a
pair shares no key with probability (1 - 0.8^5)^32 = 3e-6, at a higher one less. Each candidate pair is compared by its whole
sets, so no link is an estimate, or is left out because both are in one component already.

Under a key, centres are compared with the others, one centre in the first round, up to twice as many in each further round. A
centre is done with its key; a key whose nodes are one component, too. A group of n near copies is compared about n times a key instead of n squared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield import session
from voxfield.llm import blocks as B
from voxfield.llm.components import components

WIDTH = 5
SIMILARITY = 0.8
ROWS, BANDS = 5, 32
SEED = 42
#: Text bytes that are taken apart at once.
SLICE = 2 << 20


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """Distinct shingle hashes of each text, sorted; a shorter text is one shingle, a text without words has none."""
    w = B.Words(texts, lower=True)
    size = np.diff(w.first)
    at = np.flatnonzero(w.first[w.text_of() + 1] - np.arange(len(w)) >= width)
    h = B.window_hash(w.hash, at, width)
    bounds = np.searchsorted(at, w.first)
    return [
        np.unique(h[bounds[t] : bounds[t + 1]]) if size[t] >= width else B.window_hash(w.hash, w.first[t : t + 1], size[t])[: size[t]]
        for t in range(len(size))
    ]


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)


def band_keys(sets: list[np.ndarray]) -> list[np.ndarray]:
    """``BANDS`` keys of each set; an empty set has none."""
    rng = np.random.default_rng(SEED)
    odd, turn = (rng.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) for _ in range(2))
    full = [s for s in sets if len(s)]
    if not full:
        return [np.zeros(0, np.int64) for _ in sets]
    h = np.concatenate(full)
    heads = np.cumsum([0] + [len(s) for s in full[:-1]])
    keys, x = np.empty((len(full), BANDS), np.uint64), np.empty_like(h)
    for band in range(BANDS):
        key = np.full(len(full), band + 1, np.uint64)
        for j in range(band * ROWS, (band + 1) * ROWS):
            np.bitwise_xor(h, turn[j], out=x)
            np.multiply(x, odd[j] | B.U(1), out=x)
            key = B.mix(key * B.MIX_A ^ np.minimum.reduceat(x, heads))
        keys[:, band] = key
    found = iter(keys.view(np.int64))
    return [next(found) if len(s) else np.zeros(0, np.int64) for s in sets]


def _slices(batch: pa.RecordBatch, *columns: str):
    """Parts of a batch with about ``SLICE`` bytes in the named text columns."""
    size = sum(pc.binary_length(batch.column(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    cut = np.flatnonzero(np.diff(np.cumsum(size) // SLICE, prepend=0, append=-1))
    for a, b in zip(np.r_[0, cut[:-1]], cut):
        if b > a:
            yield batch.slice(a, b - a)


def signatures(docs: DataFrame) -> DataFrame:
    """(k0, k1, node, bands) of each row of (k0, k1, text): the hash of its shingle set, and its band keys."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                node = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                bands = pa.array(band_keys(sets), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("k0"), part.column("k1"), pa.array(node), bands], names=["k0", "k1", "node", "bands"])
            B.give_back()

    return docs.mapInArrow(run, "k0 bigint, k1 bigint, node bigint, bands array<bigint>")


def alike(pairs: DataFrame) -> DataFrame:
    """(a, b) of the rows (a, b, a_text, b_text) whose texts have the similarity."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "a_text", "b_text"):
                a = part.column("a").to_numpy()
                heads = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                first = shingle_sets(part.column("a_text").take(pa.array(heads)))
                of = np.searchsorted(heads, np.arange(len(a)), "right") - 1
                hit = [similarity(first[i], s) >= SIMILARITY for i, s in zip(of, shingle_sets(part.column("b_text")))]
                yield part.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))
            B.give_back()

    return pairs.mapInArrow(run, "a bigint, b bigint")


def row_key(docs: DataFrame) -> list:
    """Columns _k0, _k1: 128 bits of hash of a whole row."""
    parts = [x for c in docs.columns for x in (docs[c].isNull(), docs[c])]
    return [F.xxhash64(F.lit(i), *parts).alias(f"_k{i}") for i in range(2)]


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the keys that still hold more than one component."""
    open_keys = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("key")
    return members.join(open_keys, "key")


def classes(docs: DataFrame) -> DataFrame:
    """(k0, k1, component): the near-duplicate class of every row (k0, k1, text). Equal texts are of one class, so are all without words."""
    sign = session.cut(signatures(docs))
    keys = sign.dropDuplicates(["node"]).select("node", F.explode("bands").alias("key")).distinct()
    members = session.cut(_mixed(keys.withColumn("comp", F.col("node"))))
    wanted = members.select("node").distinct()
    rows = sign.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("k0", "k1")).alias("k")).select("node", "k.k0", "k.k1")
    texts = session.cut(docs.join(rows, ["k0", "k1"]).select("node", "text").dropDuplicates(["node"]))
    a_text, b_text = (texts.select(F.col("node").alias(c), F.col("text").alias(f"{c}_text")) for c in "ab")
    links, named, centres = None, None, 1
    while members.take(1):
        salt = F.pmod(F.xxhash64(F.col("node"), F.lit(centres)), F.lit(centres))
        middle = members.groupBy("key", salt.alias("salt")).agg(F.min(F.struct("node", "comp")).alias("m"))
        middle = session.cut(middle.select("key", F.col("m.node").alias("centre"), F.col("m.comp").alias("c_comp")))
        pairs = members.join(middle, "key").where("comp <> c_comp").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
        new = alike(pairs.join(b_text, "b").join(a_text, "a").select("a", "b", "a_text", "b_text"))
        links, old = session.cut(new if links is None else links.unionByName(new)), links
        named = components(links)
        left = members.join(middle, (members.key == middle.key) & (members.node == middle.centre), "left_anti").select("key", "node")
        left = left.join(named, "node", "left").select("key", "node", F.coalesce("component", "node").alias("comp"))
        after = session.cut(_mixed(left))
        session.free(members, middle, *([old] if old is not None else []))
        members, centres = after, 2 * centres
    found = sign.select("k0", "k1", "node")
    if named is None:
        return found.withColumnRenamed("node", "component")
    return found.join(named, "node", "left").select("k0", "k1", F.coalesce("component", "node").alias("component"))


def first_rows(docs: DataFrame) -> DataFrame:
    """One row of each class, by the smallest doc_id; a missing one is larger than any other, ties go by the hash of the row.

    ``docs`` needs ``doc_id`` and ``text``. Rows are told apart as a whole, so ids may be null or shared; of equal rows one stays.
    """
    keyed = docs.select("*", *row_key(docs))
    named = classes(keyed.select(F.col("_k0").alias("k0"), F.col("_k1").alias("k1"), F.col("text").cast("string").alias("text"))).distinct()
    named = named.select(F.col("k0").alias("_k0"), F.col("k1").alias("_k1"), "component")
    rows = keyed.select("_k0", "_k1", F.col("doc_id").alias("id")).join(named, ["_k0", "_k1"])
    least = rows.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "_k0", "_k1")).alias("m"))
    return keyed.join(least.select("m._k0", "m._k1"), ["_k0", "_k1"]).dropDuplicates(["_k0", "_k1"]).select(*docs.columns)
