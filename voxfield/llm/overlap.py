"""Similarity join of n-gram sets by size-banded tiles with bitmap signatures.

Two texts link if their sets of word n-grams have a Jaccard similarity of ``percent`` per cent or more. Equal sets are one node.

*Tiles.* Under one order of all n-grams, rare ones first, two linked sets share one of their first |x| - ceil(p |x|) + 1 n-grams. Each node is
listed under these, in the band of its size; bands are wider than the largest ratio of linked sizes, so that a tile (n-gram, band) meets only
itself and its two neighbours. N-grams that one node lists are dropped before rows are made. The order comes from a table of counts by hash of
fixed size (``BUCKETS``), so what a third of all texts hold comes last and is listed by texts that hold little else; any order gives the same links.

*Signatures.* A set's bitmap, one or two bits per n-gram, holds in each bit the parity of the n-grams that fall on it. Bits in which two bitmaps
differ number at most the symmetric difference, so (|a| + |b| - differing) / 2 bounds the overlap from above; a larger bitmap is folded to the
width of a smaller one. Pairs that cannot reach the similarity end there, the others are compared by intersecting their sorted arrays.

*Rounds.* First one centre per tile is compared with the members, which joins most near copies at little cost (``first_rows`` adds the pairs that SimHash
fingerprints propose). Then whole tiles are compared
by bitmap, but only across the components found so far. One round takes a spanning forest of a tile's candidate pairs, those with the closest bitmaps
first; the last takes every candidate pair that is left, so that each pair of a tile is excluded, verified or already connected. Tiles of more than
``TILE`` members are dealt out, and every two of their parts are compared in a group of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxfield import session
from voxfield.llm import blocks as B
from voxfield.llm import simhash
from voxfield.llm.components import components
from voxfield.llm.jaccard import _slices, row_key, shingle_sets
from voxfield.llm.substring import MESSAGE, _bits, _distinct, _messages, _replies, _span

WIDTH, PERCENT = 4, 85
#: Cells of the table of counts, and the ranges that it is summed in.
BUCKETS, RANGES = 1 << 20, 16
#: Listed n-grams that a block holds on average, and below which no further block is made for more parallel work.
BLOCK, SMALL = 1 << 20, 1 << 15
FORESTS = 1
#: Members of one part of a tile, and rows of the tiles that are compared in one group.
TILE, GROUP = 1 << 12, 1 << 14
#: Bits of the sieve that keeps most texts that no pair asks for out of the shuffle.
SIEVE = 1 << 24


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> B.U(64 - int(math.log2(BUCKETS)))).astype(np.int64)


def listed(size: int, percent: int) -> int:
    """How many of its first n-grams a set of ``size`` is listed under."""
    return size - -(-percent * size // 100) + 1


def needed(total, percent: int):
    """Least overlap of two sets with ``total`` members together that reaches the similarity."""
    return -(-percent * total // (100 + percent))


def bitmap(h: np.ndarray) -> bytes:
    """Parities of the hashes on 64 bits or the least power of two that is not below their number."""
    width = max(64, 1 << (len(h) - 1).bit_length())
    on = B.mix(h) & B.U(width - 1)
    return np.packbits((np.bincount(on.astype(np.int64), minlength=width) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(m: np.ndarray, words: int) -> np.ndarray:
    while m.shape[1] > words:
        m = m[:, : m.shape[1] // 2] ^ m[:, m.shape[1] // 2 :]
    return m


def possible(a_size, b_size, a_sign: list[bytes], b_sign: list[bytes], percent: int) -> np.ndarray:
    """Whether the bitmaps leave room for the similarity, pair by pair."""
    out = np.ones(len(a_size), bool)
    a_len, b_len = (np.array([len(s) for s in side], np.int64) for side in (a_sign, b_sign))
    for x, y in set(zip(a_len.tolist(), b_len.tolist())):
        at = np.flatnonzero((a_len == x) & (b_len == y))
        a, b = (_folded(np.frombuffer(b"".join(side[i] for i in at), np.uint64).reshape(len(at), -1), min(x, y) // 8) for side in (a_sign, b_sign))
        total = a_size[at] + b_size[at]
        out[at] = (total - np.bitwise_count(a ^ b).sum(1, dtype=np.int64)) // 2 >= needed(total, percent)
    return out


def tile_pairs(size: np.ndarray, comp: np.ndarray, sign: list[bytes], percent: int, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of pairs of different components that sizes and bitmaps let through; with ``forest``, closest first, as far as they join."""
    order = np.argsort(size, kind="stable")
    size, comp = size[order], comp[order]
    words = np.array([len(sign[i]) // 8 for i in order])
    last = np.searchsorted(size, size * 100 // percent, "right")
    found = []
    for w in np.unique(words):
        rows = np.flatnonzero(words == w)
        own = np.frombuffer(b"".join(sign[order[i]] for i in rows), np.uint64).reshape(len(rows), -1)
        for v in np.unique(words[rows[0] : last[rows[-1]]]):
            if v < w:
                continue
            others = np.flatnonzero(words == v)
            theirs = _folded(np.frombuffer(b"".join(sign[order[i]] for i in others), np.uint64).reshape(len(others), -1), w)
            step = max(1, (1 << 21) // max(1, len(others) * w))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                a, b = np.nonzero((others[None, :] > r[:, None]) & (others[None, :] < last[r][:, None]) & (comp[others][None, :] != comp[r][:, None]))
                differ = np.bitwise_count(own[i : i + step][a] ^ theirs[b]).sum(1, dtype=np.int64)
                a, b = r[a], others[b]
                on = (size[a] + size[b] - differ) // 2 >= needed(size[a] + size[b], percent)
                found.append((a[on], b[on], differ[on]))
    a, b, differ = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
    if forest and len(a):
        names, label = np.unique(comp, return_inverse=True)
        root, keep = list(range(len(names))), []
        for i in np.argsort(differ / (size[a] + size[b]), kind="stable"):
            ends = []
            for x in (label[a[i]], label[b[i]]):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                ends.append(x)
            if ends[0] != ends[1]:
                root[max(ends)] = min(ends)
                keep.append(i)
        a, b = a[keep], b[keep]
    return order[a], order[b]


def _signed(docs: DataFrame, width: int) -> DataFrame:
    """Rows (kind 0: the row's keys, size and 128-bit hash of its set) and counts (kind 1: one row per range and task)."""

    def run(batches):
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for part in _slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                n = part.num_rows
                whole = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                two = np.frombuffer(b"".join(whole), np.int64).reshape(n, 2)
                if n:
                    counts += np.bincount(_bucket(np.concatenate(sets)), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(n), pa.int32()), *(part.column(c) for c in ("doc_id", "r0", "r1")), pa.array([len(s) for s in sets], pa.int64()), pa.array(two[:, 0]), pa.array(two[:, 1]), pa.nulls(n, pa.binary())],
                    names=["kind", "doc_id", "r0", "r1", "n", "s0", "s1", "body"],
                )
            B.give_back()
        body = [B.arrays_to_bytes(n=c) for c in counts.reshape(RANGES, -1)]
        none = pa.nulls(RANGES, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(RANGES), pa.int32()), none, none, none, pa.array(np.arange(RANGES), pa.int64()), none, none, pa.array(body, pa.binary())],
            names=["kind", "doc_id", "r0", "r1", "n", "s0", "s1", "body"],
        )

    return docs.mapInArrow(run, "kind int, doc_id bigint, r0 bigint, r1 bigint, n bigint, s0 bigint, s1 bigint, body binary")


def _order(counts: DataFrame) -> np.ndarray:
    """Place of each cell among all cells by its count, in 16 bits. The table has a fixed size."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(B.arrays_from_bytes(m)["n"] for m in t.column("body").to_pylist())
        return pa.table([t.column("n").slice(0, 1), pa.array([total.tobytes()], pa.binary())], names=["n", "body"])

    found = {r.n: np.frombuffer(r.body, np.int64) for r in counts.groupBy("n").applyInArrow(add, "n bigint, body binary").collect()}
    total = np.concatenate([found.get(i, np.zeros(BUCKETS // RANGES, np.int64)) for i in range(RANGES)])
    place = np.empty(BUCKETS, np.int64)
    place[np.argsort(total, kind="stable")] = np.arange(BUCKETS)
    return (place // (BUCKETS >> 16)).astype(np.uint16)


def _listings(docs: DataFrame, place: np.ndarray, width: int, percent: int) -> DataFrame:
    """(r0, r1, size, sign, grams): bitmap and listed n-grams of each text."""

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "text"):
                sets = shingle_sets(part.column("text"), width)
                full = np.array([len(s) > 0 for s in sets], bool)
                sets = [s for s in sets if len(s)]
                grams = [s[np.lexsort((s, place[_bucket(s)]))[: listed(len(s), percent)]].view(np.int64) for s in sets]
                rows = part.filter(pa.array(full, pa.bool_()))
                yield pa.RecordBatch.from_arrays(
                    [rows.column("r0"), rows.column("r1"), pa.array([len(s) for s in sets], pa.int64()), pa.array([bitmap(s) for s in sets], pa.binary()), pa.array(grams, pa.list_(pa.int64()))],
                    names=["r0", "r1", "size", "sign", "grams"],
                )
            B.give_back()

    return docs.mapInArrow(run, "r0 bigint, r1 bigint, size bigint, sign binary, grams array<bigint>")


def _shared(sets: DataFrame) -> DataFrame:
    """(gram, node, size): listings of n-grams that two nodes or more list. Repeated rows of a node meet in one block and count once."""
    spark = sets.sparkSession
    total = sets.agg(F.coalesce(F.sum(F.size("grams")), F.lit(0))).first()[0]
    n = max(1, -(-total // BLOCK), min(B.parts(spark), -(-total // SMALL)))
    out = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("size", pa.int64())])

    def read(t: pa.Table):
        rows = B.unpack(t.column("payload"))
        rows = rows.take(pa.array(np.unique(rows.column("node").to_numpy(), return_index=True)[1]))
        grams = rows.column("grams").combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), pa.compute.list_value_length(grams).to_numpy())
        return rows, row, grams.flatten().to_numpy().view(np.uint64)

    def send(t: pa.Table) -> pa.Table:
        rows, row, grams = read(t)
        keys, inverse, bounds = _distinct(grams, n)
        low, high = _span(inverse, rows.column("node").to_numpy()[row], len(keys))
        return _messages(0, t.column("block")[0].as_py(), bounds, key=keys, many=low != high)

    def judge(t: pa.Table) -> pa.Table:
        got = [B.arrays_from_bytes(m) for m in t.column("body").to_pylist()]
        _, inverse, times = np.unique(np.concatenate([g["key"] for g in got]), return_inverse=True, return_counts=True)
        many = np.bincount(inverse, np.concatenate([g["many"] for g in got])) + times > 1
        ends = np.cumsum([len(g["key"]) for g in got])
        body = [B.arrays_to_bytes(bits=np.packbits(many[inverse[e - len(g["key"]) : e]])) for g, e in zip(got, ends)]
        return pa.table([t.column("kind"), t.column("bucket"), t.column("block"), pa.array(body, pa.binary())], names=["kind", "bucket", "block", "body"])

    def keep(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out.empty_table()
        rows, row, grams = read(t)
        _, inverse, bounds = _distinct(grams, n)
        on = np.flatnonzero(_bits(_replies(replies, 0), bounds)[inverse])
        held = rows.select(["node", "size"]).take(pa.array(row[on]))
        return pa.table([pa.array(grams[on].view(np.int64)), *held.columns], schema=out)

    by_block = B.pack(sets, n).groupBy("block")
    answers = by_block.applyInArrow(B.one(send), MESSAGE).groupBy("bucket").applyInArrow(B.one(judge), MESSAGE)
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(B.two(keep), "gram bigint, node bigint, size bigint")


def _arrays(docs: DataFrame, rows: DataFrame, width: int) -> DataFrame:
    """(node, grams): the sorted set of each of the rows (r0, r1, node). A sieve of fixed size by r0 lets few other texts into the join."""
    bit = F.pmod("r0", F.lit(SIEVE)) + 1  # bit positions count from 1
    parts = rows.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    held = np.zeros((SIEVE // 32768, 4096), np.uint8)
    for r in parts.collect():
        held[r.part - 1] = np.frombuffer(r.bits, np.uint8)
    held = held.ravel()

    def sift(batches):
        for batch in batches:
            at = batch.column("r0").to_numpy() % SIEVE
            yield batch.filter(pa.array((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0))

    def run(batches):
        for batch in batches:
            for part in _slices(batch, "text"):
                sets = [s.view(np.int64) for s in shingle_sets(part.column("text"), width)]
                yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "grams"])
            B.give_back()

    texts = docs.mapInArrow(sift, "text string, r0 bigint, r1 bigint").join(rows, ["r0", "r1"]).select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(run, "node bigint, grams array<bigint>")


def _mixed(members: DataFrame) -> DataFrame:
    """Members of the tiles that, together with their two neighbours, still hold more than one component."""
    own = members.groupBy("gram", "band").agg(F.min("comp").alias("low"), F.max("comp").alias("high"))
    near = own.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    open_tiles = near.groupBy("gram", "band").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high")
    return members.join(open_tiles.select("gram", "band"), ["gram", "band"], "left_semi")


def _around_centres(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of each tile's smallest node with members of its own and the neighbouring tiles that sizes and bitmaps let through."""

    def run(batches):
        for batch in batches:
            a_size, b_size = (batch.column(f"{c}_size").to_numpy() for c in "ab")
            hit = possible(a_size, b_size, batch.column("a_sign").to_pylist(), batch.column("b_sign").to_pylist(), percent)
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))

    centres = members.groupBy("gram", "band").agg(F.min(F.struct("node", "size")).alias("m")).select("gram", "band", F.col("m.node").alias("centre"), F.col("m.size").alias("c_size"))
    near = centres.withColumn("band", F.explode(F.array(*[F.col("band") + i for i in (-1, 0, 1)])))
    met = members.join(near, ["gram", "band"]).where(F.col("node") != F.col("centre"))
    met = met.where(F.least("size", "c_size") * 100 >= F.greatest("size", "c_size") * percent)
    met = met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    a, b = (sets.select(F.col("node").alias(c), F.col("size").alias(f"{c}_size"), F.col("sign").alias(f"{c}_sign")) for c in "ab")
    return met.join(b, "b").join(a, "a").mapInArrow(run, "a bigint, b bigint")


def _by_fingerprint(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(a, b): nodes with equal SimHash fingerprints, as stars around the smallest node, and one pair for each link of two fingerprints."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            found = np.array([simhash.fingerprint(t.as_py(), width) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("r0"), batch.column("r1"), pa.array(found)], names=["r0", "r1", "fp"])
            B.give_back()

    found = docs.select("text", "r0", "r1").mapInArrow(run, "r0 bigint, r1 bigint, fp bigint")
    fps = session.cut(found.join(nodes.select("r0", "r1", "node"), ["r0", "r1"]).select("node", "fp").dropDuplicates(["node"]))
    first = session.cut(fps.groupBy("fp").agg(F.min("node").alias("first")))
    equal = fps.join(first, "fp").where("node > first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    a, b = (first.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_node")) for c in "ab")
    linked = simhash.links(first.select("fp")).join(b, "b").join(a, "a")
    out = session.cut(equal.union(linked.select(F.least("a_node", "b_node"), F.greatest("a_node", "b_node"))))
    session.free(fps, first)
    return out


def _across(members: DataFrame, sets: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Distinct (a, b) of candidate pairs between components inside the tiles of every n-gram."""

    def run(t: pa.Table) -> pa.Table:
        key, node, size, comp = (t.column(c).to_numpy() for c in ("key", "node", "size", "comp"))
        sign = t.column("sign").to_pylist()
        order = np.argsort(key, kind="stable")
        out = [np.zeros((2, 0), np.int64)]
        for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            a, b = tile_pairs(size[at], comp[at], [sign[i] for i in at], percent, forest)
            out.append(np.sort(np.stack([node[at[a]], node[at[b]]]), axis=0))
        pairs = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    count = members.count()
    big = members.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > TILE).select("gram", F.ceil(F.col("n") / TILE).cast("int").alias("parts"))
    rows = members.join(big, "gram", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("s", F.pmod(F.xxhash64("node"), "parts").cast("int")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("node", "size", "comp", F.xxhash64("gram", F.least("s", "p"), F.greatest("s", "p")).alias("key")).join(sets.select("node", "sign"), "node")
    groups = max(1, -(-count // GROUP), min(B.parts(members.sparkSession), -(-count // 512)))
    return rows.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")).groupBy("group").applyInArrow(B.one(run), "a bigint, b bigint").distinct()


def _links(pairs: DataFrame, arrays: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets have the similarity."""

    def run(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                hit.append(len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x) + len(y), percent))
            yield batch.select(["a", "b"]).filter(pa.array(hit, pa.bool_()))
            B.give_back()

    x, y = (arrays.select(F.col("node").alias(k), F.col("grams").alias(c)) for k, c in (("a", "x"), ("b", "y")))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _classes(docs: DataFrame, width: int, percent: int, fingerprints: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, r0, r1, n, s0, s1) of (doc_id, text, r0, r1), and the component (s0, s1, least, component) of each non-empty set.

    With ``fingerprints``, the first round also verifies the pairs of ``_by_fingerprint``. It changes no class: other rounds leave no pair out.
    """
    signed = session.cut(_signed(docs, width))
    rows = signed.where("kind = 0").drop("kind", "body")
    place = _order(signed.where("kind = 1").select("n", "body"))
    nodes = rows.where("n > 0").groupBy("s0", "s1").agg(F.min(F.struct("r0", "r1")).alias("r"), F.min("doc_id").alias("least"))
    # Numbers are given while the table is written, and read from it ever after.
    nodes = session.cut(nodes.select("s0", "s1", "r.*", "least", F.monotonically_increasing_id().alias("node")))
    sets = session.cut(_listings(docs.select("text", "r0", "r1"), place, width, percent).join(nodes.select("r0", "r1", "node"), ["r0", "r1"]).select("node", "size", "sign", "grams"))
    step = math.log(1 / (0.99 * percent / 100))
    band = F.floor(F.log(F.col("size").cast("double")) / step).cast("int")
    listed_by = session.cut(_shared(sets.select("node", "size", "grams")).select("gram", band.alias("band"), "node", F.col("node").alias("comp"), "size"))
    members = session.cut(_mixed(listed_by))
    session.free(listed_by)
    links = named = None
    for k in range(FORESTS + 2):
        # The fingerprints' own pairs are verified even where no tile is open.
        if not (fingerprints and not k) and not members.take(1):
            break
        pairs = _across(members, sets, percent, k <= FORESTS) if k else _around_centres(members, sets, percent)
        proposed = _by_fingerprint(docs, nodes, width) if fingerprints and not k else None
        pairs = session.cut(pairs if proposed is None else pairs.union(proposed).distinct())
        session.free(*([proposed] if proposed is not None else []))
        wanted = session.cut(nodes.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "node").select("r0", "r1", "node"))
        arrays = session.cut(_arrays(docs.select("text", "r0", "r1"), wanted, width))
        new = _links(pairs, arrays, percent)
        links, old = session.cut(new if links is None else links.unionByName(new)), links
        session.free(pairs, wanted, arrays, *([old] if old is not None else []), *([named] if named is not None else []))
        named = session.cut(components(links))
        if k <= FORESTS:
            left = members.drop("comp").join(named.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
            members, old = session.cut(_mixed(left.select(*members.columns))), members
            session.free(old)
    session.free(members, sets, *([links] if links is not None else []))
    if named is None:
        return rows, nodes.select("s0", "s1", "least", F.col("node").alias("component"))
    nodes = nodes.join(named, "node", "left")
    return rows, nodes.select("s0", "s1", "least", F.coalesce("component", "node").alias("component"))


def join_classes(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id): size of the n-gram set of every row of ``docs`` and the smallest doc_id that links reach.

    Texts are lower-cased (A-Z), words are runs of other than ASCII white space; with fewer than ``width`` words the whole sequence is one
    n-gram. A null text or one without words has an empty set and links with nothing: its component_id is its own doc_id. Other columns are
    not read. One row per input row, equal rows included. Rows that share a doc_id are compared as texts of their own. Rows
    without one take part; component_id is null where a component has no other rows. An empty table gives an empty result. N-grams are compared by
    64-bit hashes, whole sets of equal texts by 128 bits.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.select("doc_id", "text", *[c.alias(f"r{i}") for i, c in enumerate(row_key(docs))])
    rows, nodes = _classes(docs, width, percent)
    least = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    nodes = nodes.join(least, "component").select("s0", "s1", "component_id")
    full = rows.where("n > 0").join(nodes, ["s0", "s1"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def first_rows(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row of each class, with all columns of ``docs``: the smallest doc_id, then the smallest hash of the row.

    ``docs`` needs ``doc_id`` and ``text``. A missing doc_id is larger than any other. Texts without words, or null, are one class. Rows are told
    apart as a whole, so ids may be null or shared; of equal rows one stays. An empty table gives an empty result. Pairs within the radius of the
    SimHash operator, on fingerprints of the same n-grams, are verified first; the tiles then find what is similar but farther apart.
    """
    named, of = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]), lambda c: F.col(f"c{docs.columns.index(c)}")
    keyed = named.select("*", *[c.alias(f"r{i}") for i, c in enumerate(row_key(named))])
    rows, nodes = _classes(keyed.select(of("doc_id").cast("bigint").alias("doc_id"), of("text").cast("string").alias("text"), "r0", "r1"), width, percent, fingerprints=True)
    # Sets without members are one class of their own; node numbers are not negative.
    rows = rows.join(nodes.drop("least"), ["s0", "s1"], "left").withColumn("component", F.coalesce("component", F.lit(-1)))
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r0", "r1")).alias("m"))
    kept = keyed.join(first.select("m.r0", "m.r1"), ["r0", "r1"]).dropDuplicates(["r0", "r1"])
    return kept.select(*[kept[f"c{i}"].alias(c) for i, c in enumerate(docs.columns)])
