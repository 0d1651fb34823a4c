"""Substring deduplication by difference-cover anchors.

A window is ``window`` consecutive words of one document. A word goes if it lies in a window whose word sequence also
begins in a document with a smaller id; windows are judged on the input.

Anchors are ``anchor`` consecutive words that begin at a cover position: word number modulo ``PERIOD`` in ``COVER``. COVER
is a difference cover, so for any two positions some shift below PERIOD brings both onto the cover; two equal
windows therefore share an anchor at the same offset, as long as ``PERIOD - 1 + anchor <= window``. Only 3 of 7 positions are
exchanged. Windows around anchors that occur in one document only cannot repeat elsewhere; the others are extended
to the full window and compared as a whole.

Three passes over blocks of documents (``blocks``): anchors to buckets and back (one bit per anchor: held by two or more
documents), candidate windows to buckets and back (one bit per window: a smaller document outside the block holds it), removal.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from voxfield.llm import blocks as B

PERIOD, COVER = 7, (0, 1, 3)
WINDOW = 13
MESSAGE = "kind int, bucket int, block int, body binary"
OUT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def _read(payloads):
    """Rows of a block by (doc_id, text) and their words; rows without a doc_id come last."""
    t = B.unpack(payloads)
    t = t.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return t, B.Words(t.column("text"))


def _doc_keys(t: pa.Table) -> np.ndarray:
    """Order of documents: the doc_id; a missing one is larger than any other."""
    return t.column("doc_id").fill_null(np.iinfo(np.int64).max).to_numpy()


def _anchors(w: B.Words, window: int):
    """Word numbers of the anchors of all texts, in word order, and their hashes."""
    width = window - PERIOD + 1
    text = w.text_of()
    number = np.arange(len(w)) - w.first[text]
    on = np.zeros(PERIOD, bool)
    on[list(COVER)] = True
    at = np.flatnonzero(on[number % PERIOD] & (w.first[text + 1] - np.arange(len(w)) >= width))
    return at, B.window_hash(w.hash, at, width)


def _dealt(key: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each key; independent of the key's own order."""
    return (B.mix(key * B.MIX_A + B.U(1)) % B.U(n)).astype(np.int64)


def _distinct(key: np.ndarray, n: int):
    """Distinct keys ordered by (bucket, key), the inverse map, and the bounds of each bucket."""
    keys, inverse = np.unique(key, return_inverse=True)
    bucket = _dealt(keys, n)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return keys[order], place[inverse], np.searchsorted(bucket[order], np.arange(n + 1))


def _span(key: np.ndarray, number: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest of ``number`` for each of ``size`` keys."""
    low = np.full(size, np.iinfo(np.int64).max)
    high = np.full(size, -1, np.int64)
    np.minimum.at(low, key, number)
    np.maximum.at(high, key, number)
    return low, high


def _messages(kind, block, bounds, **columns):
    full = np.flatnonzero(bounds[1:] > bounds[:-1])
    body = [B.arrays_to_bytes(**{k: v[bounds[b] : bounds[b + 1]] for k, v in columns.items()}) for b in full]
    return pa.table(
        [pa.array(np.full(len(full), kind), pa.int32()), pa.array(full, pa.int32()), pa.array(np.full(len(full), block), pa.int32()), pa.array(body, pa.binary())],
        names=["kind", "bucket", "block", "body"],
    )


def _replies(t: pa.Table, kind: int) -> dict[int, np.ndarray]:
    """Bits by bucket, of one kind."""
    rows = t.filter(pa.compute.equal(t.column("kind"), kind))
    return {b: np.unpackbits(B.arrays_from_bytes(m)["bits"]).astype(bool) for b, m in zip(rows.column("bucket").to_pylist(), rows.column("body").to_pylist())}


def _bits(replies: dict[int, np.ndarray], bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(bounds[-1], bool)
    for b, bits in replies.items():
        out[bounds[b] : bounds[b + 1]] = bits[: bounds[b + 1] - bounds[b]]
    return out


def _candidates(w: B.Words, at, hashes, shared, window: int):
    """Window starts at most PERIOD - 1 words before a shared anchor; a window must fit its text."""
    text = w.text_of()
    mark = np.zeros(len(w) + 1, np.int64)
    hit = at[shared]
    low = np.maximum(hit - (PERIOD - 1), w.first[text[hit]])
    np.add.at(mark, low, 1)
    np.add.at(mark, hit + 1, -1)
    starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
    return starts[w.first[text[starts] + 1] - starts >= window]


def remove_repeats(docs: DataFrame, window: int = WINDOW, n_blocks: int | None = None, carry: tuple[str, ...] = (), same: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text): words left once repeated windows are gone, joined by one space.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. One row per input row. A null or empty text has no words
    and an empty kept_text. Rows with the same doc_id count as one document, so they do not remove each other's words. A
    null doc_id stands for a document after all others; all rows without an id count as one such document. An empty table gives an empty
    result. ``window`` must be at least 8 (anchors of two words or more). Columns named in ``carry`` go along with their rows.
    With ``same``, a text that loses nothing is its own kept_text, white space and null included.
    """
    if window < PERIOD + 1:
        raise ValueError(f"windows need {PERIOD + 1} words at least")
    n = n_blocks or B.parts(docs.sparkSession)
    packed = B.pack(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *carry), n)
    along = docs.select(*carry).schema
    out_type = ", ".join([OUT, *(f"`{f.name}` {f.dataType.simpleString()}" for f in along)])
    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), *to_arrow_schema(along)])

    def send_anchors(t: pa.Table) -> pa.Table:
        rows, w = _read(t.column("payload"))
        at, hashes = _anchors(w, window)
        keys, inverse, bounds = _distinct(hashes, n)
        doc = _doc_keys(rows)[w.text_of()[at]]
        low, high = _span(inverse, doc, len(keys))
        return _messages(0, t.column("block")[0].as_py(), bounds, key=keys, many=low != high)

    def judge_anchors(t: pa.Table) -> pa.Table:
        """An anchor is shared if two blocks hold it, or two documents of one block."""
        got = [B.arrays_from_bytes(m) for m in t.column("body").to_pylist()]
        keys = np.concatenate([g["key"] for g in got])
        many = np.concatenate([g["many"] for g in got])
        order = np.argsort(keys, kind="stable")
        head = np.r_[True, keys[order][1:] != keys[order][:-1]]
        group = np.cumsum(head) - 1
        shared = (np.bincount(group) > 1) | (np.bincount(group, many[order]) > 0)
        bits = np.empty(len(keys), bool)
        bits[order] = shared[group]
        return _answers(t, got, bits, 0)

    def _answers(t, got, bits, kind):
        ends = np.cumsum([len(g["key"]) for g in got])
        body = [B.arrays_to_bytes(bits=np.packbits(bits[e - len(g["key"]) : e])) for g, e in zip(got, ends)]
        return pa.table([pa.array(np.full(len(got), kind), pa.int32()), t.column("bucket"), t.column("block"), pa.array(body, pa.binary())], names=["kind", "bucket", "block", "body"])

    def windows(t: pa.Table, replies: pa.Table):
        rows, w = _read(t.column("payload"))
        at, hashes = _anchors(w, window)
        _, inverse, bounds = _distinct(hashes, n)
        shared = _bits(_replies(replies, 0), bounds)[inverse]
        starts = _candidates(w, at, hashes, shared, window)
        keys, inverse, bounds = _distinct(B.window_hash(w.hash, starts, window), n)
        doc = _doc_keys(rows)[w.text_of()[starts]]
        low, _ = _span(inverse, doc, len(keys))
        return rows, w, starts, doc, keys, inverse, bounds, low

    def send_windows(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _messages(1, 0, np.zeros(1, int))
        *_, keys, _, bounds, low = windows(t, replies)
        return _messages(1, t.column("block")[0].as_py(), bounds, key=keys, low=low)

    def judge_windows(t: pa.Table) -> pa.Table:
        """One bit per window: a document outside the block, smaller than all of the block's, holds it."""
        got = [B.arrays_from_bytes(m) for m in t.column("body").to_pylist()]
        keys, low = np.concatenate([g["key"] for g in got]), np.concatenate([g["low"] for g in got])
        order = np.argsort(keys, kind="stable")
        heads = np.flatnonzero(np.r_[True, keys[order][1:] != keys[order][:-1]])
        least = np.minimum.reduceat(low[order], heads)
        bits = np.empty(len(keys), bool)
        bits[order] = low[order] > np.repeat(least, np.diff(np.r_[heads, len(keys)]))
        return _answers(t, got, bits, 1)

    def remove(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return out_schema.empty_table()
        rows, w, starts, doc, keys, inverse, bounds, low = windows(t, replies)
        outside = _bits(_replies(replies, 1), bounds)
        gone = starts[outside[inverse] | (doc > low[inverse])]
        mark = np.zeros(len(w) + 1, np.int64)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + window, -1)
        keep = np.cumsum(mark[:-1]) == 0
        # Kept bytes: each kept word and the byte after it, which becomes one space.
        out = w.data.copy()
        out[w.end] = 32
        step = np.zeros(len(out) + 1, np.int8)
        step[w.start[keep]] += 1
        step[w.end[keep] + 1] -= 1
        hold = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
        size = np.concatenate([[0], np.cumsum(np.where(keep, w.end - w.start + 1, 0))])
        ends = size[w.first]
        packed_bytes = out[hold].tobytes()
        kept = [packed_bytes[a : max(b - 1, a)].decode() for a, b in zip(ends[:-1], ends[1:])]
        words = np.diff(w.first)
        left = np.diff(np.concatenate([[0], np.cumsum(keep)])[w.first])
        kept = pa.array(kept, pa.string())
        if same:
            kept = pc.if_else(pa.array(words == left), rows.column("text"), kept)
        return pa.table([rows.column("doc_id"), pa.array(words, pa.int64()), pa.array(words - left, pa.int64()), kept, *(rows.column(c) for c in carry)], schema=out_schema)

    by_block = packed.groupBy("block")
    shared = by_block.applyInArrow(B.one(send_anchors), MESSAGE).groupBy("bucket").applyInArrow(B.one(judge_anchors), MESSAGE)
    asked = by_block.cogroup(shared.groupBy("block")).applyInArrow(B.two(send_windows), MESSAGE)
    earlier = asked.groupBy("bucket").applyInArrow(B.one(judge_windows), MESSAGE)
    return by_block.cogroup(shared.unionByName(earlier).groupBy("block")).applyInArrow(B.two(remove), out_type)
