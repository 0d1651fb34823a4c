"""Documents in blocks, messages between blocks and buckets, and words as arrays.

Operators that compare every document with every other exchange short hash keys instead of texts. A *block* holds the
documents of one hash class, a *bucket* the keys of one hash class. A block sends each bucket one message with its
distinct keys (so a key is sent once per block, however many documents hold it: no hot key), the bucket answers with one
value per key in the order of the message, and the block applies the answer to its documents. Messages are Arrow
streams under zstd. Blocks and buckets number as many as ``spark.sql.shuffle.partitions``, the session's own
statement of how many tasks the data needs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U = np.uint64
MIX_A, MIX_B = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Keeps the first n bytes of a little-endian 8-byte word.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [(1 << 64) - 1], dtype=np.uint64)
#: Words longer than this many bytes are hashed one by one.
LONG_WORD = 256
#: Text bytes that one task packs before it writes its messages.
PACK_BYTES = 48 << 20


def parts(spark: SparkSession) -> int:
    """Blocks (and buckets) that the data is dealt into."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def give_back() -> None:
    """Return freed memory to the system. Python workers are kept for later stages, and what they hold counts for the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def one(f: Callable) -> Callable:
    """``f`` of one table, as the function of a group that gives its memory back."""

    def run(t: pa.Table) -> pa.Table:
        out = f(t)
        give_back()
        return out

    return run


def two(f: Callable) -> Callable:
    """``f`` of two tables, as the function of a cogroup that gives its memory back."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        give_back()
        return out

    return run


def to_bytes(table: pa.Table | pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write(table)
    return sink.getvalue().to_pybytes()


def arrays_to_bytes(**arrays) -> bytes:
    """A message of named numpy arrays of any lengths."""
    names, values = list(arrays), [pa.array([np.ascontiguousarray(a).tobytes()], pa.large_binary()) for a in arrays.values()]
    kinds = {n: a.dtype.str for n, a in arrays.items()}
    return to_bytes(pa.table(values, schema=pa.schema([pa.field(n, pa.large_binary()) for n in names], metadata=kinds)))


def arrays_from_bytes(message: bytes) -> dict[str, np.ndarray]:
    t = pa.ipc.open_stream(message).read_all()
    kinds = {k.decode(): v.decode() for k, v in t.schema.metadata.items()}
    return {n: np.frombuffer(t.column(n)[0].as_buffer(), dtype=kinds[n]) for n in t.column_names}


def pack(docs: DataFrame, n: int) -> DataFrame:
    """(block int, payload binary): all columns of ``docs``, dealt into ``n`` blocks by a hash of the whole row."""
    schema = "block int, payload binary"
    dealt = docs.withColumn("_block", F.pmod(F.xxhash64(*[docs[c] for c in docs.columns]), F.lit(n)).cast("int"))

    def write(held):
        t = pa.Table.from_batches(held)
        block = t.column("_block").to_numpy()
        order = np.argsort(block, kind="stable")
        t, block = t.drop_columns(["_block"]).take(pa.array(order)), block[order]
        heads = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        ends = np.r_[heads[1:], len(block)]
        out = [to_bytes(t.slice(a, b - a).combine_chunks()) for a, b in zip(heads, ends)]
        return pa.RecordBatch.from_arrays([pa.array(block[heads], pa.int32()), pa.array(out, pa.binary())], names=["block", "payload"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                size += b.nbytes
            if size >= PACK_BYTES:
                yield write(held)
                held, size = [], 0
        if held:
            yield write(held)
        held = []
        give_back()

    return dealt.mapInArrow(run, schema)


def unpack(payloads: pa.ChunkedArray) -> pa.Table:
    """The rows of one block's payloads, in an order that does not depend on the order of arrival."""
    found = sorted(p.as_py() for p in payloads)
    return pa.concat_tables([pa.ipc.open_stream(p).read_all() for p in found]).combine_chunks()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * MIX_B
    h = (h ^ (h >> U(29))) * MIX_A
    return h ^ (h >> U(32))


class Words:
    """The words (runs of bytes that are not ASCII white space) of many texts, as arrays.

    ``data`` holds the UTF-8 bytes, word i is ``data[start[i]:end[i]]``, the words of text t are ``first[t]:first[t+1]``,
    ``hash`` is a 64-bit hash of each word. A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        n = len(raw)
        # One space after every text keeps words of neighbouring texts apart; eight more bytes let each word be read as 8-byte parts.
        data = np.full(n + len(texts) + 8, 32, np.uint8)
        if n:
            used = np.ones(n + len(texts), bool)
            used[offsets[1:] + np.arange(len(texts))] = False
            data[: n + len(texts)][used] = raw
        if lower:
            upper = (data >= 65) & (data <= 90)
            data[upper] += 32
        space = SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(data) and not space[0]:
            edge = np.r_[0, edge]
        self.data, self.start, self.end = data, edge[::2], edge[1::2]
        text_start = offsets + np.arange(len(texts) + 1)
        self.first = np.searchsorted(self.start, text_start)
        self.hash = self._hash()

    def _hash(self) -> np.ndarray:
        size = self.end - self.start
        eight = np.ndarray((max(len(self.data) - 7, 0),), "<u8", self.data, strides=(1,))
        h = mix(size.astype(np.uint64) + MIX_A)
        if not len(h):
            return h
        h = mix(h ^ (eight[self.start] & FIRST[np.minimum(size, 8)]))
        at, left = np.flatnonzero(size > 8), 8
        at = at[size[at] <= LONG_WORD]
        while len(at):
            h[at] = mix(h[at] * MIX_A ^ (eight[self.start[at] + left] & FIRST[np.minimum(size[at] - left, 8)]))
            left += 8
            at = at[size[at] > left]
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.data[self.start[i] : self.end[i]].tobytes())
        return h

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def window_hash(h: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` consecutive words that begin at each word number of ``at``."""
    out = np.zeros(len(at), np.uint64)
    for j in range(width):
        out = out * MIX_A + h[at + j]
    return mix(out)
