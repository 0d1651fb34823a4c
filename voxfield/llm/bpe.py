"""Byte-level BPE encoding and decoding by overlapping chunks.

Long texts are cut into chunks that overlap. All chunks are pre-tokenised in parallel, each from its own first character, which need not be a
pre-token boundary of the text. Where a chunk and the one before it, itself in step, have a boundary in common inside the
overlap, the chunk is in step from there on, as the next pre-token depends only on what follows its start. The text is
split at these places and the pieces are encoded in parallel. A chunk without a common boundary joins the piece before
it, so results are exact for any text. A text that fits one chunk is one piece.

Pieces are encoded by rank, each pre-token for itself, by the ``tiktoken`` library inside the tasks. Decoding concatenates the bytes of the ids.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxfield.llm.blocks import give_back

#: Characters of a chunk without its overlap, and of the overlap.
CHUNK, OVERLAP = 1 << 16, 1 << 11
#: A boundary this close to the end of a chunk may depend on the characters after it.
GUARD = 16
#: Characters that are handed to the encoder before results are passed on.
BATCH_CHARS = 1 << 20


def read_ranks(path: str) -> bytes:
    """The vocabulary file, read once on the driver (about a megabyte) and sent to the tasks."""
    with open(path, "rb") as f:
        return f.read()


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line.strip())}


def _encoder(raw: bytes, pattern: str, made: dict):
    """The encoder, made once per task: ``made`` is a dict of the task's own."""
    if not made:
        import tiktoken

        made["encoding"] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(raw), special_tokens={})
    return made["encoding"]


def _ids(encoding, texts: list[str]) -> pa.Array:
    """A list<int> array: the ids of every text."""
    found = [np.asarray(encoding.encode_ordinary(t) if t else [], np.int32) for t in texts]
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(x) for x in found], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))


def _slices(batch: pa.RecordBatch, size: pa.Array):
    """Parts of a batch of about BATCH_CHARS characters each."""
    done = np.cumsum(size.to_numpy(zero_copy_only=False)) // BATCH_CHARS
    heads = np.flatnonzero(np.r_[True, done[1:] != done[:-1]])
    for a, b in zip(heads, np.r_[heads[1:], batch.num_rows]):
        yield batch.slice(a, b - a)


def pre_tokens(text: str, pattern) -> list[int]:
    """Starts of the pre-tokens of ``text``; characters outside any match start nothing."""
    return [m.start() for m in pattern.finditer(text)]


def _whole(docs: DataFrame, raw, pattern: str) -> DataFrame:
    """Ids of texts that fit one chunk."""

    def run(batches):
        encoding = _encoder(raw.value, pattern, {})
        for batch in batches:
            if batch.num_rows:
                size = pa.compute.utf8_length(batch.column("text"))
                for part in _slices(batch, size):
                    ids = _ids(encoding, part.column("text").to_pylist())
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])
            give_back()

    return docs.mapInArrow(run, "doc_id bigint, ids array<int>")


def _chunked(docs: DataFrame, raw, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Ids of texts of several chunks. Equal (doc_id, text) are encoded once."""
    key = ["doc_id", "h"]
    rows = docs.withColumn("h", F.xxhash64("text"))
    n = F.ceil((F.length("text") - overlap) / F.lit(chunk)).cast("int")
    chunks = rows.select(*key, "text", F.greatest(n, F.lit(1)).alias("n")).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    chunks = chunks.select(*key, "k", "n", F.substring("text", F.col("k") * chunk + 1, F.lit(chunk + overlap)).alias("part"))
    chunks = chunks.dropDuplicates([*key, "k"])

    def starts(batches):
        import regex

        compiled = regex.compile(pattern)
        for batch in batches:
            head, tail = [], []
            for text, k, of in zip(batch.column("part").to_pylist(), batch.column("k").to_pylist(), batch.column("n").to_pylist()):
                found = pre_tokens(text, compiled)
                sure = len(text) if k == of - 1 else len(text) - GUARD
                head.append([s for s in found if s < min(overlap, sure)])
                tail.append([s - chunk for s in found if chunk <= s < sure])
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, kind), pa.array(tail, kind)], names=[*batch.schema.names, "head", "tail"])

    schema = "doc_id bigint, h bigint, k int, n int, part string, head array<int>, tail array<int>"
    found = chunks.mapInArrow(starts, schema)
    in_order = Window.partitionBy(*key).orderBy("k")
    cuts = found.select(*key, "k", "head", F.lag("tail").over(in_order).alias("before"))
    cuts = cuts.withColumn("cut", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect("head", "before"))))
    # In step only as long as every chunk before is: the first that is not takes the rest of the text into its piece.
    cuts = cuts.withColumn("cut", F.when(F.min(F.col("cut").isNotNull()).over(in_order), F.col("cut")))
    cuts = cuts.withColumn("piece", F.count("cut").over(in_order)).withColumn("next_cut", F.lead("cut").over(in_order))
    cuts = cuts.select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), F.col("k").alias("dk"), "cut", "next_cut", "piece")
    at = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh")) & (F.col("k") == F.col("dk"))
    start = F.coalesce("cut", F.lit(0))
    stop = F.when(F.col("k") == F.col("n") - 1, F.length("part")).otherwise(F.coalesce("next_cut", F.lit(0)) + chunk)
    pieces = found.drop("head", "tail").join(cuts, at).select(*key, "piece", "k", F.substring("part", start + 1, stop - start).alias("part"))

    made: dict = {}

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        ids = _ids(_encoder(raw.value, pattern, made), ["".join(table.column("part").to_pylist())])
        head = table.slice(0, 1)
        return pa.table([head.column("doc_id"), head.column("h"), head.column("piece"), ids], names=[*key, "piece", "ids"])

    coded = pieces.groupBy(*key, "piece").applyInArrow(encode, "doc_id bigint, h bigint, piece bigint, ids array<int>")
    coded = coded.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("piece", "ids"))).alias("p"))
    coded = coded.select(F.col("doc_id").alias("d"), F.col("h").alias("dh"), F.flatten("p.ids").alias("ids"))
    return rows.select(*key).join(coded, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh"))).select("doc_id", "ids")


def encode(docs: DataFrame, ranks: bytes, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, ids): token ids of every text by the given ranks, without special tokens.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. One row per input row, equal rows included. A null or empty text
    has no ids. An empty table gives an empty result. ``ranks`` is the content of a rank file (``read_ranks``); ``pattern`` splits texts into pre-tokens
    and must not look back; it may look at most GUARD characters past a pre-token.
    """
    raw = docs.sparkSession.sparkContext.broadcast(ranks)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    short = _whole(docs.where(F.length("text") <= chunk + overlap), raw, pattern)
    return short.unionByName(_chunked(docs.where(F.length("text") > chunk + overlap), raw, pattern, chunk, overlap))


def decode(rows: DataFrame, ranks: bytes) -> DataFrame:
    """``rows`` with ``decoded`` (binary) in place of ``ids``: the concatenated bytes of the ids.

    A null list decodes to no bytes, as do null ids and ids that the vocabulary lacks.
    """
    raw = rows.sparkSession.sparkContext.broadcast(ranks)
    rest = [c for c in rows.columns if c != "ids"]

    def run(batches):
        parsed = parse_ranks(raw.value)
        size = np.zeros(max(parsed.values(), default=-1) + 2, np.int64)
        for token, rank in parsed.items():
            size[rank] = len(token)
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(t for t, _ in sorted(parsed.items(), key=lambda x: x[1])), np.uint8)
        for batch in batches:
            lists = batch.column("ids")
            counts = pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
            ids = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = np.where((ids >= 0) & (ids < len(size)), ids, len(size) - 1)
            ends = np.concatenate([[0], np.cumsum(counts)])
            out = []
            for a, b in zip(ends[:-1], ends[1:]):
                s, at = size[ids[a:b]], start[ids[a:b]]
                shift = np.repeat(at - (np.cumsum(s) - s), s)
                out.append(data[shift + np.arange(len(shift))].tobytes())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(out, pa.binary())], names=[*rest, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "ids")
    return rows.mapInArrow(run, f"{fields}, decoded binary" if fields else "decoded binary")
