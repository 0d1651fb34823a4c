"""Query of the byte-level BPE round trip."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm.bpe import decode, encode, read_ranks
from voxfield.llm.registry import query, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the bytes that they decode to, as digests."""
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path(VOCABULARY))
    coded = encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    rows = coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed.cast("binary"), 256).alias("ids_sha256"), "ids")
    return decode(rows, ranks).select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
