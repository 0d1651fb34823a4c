"""Query of the Order MinHash fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm.orderminhash import edited_fingerprints, hexadecimal, likeness
from voxfield.llm.registry import query, table


@query("op7_order_minhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how alike they and the next document's are."""
    out = edited_fingerprints(table(spark, sf_dir, "documents"))
    own, other, after = F.col("signature"), F.col("edited_signature"), F.col("next_signature")
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        hexadecimal(own).alias("fingerprint"), hexadecimal(other).alias("edited_fingerprint"),
        likeness(own, other).alias("near_edited"), likeness(own, after).alias("near_next"),
    )
