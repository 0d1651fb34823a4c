"""Query of the quality classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm import quality
from voxfield.llm.registry import query, table


def remainder(doc_id: str, by: int):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % by


def learned_from(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    """(doc_id, label) of the rows that may be learned from: one fold in five is held out."""
    return table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0).select("doc_id", F.col(label).alias("label"))


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = quality.train(docs, learned_from(spark, sf_dir, "quality"))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return quality.score(docs, field).select("doc_id", held, "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))
