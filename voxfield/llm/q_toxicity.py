"""Query of the toxicity classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm import toxicity
from voxfield.llm.q_quality import learned_from, remainder
from voxfield.llm.registry import query, table


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.train(docs, learned_from(spark, sf_dir, "toxic"))
    held = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.score(docs, machine).select("doc_id", held, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
