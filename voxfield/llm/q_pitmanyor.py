"""Query of the language-model scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxfield.llm.pitmanyor import score
from voxfield.llm.q_quality import remainder
from voxfield.llm.registry import query, table


@query("op8_pitman_yor")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of every document under the base and under the hierarchical Pitman-Yor model."""
    return score(table(spark, sf_dir, "documents"), remainder("doc_id", 7) != 2)
