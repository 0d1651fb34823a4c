"""Query of the SimHash near-duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxfield.llm.registry import query, table
from voxfield.llm.simhash import classes


@query("op9_simhash_near_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return classes(table(spark, sf_dir, "documents"))
