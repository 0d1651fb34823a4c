"""Query of the hard-negative mining."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm.bond import hard_negatives, whole_rows
from voxfield.llm.registry import query, table

SQL = """
WITH whole AS (
    SELECT vec_id, min({'v': v, 'label': label}) AS r FROM (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label::BIGINT END AS label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ) GROUP BY vec_id
), scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.r.label = c.r.label AS same,
        coalesce(list_sum([coalesce(p[1], 0) * coalesce(p[2], 0) FOR p IN list_zip(a.r.v, c.r.v)]), 0)::BIGINT AS score
    FROM whole a JOIN whole c ON a.vec_id <> c.vec_id WHERE a.vec_id % 100 = 0
), positive AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), ranked AS (
    SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
        vec_id AS negative_id, positive_score, score AS negative_score
    FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op12_hard_negatives", SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, by their score against each of its positives."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    rows = whole_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)
