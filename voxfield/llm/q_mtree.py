"""Query of the exact top-k search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm.mtree import top_k, whole_vectors
from voxfield.llm.registry import query, table

SQL = """
WITH whole AS (
    SELECT vec_id, min(v) AS v FROM (
        SELECT vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    ) GROUP BY vec_id
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum([coalesce(p[1], 0) * coalesce(p[2], 0) FOR p IN list_zip(q.v, c.v)]), 0)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
)
SELECT * FROM ranked WHERE rank <= 20
"""


@query("op10_exact_top_k", SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best vectors by inner product for every twentieth vector."""
    vectors = whole_vectors(table(spark, sf_dir, "embeddings"))
    return top_k(vectors, F.col("vec_id") % 20 == 0, 20)
