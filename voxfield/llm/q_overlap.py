"""Query of the n-gram similarity join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxfield.llm.overlap import join_classes
from voxfield.llm.registry import query, table

SQL = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), gram AS (
    SELECT DISTINCT doc_id, array_to_string(words[p:p + 3], ' ') AS g
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 2, least(len(words), 1) + 1))) AS p FROM w)
), size AS (
    SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id
), pair AS (
    SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS common FROM gram l JOIN gram r USING (g) WHERE l.doc_id <> r.doc_id GROUP BY ALL
), link AS (
    SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
    SELECT doc_id, doc_id AS c FROM w UNION SELECT doc_id, b FROM reach JOIN link ON a = c
)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(c) AS component_id
FROM w JOIN reach ON w.doc_id = reach.doc_id LEFT JOIN size ON w.doc_id = size.doc_id GROUP BY w.doc_id, n
"""


@query("op13_ngram_join", SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more, as classes."""
    return join_classes(table(spark, sf_dir, "documents"))
