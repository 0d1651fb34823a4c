"""Query of the substring deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm.registry import query, table
from voxfield.llm.substring import remove_repeats

SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
    SELECT doc_id, p, array_to_string(words[p:p + 12], ' ') AS k
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS p FROM w)
), least AS (
    SELECT k, min(doc_id) AS d FROM win GROUP BY k
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM win JOIN least USING (k) WHERE doc_id > d
), each AS (
    SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w
), kept AS (
    SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS t, count(*) AS n
    FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


@query("op2_substring_dedup", SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words left in every document once windows of 13 words that an earlier document holds are gone."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
