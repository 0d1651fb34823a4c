"""Query of the periodic runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxfield.llm.registry import query, table
from voxfield.llm.runs import periodic_runs

#: The planted text of the contract: in every tenth document (by hash) the words from ``a`` on repeat with period ``p``.
PLANTED = r"""
CASE WHEN pmod(crc32(CAST(doc_id AS STRING)), 10) <> 0 THEN text ELSE
  transform(array(filter(split(text, '[\\x20\\x09-\\x0D]+'), x -> x <> '')), w ->
    transform(array(crc32(CAST(doc_id AS STRING)) DIV 10), g ->
      transform(array(pmod(g, nullif(size(w), 0))), a ->
        transform(array(1 + (size(w) - a) DIV (3 + pmod(g, 8))), p ->
          array_join(transform(w, (x, i) -> element_at(w, CAST(1 + IF(i < a, i, a + pmod(i - a, p)) AS INT))), ' ')
        )[0])[0])[0])[0]
END
"""

# Runs are islands of equal pairs on a diagonal; a shorter lag that divides a lag and covers its island is the true period.
SQL = r"""
WITH RECURSIVE crc AS (
    SELECT doc_id, 0 AS i, 4294967295::BIGINT AS c FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
    UNION ALL
    SELECT doc_id, i + 1, list_reduce([xor(c, ascii(substr(doc_id::VARCHAR, i + 1, 1))::BIGINT), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)
    FROM crc WHERE i < length(doc_id::VARCHAR)
), h AS (
    SELECT doc_id, xor(c, 4294967295) AS h FROM crc WHERE i = length(doc_id::VARCHAR)
), raw AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), shaped AS (
    SELECT doc_id, w, h, len(w) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw LEFT JOIN h USING (doc_id)
), planted AS (
    SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
        THEN [w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END] FOR i IN range(n)] ELSE w END AS w
    FROM shaped
), word AS (
    SELECT doc_id, n, unnest(w) AS x, unnest(range(n)) AS i FROM planted
), pair AS (
    SELECT l.doc_id, l.i, r.i - l.i AS q FROM word l JOIN word r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND 4 * (r.i - l.i) <= l.n
), island AS (
    SELECT doc_id, q, min(i) AS s, count(*) + q AS length
    FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pair)
    GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)
), run AS (
    SELECT * FROM island l WHERE NOT EXISTS (
        SELECT 1 FROM island m WHERE m.doc_id = l.doc_id AND m.q < l.q AND l.q % m.q = 0 AND m.s <= l.s AND m.s + m.length >= l.s + l.length)
), each AS (
    SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || length || ',' || q || chr(10), '' ORDER BY s, q) AS t,
        arg_min({'s': s, 'n': length, 'q': q}, {'a': -(length::DOUBLE / q), 's': s, 'q': q}) AS best
    FROM run GROUP BY doc_id
), gone AS (
    SELECT DISTINCT doc_id, unnest(range(s + q, s + length)) AS i FROM run
), kept AS (
    SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period,
    (1000 * best.n // best.q)::BIGINT AS exponent_milli, sha256(coalesce(e.t, '')) AS runs_sha256, sha256(coalesce(k.t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN each e ON d.doc_id = e.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` with the contract's periodic stretches in the text of every tenth document."""
    return docs.select("doc_id", F.when(F.col("doc_id").isNull() | F.col("text").isNull(), F.col("text")).otherwise(F.expr(PLANTED)).alias("text"))


@query("op11_periodic_runs", SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, and what is left without their repetitions."""
    out = periodic_runs(planted(table(spark, sf_dir, "documents")))
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), *[F.col(f"strongest.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("(1000 * strongest.length) DIV strongest.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("collapsed_sha256"),
    )
