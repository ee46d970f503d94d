"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tally.llm import quality_sql
from tally.llm import queries as q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        q.op1_weak_supervision_pii,
        q.op2_learned_partitions,
        q.op3_simhash_multi_index,
        q.op4_license_rules,
        q.op5_quality_outliers,
        q.op6_token_prefix,
        q.op7_golden_mix,
        q.op8_token_files,
        q.op9_sentencepiece_backend,
        q.op10_kneser_ney_language,
        q.op11_fm_index_spelling,
        q.op12_periodic_runs,
        q.op13_clause_grammar_toxicity,
    )
}

#: The mix in closed form: a document is taken once for each epoch of its
#: source's shuffled stream, as far as the target reaches into that epoch.
OP7 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM s),
w AS (SELECT *, place % 3 + 1 AS weight, 3 * source_size AS lim FROM p),
c AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER before, 0) AS DOUBLE)
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS DOUBLE) AS share
  FROM w WINDOW before AS (ORDER BY CAST(lim AS DOUBLE) / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, CASE WHEN share * weight >= lim THEN CAST(lim AS DOUBLE) ELSE weight * (
    SELECT arg_min(share, {'a': CAST(lim AS DOUBLE) / weight, 'b': place}) FROM c WHERE share * weight < lim) END AS target FROM c),
g AS (SELECT *, least(CAST(round(target) AS BIGINT), 3 * source_size) AS words FROM t),
x AS (
  SELECT d.doc_id, d.size, g.source_size, g.target, g.words, coalesce(sum(d.size) OVER (
    PARTITION BY d.source ORDER BY d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(
  greatest(0, least(start + size, words) - start) + greatest(0, least(start + size, words - source_size) - start)
  + greatest(0, least(start + size, words - 2 * source_size) - start) AS BIGINT) AS taken
FROM x"""

ORACLE_SQL: dict[str, str] = {"op5_quality_outliers": quality_sql.statement(), "op7_golden_mix": OP7}
