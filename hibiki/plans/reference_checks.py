"""Queries over the reference integrity of the case and answer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.orphans import orphan_references, orphan_report
from ..sources.tables import table

_CHUNKS, _SMOKE, _SOURCES = "semantic_challenge_v2_chunks", "smoke_v2_chunks", "source_manifest"
_REFS = (
    ("semantic_challenge_v2_cases", "gold_chunk_ids", "case_id", _CHUNKS),
    ("semantic_challenge_v2_cases", "distractor_chunk_ids", "case_id", _CHUNKS),
    ("real_corpus_v2_cases", "gold_chunk_ids", "case_id", _SMOKE),
    ("approved_qa_alias_fixture", "approved_citations.source_doc", "qa_id", _SOURCES),
)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = None
    for name, field, record, target in _REFS:
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("ref_table"), F.lit(field).alias("ref_field"), F.col(record).alias("record_id"), F.lit(target).alias("target"), F.explode(field).alias("ref_key"), F.col("created_at").cast("timestamp").alias("at"))
        refs = rows if refs is None else refs.unionByName(rows)
    parents = None
    for target, key in ((_CHUNKS, "id"), (_SMOKE, "id"), (_SOURCES, "source_doc")):
        rows = table(spark, sf_dir, target).select(F.lit(target).alias("target"), F.col(key).alias("key"), F.col("updated_at").cast("timestamp").alias("at"))
        parents = rows if parents is None else parents.unionByName(rows)
    tombstones = table(spark, sf_dir, "index_tombstones").select(F.col("target_table").alias("target"), F.col("target_key").alias("key"), F.col("deleted_at").cast("timestamp").alias("at"))
    return orphan_references(refs, parents, tombstones)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p3_found(spark, sf_dir))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_FOUND = """
WITH refs AS (
  SELECT DISTINCT 'semantic_challenge_v2_cases' AS ref_table, 'gold_chunk_ids' AS ref_field, case_id AS record_id, 'semantic_challenge_v2_chunks' AS target, unnest(gold_chunk_ids) AS ref_key, created_at AS "at" FROM semantic_challenge_v2_cases
  UNION SELECT 'semantic_challenge_v2_cases', 'distractor_chunk_ids', case_id, 'semantic_challenge_v2_chunks', unnest(distractor_chunk_ids), created_at FROM semantic_challenge_v2_cases
  UNION SELECT 'real_corpus_v2_cases', 'gold_chunk_ids', case_id, 'smoke_v2_chunks', unnest(gold_chunk_ids), created_at FROM real_corpus_v2_cases
  UNION SELECT 'approved_qa_alias_fixture', 'approved_citations.source_doc', qa_id, 'source_manifest', c.source_doc, t."at" FROM (SELECT qa_id, unnest(approved_citations) AS c, created_at AS "at" FROM approved_qa_alias_fixture) t
), parents AS (
  SELECT 'semantic_challenge_v2_chunks' AS target, id AS key, updated_at AS "at" FROM semantic_challenge_v2_chunks
  UNION ALL SELECT 'smoke_v2_chunks', id, updated_at FROM smoke_v2_chunks
  UNION ALL SELECT 'source_manifest', source_doc, updated_at FROM source_manifest
), told AS (
  SELECT r.*, (SELECT count(*) FROM parents p WHERE p.target = r.target AND p.key = r.ref_key) AS n,
    (SELECT max(p."at") FROM parents p WHERE p.target = r.target AND p.key = r.ref_key AND p."at" <= r."at") AS version,
    (SELECT max(d.deleted_at) FROM index_tombstones d WHERE d.target_table = r.target AND d.target_key = r.ref_key AND d.deleted_at <= r."at") AS deletion
  FROM refs r WHERE ref_key IS NOT NULL AND regexp_replace(ref_key, '[\\s　]', '', 'g') <> ''
), found AS (
  SELECT DISTINCT ref_table, ref_field, record_id, ref_key,
    CASE WHEN n = 0 THEN 'missing' WHEN version IS NULL THEN 'late' WHEN deletion > version THEN 'deleted' END AS orphan_state,
    strftime("at", '%Y-%m') AS ref_month
  FROM told
)
"""
SQL = {
    "p3_found": _FOUND + "SELECT * FROM found WHERE orphan_state IS NOT NULL",
    "p3_report": _FOUND + "SELECT ref_table, ref_field, orphan_state, ref_month, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM found WHERE orphan_state IS NOT NULL GROUP BY ALL",
}
