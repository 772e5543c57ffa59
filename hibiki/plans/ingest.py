"""Rows on their way into stores, cleaned texts, generations, fingerprints and small text rules over the chunk and answer tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import ingest as G
from ..operators import reconcile as C
from ..sources import store
from ..sources.tables import materialize, shared_dir, spread, table
from .reconciling import SQL as _RECONCILING
from .text import INDEX

_CUT = "2026-05-01"
_DAYS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])


def _log(spark: SparkSession, d: str) -> str:
    """The events as day files of JSON lines in the shared folder, with an unreadable line for every 50th event."""
    root = f"{shared_dir(spark)}/hibiki-days-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), "event_id", F.to_json(F.struct("event_id", "event_type", "value")).alias("good"))
    line = F.when(F.col("event_id") % 50 == 0, F.array(F.lit("{cut off"), F.col("good"))).otherwise(F.array("good"))
    store.write_days(e.select("day", F.explode(line).alias("line")), root, "day", "line")
    return root


def s2_lenient_log(spark: SparkSession, d: str) -> DataFrame:
    """Rows and unreadable lines of the whole log, per day."""
    rows = store.read_days(spark, _log(spark, d), _DAYS, "2024-12-31", 400)
    return materialize(rows, "log").groupBy(F.col("dt").cast("string").alias("day")).agg(F.count("event_id").alias("rows"), F.count("malformed").alias("malformed"))


def s3_last_days(spark: SparkSession, d: str) -> DataFrame:
    """Usage of the last seven days of the log; no other day's files are opened."""
    last = str(table(spark, d, "events").agg(F.max(F.to_date("ts"))).first()[0])
    rows = store.read_days(spark, _log(spark, d), _DAYS, last, 7).filter("event_id is not null")
    return rows.groupBy(F.col("dt").cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


def _generations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "manufacturing_chunks")
    return G.ingest_rows(rows.filter(F.col("ingested_at") < _CUT), "g1"), G.ingest_rows(rows.filter(F.col("ingested_at") >= _CUT), "g2", with_parents=False)


def s13_ingest(spark: SparkSession, d: str) -> DataFrame:
    return _generations(spark, d)[1].select("row_no", "tenant_id", "searchable", "page_start", "page_end", "generation")


def s13_stale(spark: SparkSession, d: str) -> DataFrame:
    return G.stale_rows(*_generations(spark, d)).select("row_no", "id")


def s13_collisions(spark: SparkSession, d: str) -> DataFrame:
    """Sources that more than one tenant delivers, before and after the cut."""
    return G.collisions(*_generations(spark, d), "source_doc")


def f4_child_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manufacturing_chunks")
    return rows.filter(G.is_child(F.col("chunk_role"))).groupBy("chunk_type").agg(F.count("*").alias("n"))


def f5_manifest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "source_manifest").withColumn("tenant", G.tenant_of(F.col("tenant_id")))
    return rows.filter((F.col("tenant") == "default") & F.col("source_type").isin("pdf", "xlsx", "docx") & (F.col("size_bytes") > 100_000)).select("row_no", "source_doc")


def f7_audit_page(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred answers, newest first, since March, of three tenants, in force and with a word in them."""
    rows = table(spark, d, "approved_qa_alias_fixture").filter((F.col("created_at") >= "2026-03-01") & G.tenant_of(F.col("tenant_id")).isin("default", "tenant-a", "tenant-b") & (F.col("status") == "approved"))
    rows = rows.filter(F.contains(F.lower("approved_answer"), F.lit("点検")) | F.contains(F.lower("approved_answer"), F.lit("replace")))
    return rows.orderBy(F.desc("created_at"), "row_no").limit(100).select("row_no", "qa_id")


def c14_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """Per source document: what the removal of repeated lines changes."""
    out = G.cleaned(table(spark, d, "documents").select("doc_id", "source_doc", "text"), "doc_id", "source_doc", "text", least_share=0.1)
    changed = (F.col("removed") > 0).cast("long")
    return out.groupBy("source_doc").agg(F.count("*").alias("n_docs"), F.sum(changed).alias("changed"), F.sum("removed").alias("removed"), F.sum(F.length("text")).alias("before"), F.sum(F.length("cleaned")).alias("after"))


def j10_generations(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "semantic_challenge_v2_chunks")
    last = lambda df: C.newest(df, ["id"], F.desc("updated_at"), F.col("row_no"))
    return G.compare_generations(last(rows.filter("ingested_at < '2026-04-01'")), last(rows), "id", "text")


def a9_versions(spark: SparkSession, d: str) -> DataFrame:
    """Rows per version and per type; no version counts as blank."""
    m, c = table(spark, d, "source_manifest"), table(spark, d, "semantic_challenge_v2_chunks")
    one = lambda df, part, col: df.groupBy(F.lit(part).alias("part"), F.coalesce(F.col(col).cast("string"), F.lit("")).alias("value")).agg(F.count("*").alias("n"))
    return one(m, "doc_version", "doc_version").unionByName(one(c, "type", "type")).unionByName(one(c, "quality", "quality"))


def a14_spellings(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manufacturing_chunks").filter("normalized_question is not null").select(F.col("normalized_question").alias("q"), X.strong_key(F.col("normalized_question")).alias("form"))
    return G.same_form(rows, "form", "q").select("form", "spellings", "n")


def a21_set_hash(spark: SparkSession, d: str) -> DataFrame:
    return G.set_hash(table(spark, d, "approved_qa_alias_fixture"), ["qa_id", "question", "approved_answer", "status"])


def x2_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """Questions against their normalized form: numbers kept, negation kept, length within a half."""
    rows = table(spark, d, "manufacturing_chunks").filter("question_text is not null and normalized_question is not null")
    rows = materialize(rows.select("row_no", X.index_form(F.col("question_text")).alias("a"), X.index_form(F.col("normalized_question")).alias("b")), "rewrites")
    numbers = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("[0-9]+"), F.lit(0))))
    negated = lambda c: F.col(c).rlike("ない|ません|不|无| not |never|without")
    ratio = F.length("b") / F.greatest(F.length("a"), F.lit(1))
    return rows.select("row_no", (numbers("a") == numbers("b")).alias("numbers"), (negated("a") == negated("b")).alias("negation"), ratio.between(0.5, 1.5).alias("length"))


def x3_citations(spark: SparkSession, d: str) -> DataFrame:
    """Per status: answers, citations and those whose source the manifest has."""
    qa = table(spark, d, "approved_qa_alias_fixture")
    known = table(spark, d, "source_manifest").select("source_doc").filter("source_doc is not null").distinct().withColumn("known", F.lit(1))
    cited = qa.select("status", "row_no", F.explode_outer("approved_citations.source_doc").alias("source_doc")).join(known, "source_doc", "left")
    return cited.groupBy("status").agg(F.countDistinct("row_no").alias("answers"), F.count("source_doc").alias("citations"), F.coalesce(F.sum("known"), F.lit(0)).cast("long").alias("known"))


def x5_split(spark: SparkSession, d: str) -> DataFrame:
    """Tuning and validation halves by hash of the question's key, so that copies stay together."""
    rows = table(spark, d, "approved_qa_alias_fixture").filter("question is not null").select("row_no", X.strong_key(F.col("question")).alias("k"))
    return rows.select("row_no", F.when(X.hash_share(F.col("k"), "tune") < 5000, "tuning").otherwise("validation").alias("half"))


def n7_match_words(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "semantic_challenge_v2_cases").select(F.explode(X.match_words(F.col("query"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n"))


def n13_shortened(spark: SparkSession, d: str) -> DataFrame:
    short = G.shortened(F.col("text"), 200)
    return table(spark, d, "documents").select("doc_id", F.sha2(short, 256).alias("short_sha"), (F.length("text") > 200).alias("cut"))


def n14_neutral(spark: SparkSession, d: str) -> DataFrame:
    forged = F.concat("text", F.lit(" [S"), F.col("chunk_index").cast("string"), F.lit("] ``` end"))
    return table(spark, d, "smoke_v2_chunks").select("row_no", F.sha2(G.neutral(forged), 256).alias("neutral_sha"))


def t6_content_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = spread(table(spark, d, "semantic_challenge_v2_chunks").select("text")).select(F.explode(X.content_terms(F.col("text"))).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("df"))


def s18_exposition(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return G.exposition(counts, "documents_total", "source", "n", "source")


QUERIES = {f.__name__: f for f in (s2_lenient_log, s3_last_days, s13_ingest, s13_stale, s13_collisions, f4_child_rows, f5_manifest, f7_audit_page, c14_cleaned, j10_generations, a9_versions, a14_spellings, a21_set_hash, x2_rewrites, x3_citations, x5_split, n7_match_words, n13_shortened, n14_neutral, t6_content_terms, s18_exposition)}

_T = lambda c="tenant_id": f"coalesce(nullif(trim({c}), ''), 'default')"
_GEN = f"""x AS (SELECT *, {_T()} AS tenant, CASE WHEN len(source_pages) > 0 THEN list_filter(source_pages, lambda p: p >= 1) ELSE [] END AS real FROM manufacturing_chunks WHERE trim(id) <> '' AND trim(text) <> ''),
g1 AS (SELECT * FROM x WHERE ingested_at < TIMESTAMP '{_CUT}'), g2 AS (SELECT * FROM x WHERE ingested_at >= TIMESTAMP '{_CUT}' AND lower(trim(coalesce(chunk_role, ''))) <> 'parent')"""
_SK = lambda c: f"regexp_replace({INDEX(c)}, '{X.PUNCT}', '', 'g')"
_LINES13 = _RECONCILING["c13_repeated_lines"]
_NUMS = lambda c: f"list_sort(list_distinct(regexp_extract_all({c}, '[0-9]+')))"
_NEG = lambda c: f"regexp_matches({c}, 'ない|ません|不|无| not |never|without')"
_STOP = ", ".join(f"'{t}'" for t in X.STOP_TERMS)
SQL = {
    "s2_lenient_log": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS rows, count(*) FILTER (event_id % 50 = 0) AS malformed FROM events GROUP BY 1",
    "s3_last_days": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE CAST(ts AS DATE) > (SELECT max(CAST(ts AS DATE)) - 7 FROM events) GROUP BY 1, 2",
    "s13_ingest": f"WITH {_GEN} SELECT row_no, tenant AS tenant_id, coalesce(searchable, 1) AS searchable, real[1] AS page_start, real[len(real)] AS page_end, 'g2' AS generation FROM g2",
    "s13_stale": f"WITH {_GEN} SELECT row_no, id FROM g1 WHERE EXISTS (SELECT 1 FROM g2 WHERE g2.tenant = g1.tenant AND g2.source_doc = g1.source_doc) AND NOT EXISTS (SELECT 1 FROM g2 WHERE g2.tenant = g1.tenant AND g2.source_doc = g1.source_doc AND g2.id = g1.id)",
    "s13_collisions": f"WITH {_GEN}, u AS (SELECT source_doc, tenant, true AS old FROM g1 UNION ALL SELECT source_doc, tenant, false FROM g2) SELECT source_doc, count(DISTINCT tenant) AS tenants FROM u GROUP BY 1 HAVING count(DISTINCT tenant) > 1 AND bool_or(old) AND bool_or(NOT old)",
    "f4_child_rows": "SELECT chunk_type, count(*) AS n FROM manufacturing_chunks WHERE lower(trim(coalesce(chunk_role, ''))) IN ('', 'child', 'leaf') GROUP BY 1",
    "f5_manifest": f"SELECT row_no, source_doc FROM source_manifest WHERE {_T()} = 'default' AND source_type IN ('pdf', 'xlsx', 'docx') AND size_bytes > 100000",
    "f7_audit_page": f"SELECT row_no, qa_id FROM approved_qa_alias_fixture WHERE created_at >= TIMESTAMP '2026-03-01' AND {_T()} IN ('default', 'tenant-a', 'tenant-b') AND status = 'approved' AND (contains(lower(approved_answer), '点検') OR contains(lower(approved_answer), 'replace')) ORDER BY created_at DESC, row_no LIMIT 100",
    "c14_cleaned": f"""WITH r AS ({_LINES13}), k AS (SELECT source_doc, list(line) AS keys FROM r GROUP BY 1), s AS (SELECT d.doc_id, d.source_doc, text, string_split(text, chr(10)) AS l, coalesce(keys, []) AS keys FROM documents d LEFT JOIN k ON d.source_doc = k.source_doc),
c AS (SELECT *, list_filter(l, lambda x: NOT (trim(x) <> '' AND length(trim(x)) <= 40 AND list_contains(keys, regexp_replace(trim(x), '[0-9]', '#', 'g')))) AS kept FROM s)
SELECT source_doc, count(*) AS n_docs, count(*) FILTER (len(kept) < len(l)) AS changed, CAST(sum(len(l) - len(kept)) AS BIGINT) AS removed, CAST(sum(length(text)) AS BIGINT) AS "before", CAST(sum(length(array_to_string(kept, chr(10)))) AS BIGINT) AS "after" FROM c GROUP BY 1""",
    "j10_generations": """WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, row_no) AS r FROM semantic_challenge_v2_chunks WHERE ingested_at < TIMESTAMP '2026-04-01' AND id IS NOT NULL) WHERE r = 1), n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, row_no) AS r FROM semantic_challenge_v2_chunks WHERE id IS NOT NULL) WHERE r = 1)
SELECT CASE WHEN l.id IS NULL THEN 'only_b' WHEN n.id IS NULL THEN 'only_a' WHEN l.text IS NOT DISTINCT FROM n.text THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM l FULL JOIN n ON l.id = n.id GROUP BY 1""",
    "a9_versions": "SELECT 'doc_version' AS part, coalesce(doc_version, '') AS value, count(*) AS n FROM source_manifest GROUP BY 2 UNION ALL SELECT 'type', coalesce(type, ''), count(*) FROM semantic_challenge_v2_chunks GROUP BY 2 UNION ALL SELECT 'quality', coalesce(quality, ''), count(*) FROM semantic_challenge_v2_chunks GROUP BY 2",
    "a14_spellings": f"WITH k AS (SELECT normalized_question AS q, {_SK('normalized_question')} AS form FROM manufacturing_chunks WHERE normalized_question IS NOT NULL) SELECT form, count(DISTINCT q) AS spellings, count(*) AS n FROM k GROUP BY 1 HAVING count(DISTINCT q) >= 2",
    "a21_set_hash": "SELECT count(*) AS n, CAST(sum(CAST(CAST('0x' || substr(sha256(concat_ws(chr(1), coalesce(qa_id, chr(0)), coalesce(question, chr(0)), coalesce(approved_answer, chr(0)), coalesce(status, chr(0)))), 1, 12) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS digest FROM approved_qa_alias_fixture",
    "x2_rewrites": f"WITH r AS (SELECT row_no, {INDEX('question_text')} AS a, {INDEX('normalized_question')} AS b FROM manufacturing_chunks WHERE question_text IS NOT NULL AND normalized_question IS NOT NULL) SELECT row_no, {_NUMS('a')} = {_NUMS('b')} AS numbers, {_NEG('a')} = {_NEG('b')} AS negation, length(b) / greatest(length(a), 1) BETWEEN 0.5 AND 1.5 AS length FROM r",
    "x3_citations": "WITH c AS (SELECT status, row_no, unnest(CASE WHEN len(approved_citations) > 0 THEN list_transform(approved_citations, lambda x: x.source_doc) ELSE [NULL] END) AS source_doc FROM approved_qa_alias_fixture), k AS (SELECT DISTINCT source_doc FROM source_manifest WHERE source_doc IS NOT NULL) SELECT status, count(DISTINCT row_no) AS answers, count(c.source_doc) AS citations, count(k.source_doc) AS known FROM c LEFT JOIN k ON c.source_doc = k.source_doc GROUP BY 1",
    "x5_split": f"WITH k AS (SELECT row_no, {_SK('question')} AS k FROM approved_qa_alias_fixture WHERE question IS NOT NULL) SELECT row_no, CASE WHEN CAST('0x' || substr(sha256('tune:' || k), 1, 8) AS BIGINT) % 10000 < 5000 THEN 'tuning' ELSE 'validation' END AS half FROM k",
    "n7_match_words": f"WITH w AS (SELECT unnest(string_split(regexp_replace({INDEX('query')}, '[\\p{{P}}\\p{{S}} \\t\\n\\r]+', ' ', 'g'), ' ')) AS word FROM semantic_challenge_v2_cases) SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1",
    "n13_shortened": "SELECT doc_id, sha256(CASE WHEN length(text) > 200 THEN substr(text, 1, 199) || '…' ELSE text END) AS short_sha, length(text) > 200 AS cut FROM documents",
    "n14_neutral": "SELECT row_no, sha256(regexp_replace(replace(text || ' [S' || chunk_index || '] ``` end', '```', ''''''''), '\\[(S[0-9]+)\\]', '(\\1)', 'g')) AS neutral_sha FROM smoke_v2_chunks",
    "t6_content_terms": f"WITH x AS (SELECT {INDEX('text')} AS s FROM semantic_challenge_v2_chunks), t AS (SELECT unnest(list_distinct(list_filter(regexp_extract_all(s, '{X.CONTENT}'), lambda t: length(t) >= 2 AND t NOT IN ({_STOP})))) AS term FROM x) SELECT term, count(*) AS df FROM t GROUP BY 1",
    "s18_exposition": "SELECT 'documents_total{source=\"' || replace(replace(replace(coalesce(source, ''), '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n') || '\"} ' || count(*) AS line FROM documents GROUP BY source",
}
