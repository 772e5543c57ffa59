"""Lookups, diffs and chunk shaping over the corpus and answer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import reconcile as C
from ..operators import retrieval as R
from ..sources import store
from ..sources.tables import table
from .text import INDEX

_HEADING = r"^(第[0-9]+章|■|【|[0-9]+\.[0-9]+ |Chapter [0-9]+|NOTE -)"


def j1_approved_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Questions in wide letters, of rows divisible by 20, and the aliases of the rows after them, against all approved answers by strong key."""
    qa = table(spark, d, "approved_qa_alias_fixture")
    wide = F.translate("question", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ?", "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ？")
    asked = qa.filter("row_no % 20 = 0").select((F.col("row_no") * 100).alias("q"), wide.alias("t"))
    alias = qa.filter("row_no % 20 = 1").select("row_no", F.posexplode("approved_aliases").alias("i", "t")).select((F.col("row_no") * 100 + F.col("i") + 1).alias("q"), "t")
    return C.lookup(asked.unionByName(alias).filter("t is not null"), "q", "t", qa, "row_no", "question", "approved_aliases")


def j7_manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    """The manifest as of 1 April against its last state, by document version."""
    m = table(spark, d, "source_manifest")
    last = lambda df: C.newest(df, ["source_doc"], F.desc("updated_at"), F.col("row_no"))
    gone = table(spark, d, "index_tombstones").filter("target_table = 'source_manifest'").groupBy(F.col("target_key").alias("source_doc")).agg(F.max("deleted_at").alias("deleted_at"))
    after = last(m).join(gone, "source_doc", "left").filter("deleted_at is null or deleted_at < updated_at")
    digest = lambda df: df.select("source_doc", F.sha2(F.concat_ws("|", "doc_version", F.col("size_bytes").cast("string")), 256).alias("digest"))
    return C.diff(digest(last(m.filter("updated_at < '2026-04-01'"))), digest(after), "source_doc", "digest")


def j8_alignment(spark: SparkSession, d: str) -> DataFrame:
    return C.alignment(table(spark, d, "semantic_challenge_v2_chunks"), table(spark, d, "source_manifest"), "source_doc")


def j9_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Chunks per source whose source the manifest lacks, and those that are not searchable."""
    known = table(spark, d, "source_manifest").select("source_doc").distinct().withColumn("known", F.lit(True))
    rows = table(spark, d, "semantic_challenge_v2_chunks").join(known, "source_doc", "left")
    return rows.groupBy("source_doc").agg(F.count("*").alias("chunks"), F.sum(F.col("known").isNull().cast("long")).alias("unknown"), F.sum((F.coalesce("searchable", F.lit(1)) == 0).cast("long")).alias("hidden")).filter("unknown > 0 or hidden > 0")


def j11_freshness(spark: SparkSession, d: str) -> DataFrame:
    """Days from update to ingestion of the newest version of each source, in classes."""
    m = C.newest(table(spark, d, "source_manifest"), ["source_doc"], F.desc("updated_at"), F.col("row_no"))
    days = F.datediff("ingested_at", "updated_at")
    kind = F.when(days <= 0, "same day").when(days <= 7, "week").otherwise("stale")
    return m.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.max(days).cast("long").alias("worst_days"))


def j13_nearest_questions(spark: SparkSession, d: str) -> DataFrame:
    """Cases with row_no divisible by 20: the nearest approved question by bigram sets."""
    asked = table(spark, d, "semantic_challenge_v2_cases").filter("row_no % 20 = 0").select(F.col("row_no").alias("q"), F.col("query").alias("text"))
    known = table(spark, d, "approved_qa_alias_fixture").select(F.col("row_no").alias("key"), F.col("question").alias("text"))
    return C.nearest_by_bigrams(asked, known, "q", "key", "text", 0.5)


def j15_typo_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Latin words that occur once against words that occur often, one edit apart."""
    words = table(spark, d, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return C.typo_pairs(words.filter("n = 1").select("word"), words.filter("n >= 5").select("word"), "word")


def c13_repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.repeated_lines(table(spark, d, "documents"), "doc_id", "source_doc", "text", least_share=0.1)


def c4_heading_blocks(spark: SparkSession, d: str) -> DataFrame:
    return C.heading_blocks(table(spark, d, "documents"), "doc_id", "text", _HEADING)


def f2_base_where(spark: SparkSession, d: str) -> DataFrame:
    clause = {"$and": [{"quality": {"$in": ["high", "synthetic"]}}, {"$or": [{"searchable": 1}, {"chunk_index": {"$lt": 3}}]}, {"source_doc": {"$ne": "kyotsu_anzen_tebiki.pdf"}}]}
    return table(spark, d, "semantic_challenge_v2_chunks").filter(store.where(clause)).select("row_no", "quality")


def f1_tenants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manufacturing_chunks").filter(store.tenant_is("default")).select("row_no", "tenant_id")


def s12_document_replace(spark: SparkSession, d: str) -> DataFrame:
    """Rows ingested before May, with those of documents ingested since in place of the old ones."""
    rows = table(spark, d, "smoke_v2_chunks").select("row_no", "doc_id", "ingested_at")
    return store.upsert(rows.filter("ingested_at < '2026-05-01'"), rows.filter("ingested_at >= '2026-05-01'"), ["doc_id"]).select("row_no", "doc_id")


def s11_store_problems(spark: SparkSession, d: str) -> DataFrame:
    return store.problems(table(spark, d, "embeddings"), "vec_id", "embedding")


def s20_pair_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Approved answers as question and answer chunks with stable ids; empty answers and repeated rows left out."""
    qa = table(spark, d, "approved_qa_alias_fixture").filter((X.evidence_key(F.col("question")) != "") & (X.evidence_key(F.col("approved_answer")) != ""))
    one = C.newest(qa, ["qa_id"], F.desc("ingested_at"), F.col("row_no"))
    text = F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "approved_answer")
    return one.select(F.concat(F.lit("approved_qa_pair:"), "qa_id").alias("id"), F.substring(F.sha2(text, 256), 1, 16).alias("digest"), F.size(F.coalesce("approved_citations", F.array())).cast("long").alias("n_citations"))


def s22_merged_index(spark: SparkSession, d: str) -> DataFrame:
    """Both chunk tables without deleted chunks, one row per id, the newest version."""
    parts = []
    for name in ("semantic_challenge_v2_chunks", "smoke_v2_chunks"):
        gone = table(spark, d, "index_tombstones").filter(F.col("target_table") == name).groupBy(F.col("target_key").alias("id")).agg(F.max("deleted_at").alias("deleted_at"))
        last = C.newest(table(spark, d, name), ["id"], F.desc("updated_at"), F.col("row_no")).join(gone, "id", "left").filter("deleted_at is null or deleted_at < updated_at")
        parts.append(last.select(F.lit(name).alias("src_table"), "id", "row_no"))
    return parts[0].unionByName(parts[1])


def a15_repeated_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "semantic_challenge_v2_chunks").groupBy("id").agg(F.count("*").alias("n"), F.countDistinct("text").alias("texts")).filter("n > 1")


def a16_latest_per_question(spark: SparkSession, d: str) -> DataFrame:
    qa = table(spark, d, "approved_qa_alias_fixture").withColumn("k", X.strong_key(F.col("question"))).filter("k is not null and k <> ''")
    return C.newest(qa, ["tenant_id", "k"], F.desc_nulls_last("created_at"), F.col("row_no")).select("row_no", "k")


def a17_latest_deletion(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "index_tombstones").groupBy("target_table", "target_key").agg(F.max("deleted_at").alias("t"), F.count("*").alias("n"))
    return t.select("target_table", "target_key", F.date_format("t", "yyyy-MM-dd HH:mm:ss").alias("last_deleted"), "n")


def a18_distribution(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "semantic_challenge_v2_chunks")
    missing = rows.agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in ("searchable_text", "searchable", "quality", "tenant_id", "topic_id")])
    return missing.unpivot(["n"], ["searchable_text", "searchable", "quality", "tenant_id", "topic_id"], "field", "missing").select("field", "missing", F.round(F.col("missing") / F.col("n"), 6).alias("share"))


def a20_plan_guard(spark: SparkSession, d: str) -> DataFrame:
    """Whether the diff of the manifest may be applied unseen: not with everything deleted, a fifth deleted or 500 changes."""
    c = j7_manifest_diff(spark, d).agg(*[F.sum((F.col("change") == k).cast("long")).alias(k) for k in ("added", "deleted", "modified", "same")])
    had = F.col("deleted") + F.col("modified") + F.col("same")
    return c.select("*", F.when(F.col("deleted") == had, "all deleted").when((F.col("deleted") >= 5) & (F.col("deleted") > 0.2 * had), "mass delete").when(F.col("added") + F.col("modified") + F.col("deleted") > 500, "too many changes").otherwise("ok").alias("verdict"))


def so2_id_sets(spark: SparkSession, d: str) -> DataFrame:
    a, b = table(spark, d, "semantic_challenge_v2_chunks").select("source_doc"), table(spark, d, "smoke_v2_chunks").select("source_doc")
    parts = (("both", a.intersect(b)), ("only_a", a.subtract(b)), ("only_b", b.subtract(a)))
    out = None
    for name, x in parts:
        x = x.withColumn("side", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return out.groupBy("side").agg(F.count("*").alias("n"))


def r30_follow_ups(spark: SparkSession, d: str) -> DataFrame:
    """Each user's event with the one before it as context, where it refers back (same kind within an hour)."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.lag("event_type").over(w).alias("before"), F.lag("ts").over(w).alias("at"))
    return e.filter((F.col("before") == F.col("event_type")) & (F.col("ts") <= F.col("at") + F.expr("INTERVAL 1 HOUR"))).select("event_id", "before")


QUERIES = {f.__name__: f for f in (j1_approved_lookup, j7_manifest_diff, j8_alignment, j9_consistency, j11_freshness, j13_nearest_questions, j15_typo_pairs, c13_repeated_lines, c4_heading_blocks, f1_tenants, f2_base_where, s11_store_problems, s12_document_replace, s20_pair_chunks, s22_merged_index, a15_repeated_ids, a16_latest_per_question, a17_latest_deletion, a18_distribution, a20_plan_guard, so2_id_sets, r30_follow_ups)}

_STRONG = lambda c: f"regexp_replace({INDEX(c)}, '{X.PUNCT}', '', 'g')"
_LAST = lambda w: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_doc ORDER BY updated_at DESC, row_no) AS r FROM source_manifest {w}) WHERE r = 1)"
_DIFF = f"""WITH gone AS (SELECT target_key, max(deleted_at) AS deleted_at FROM index_tombstones WHERE target_table = 'source_manifest' GROUP BY 1),
a AS (SELECT source_doc, sha256(concat_ws('|', doc_version, size_bytes)) AS h FROM {_LAST("WHERE updated_at < TIMESTAMP '2026-04-01'")}),
b AS (SELECT source_doc, sha256(concat_ws('|', doc_version, size_bytes)) AS h FROM {_LAST("")} LEFT JOIN gone ON source_doc = target_key WHERE deleted_at IS NULL OR deleted_at < updated_at),
ch AS (SELECT coalesce(a.source_doc, b.source_doc) AS source_doc, CASE WHEN a.source_doc IS NULL THEN 'added' WHEN b.source_doc IS NULL THEN 'deleted' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'same' ELSE 'modified' END AS change FROM a FULL JOIN b USING (source_doc))"""
_GRAMS = lambda c: f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"
_LINES = "list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)"
_MERGED = lambda t: f"SELECT '{t}' AS src_table, id, row_no FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC, row_no) AS r FROM {t}) LEFT JOIN (SELECT target_key, max(deleted_at) AS deleted_at FROM index_tombstones WHERE target_table = '{t}' GROUP BY 1) ON id = target_key WHERE r = 1 AND (deleted_at IS NULL OR deleted_at < updated_at)"
SQL = {
    "j1_approved_lookup": f"""WITH a AS (SELECT q, {_STRONG('t')} AS k FROM (SELECT row_no * 100 AS q, translate(question, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ?', '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ？') AS t FROM approved_qa_alias_fixture WHERE row_no % 20 = 0
UNION ALL SELECT row_no * 100 + i, approved_aliases[i] FROM (SELECT row_no, approved_aliases, unnest(range(1, len(approved_aliases) + 1)) AS i FROM approved_qa_alias_fixture WHERE row_no % 20 = 1)) WHERE t IS NOT NULL),
k AS (SELECT row_no, {_STRONG('question')} AS k, 0 AS how FROM approved_qa_alias_fixture UNION ALL SELECT row_no, {_STRONG('x')}, 1 FROM (SELECT row_no, unnest(approved_aliases) AS x FROM approved_qa_alias_fixture)),
b AS (SELECT k, arg_min(row_no, (how, row_no)) AS row_no, min(how) AS how FROM k WHERE k <> '' GROUP BY 1) SELECT q, row_no, CASE how WHEN 0 THEN 'question' ELSE 'alias' END AS how FROM a JOIN b USING (k)""",
    "j7_manifest_diff": f"{_DIFF} SELECT * FROM ch",
    "j8_alignment": "WITH a AS (SELECT DISTINCT source_doc FROM semantic_challenge_v2_chunks WHERE source_doc IS NOT NULL), b AS (SELECT DISTINCT source_doc FROM source_manifest WHERE source_doc IS NOT NULL), j AS (SELECT count(*) FILTER (a.source_doc IS NOT NULL AND b.source_doc IS NOT NULL) AS \"both\", count(*) FILTER (b.source_doc IS NULL) AS only_a, count(*) FILTER (a.source_doc IS NULL) AS only_b FROM a FULL JOIN b ON a.source_doc = b.source_doc) SELECT *, round(\"both\" / (\"both\" + only_a + only_b), 6) AS jaccard FROM j",
    "j9_consistency": "SELECT source_doc, count(*) AS chunks, count(*) FILTER (source_doc NOT IN (SELECT source_doc FROM source_manifest WHERE source_doc IS NOT NULL) OR source_doc IS NULL) AS unknown, count(*) FILTER (coalesce(searchable, 1) = 0) AS hidden FROM semantic_challenge_v2_chunks GROUP BY 1 HAVING unknown > 0 OR hidden > 0",
    "j11_freshness": f"SELECT CASE WHEN n <= 0 THEN 'same day' WHEN n <= 7 THEN 'week' ELSE 'stale' END AS kind, count(*) AS n, CAST(max(n) AS BIGINT) AS worst_days FROM (SELECT datediff('day', updated_at, ingested_at) AS n FROM {_LAST('')}) x GROUP BY 1",
    "j13_nearest_questions": f"""WITH ka AS MATERIALIZED (SELECT row_no AS q, {_STRONG('query')} AS k FROM semantic_challenge_v2_cases WHERE row_no % 20 = 0), kb AS MATERIALIZED (SELECT row_no AS key, {_STRONG('question')} AS k FROM approved_qa_alias_fixture),
a AS (SELECT q, len(g) AS na, unnest(g) AS g FROM (SELECT q, {_GRAMS('k')} AS g FROM ka)), b AS (SELECT key, len(h) AS nb, unnest(h) AS g FROM (SELECT key, {_GRAMS('k')} AS h FROM kb)),
p AS (SELECT q, key, round(count(*) / (na + nb - count(*)), 6) AS jaccard FROM a JOIN b USING (g) GROUP BY q, key, na, nb) SELECT q, key, jaccard FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY jaccard DESC, key) AS r FROM p WHERE jaccard >= 0.5) WHERE r = 1""",
    "j15_typo_pairs": "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM documents), n AS (SELECT word, count(*) AS n FROM w GROUP BY 1) SELECT a.word, b.word AS suggestion FROM n a, n b WHERE a.n = 1 AND b.n >= 5 AND levenshtein(a.word, b.word) = 1",
    "c13_repeated_lines": f"""WITH l AS (SELECT doc_id, source_doc, {_LINES} AS l FROM documents), e AS (SELECT DISTINCT doc_id, source_doc, regexp_replace(trim(x), '[0-9]', '#', 'g') AS line FROM (SELECT doc_id, source_doc, unnest(list_concat(l[1:2], l[greatest(len(l) - 1, 1):])) AS x FROM l)),
n AS (SELECT source_doc, count(DISTINCT doc_id) AS "of" FROM documents GROUP BY 1) SELECT source_doc, line, count(DISTINCT doc_id) AS pages, "of" FROM e JOIN n USING (source_doc) WHERE length(line) <= 40 GROUP BY source_doc, line, "of" HAVING count(DISTINCT doc_id) >= 3 AND count(DISTINCT doc_id) >= 0.1 * "of\"""",
    "c4_heading_blocks": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents), h AS (SELECT *, CASE WHEN regexp_matches(line, '{_HEADING}') THEN 1 ELSE 0 END AS h FROM l WHERE length(trim(line)) > 0), b AS (SELECT *, CAST(sum(h) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS block FROM h) SELECT doc_id, block, max(CASE WHEN h = 1 THEN line END) AS title, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM b GROUP BY 1, 2",
    "f1_tenants": "SELECT row_no, tenant_id FROM manufacturing_chunks WHERE coalesce(nullif(trim(tenant_id), ''), 'default') = 'default'",
    "f2_base_where": "SELECT row_no, quality FROM semantic_challenge_v2_chunks WHERE quality IN ('high', 'synthetic') AND (searchable = 1 OR chunk_index < 3) AND (source_doc IS NULL OR source_doc <> 'kyotsu_anzen_tebiki.pdf')",
    "s11_store_problems": "WITH u AS (SELECT len(embedding) AS s FROM embeddings GROUP BY 1 ORDER BY count(*) DESC, s DESC LIMIT 1) SELECT 'null key' AS problem, count(*) AS n FROM embeddings WHERE vec_id IS NULL UNION ALL SELECT 'repeated key', count(*) FROM (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'empty vector', count(*) FROM embeddings WHERE embedding IS NULL OR len(embedding) = 0 UNION ALL SELECT 'other length', count(*) FROM embeddings, u WHERE len(embedding) > 0 AND len(embedding) <> s UNION ALL SELECT 'not finite', count(*) FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) > 0",
    "s12_document_replace": "SELECT row_no, doc_id FROM smoke_v2_chunks WHERE ingested_at >= TIMESTAMP '2026-05-01' OR (ingested_at < TIMESTAMP '2026-05-01' AND doc_id NOT IN (SELECT doc_id FROM smoke_v2_chunks WHERE ingested_at >= TIMESTAMP '2026-05-01' AND doc_id IS NOT NULL))",
    "s20_pair_chunks": "SELECT 'approved_qa_pair:' || qa_id AS id, substr(sha256('Q: ' || question || chr(10) || 'A: ' || approved_answer), 1, 16) AS digest, coalesce(len(approved_citations), 0) AS n_citations FROM (SELECT *, row_number() OVER (PARTITION BY qa_id ORDER BY ingested_at DESC, row_no) AS r FROM approved_qa_alias_fixture WHERE regexp_replace(question, '" + X.WS + "', '', 'g') <> '' AND regexp_replace(approved_answer, '" + X.WS + "', '', 'g') <> '') WHERE r = 1",
    "s22_merged_index": f"{_MERGED('semantic_challenge_v2_chunks')} UNION ALL {_MERGED('smoke_v2_chunks')}",
    "a15_repeated_ids": "SELECT id, count(*) AS n, count(DISTINCT text) AS texts FROM semantic_challenge_v2_chunks GROUP BY 1 HAVING count(*) > 1",
    "a16_latest_per_question": f"SELECT row_no, k FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, k ORDER BY created_at DESC NULLS LAST, row_no) AS r FROM (SELECT *, {_STRONG('question')} AS k FROM approved_qa_alias_fixture) WHERE k <> '') WHERE r = 1",
    "a17_latest_deletion": "SELECT target_table, target_key, strftime(max(deleted_at), '%Y-%m-%d %H:%M:%S') AS last_deleted, count(*) AS n FROM index_tombstones GROUP BY 1, 2",
    "a18_distribution": " UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER ({c} IS NULL) AS missing, round(count(*) FILTER ({c} IS NULL) / count(*), 6) AS share FROM semantic_challenge_v2_chunks" for c in ("searchable_text", "searchable", "quality", "tenant_id", "topic_id")),
    "a20_plan_guard": f"{_DIFF}, c AS (SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'deleted') AS deleted, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'same') AS same FROM ch) SELECT *, CASE WHEN deleted = deleted + modified + same THEN 'all deleted' WHEN deleted >= 5 AND deleted > 0.2 * (deleted + modified + same) THEN 'mass delete' WHEN added + modified + deleted > 500 THEN 'too many changes' ELSE 'ok' END AS verdict FROM c",
    "so2_id_sets": "WITH a AS (SELECT DISTINCT source_doc FROM semantic_challenge_v2_chunks), b AS (SELECT DISTINCT source_doc FROM smoke_v2_chunks) SELECT 'both' AS side, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_a', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) HAVING count(*) > 0 UNION ALL SELECT 'only_b', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a) HAVING count(*) > 0",
    "r30_follow_ups": "WITH e AS (SELECT event_id, event_type, ts, lag(event_type) OVER w AS before, lag(ts) OVER w AS t FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT event_id, before FROM e WHERE before = event_type AND ts <= t + INTERVAL 1 HOUR",
}
