"""Rescoring, feedback, agreement, drift and gates over the corpus, case and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import rerank as K
from ..operators import retrieval as R
from ..operators import stats as S
from ..sources.tables import table
from . import retrieval as P
from .stats import _weeks, upper_sql
from .text import INDEX

_WORDS = {"procedure": ["手順", "やり方", "手続き"], "permission": ["許可", "allowed", "批准"], "stock": ["在庫", "spares"], "order": ["どちらを先", "先"]}


def r12_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    top = R.ranked(P._lanes(spark, d), F.col("bm25").desc(), F.col("doc"), k=10).select("q", "doc", "rank")
    rows = table(spark, d, P.CHUNKS).select(F.col("row_no").alias("doc"), *[X.index_form(F.col(c)).alias(c) for c in ("title", "question_text", "text")])
    both = top.join(rows, "doc").join(P._asked(spark, d).select("q", X.code_tokens(F.col("query")).alias("terms")), "q")
    return both.select("q", "doc", "rank", K.field_score(F.col("terms"), [(F.col("title"), 0.28), (F.col("question_text"), 0.22), (F.col("text"), 0.14)]).alias("score"))


def r13_keyword_boost(spark: SparkSession, d: str) -> DataFrame:
    s = r12_keyword_score(spark, d)
    return K.boosted(s, F.least(0.05 * F.col("score"), F.lit(0.05))).select("q", "doc", "rank", "new_rank")


def r27_feedback(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "semantic_challenge_v2_cases")
    signals = c.select(F.explode("gold_chunk_ids").alias("id"), F.lit("good").alias("kind")).unionByName(c.select(F.explode("distractor_chunk_ids").alias("id"), F.lit("bad").alias("kind")))
    return K.feedback_adjustments(signals, "id", "kind", {"good": 0.03, "bad": -0.06})


def j2_near_match(spark: SparkSession, d: str) -> DataFrame:
    """Questions of rows divisible by 20 without their last tenth against all approved questions."""
    qa = table(spark, d, "approved_qa_alias_fixture").select("row_no", "question")
    cut = F.substring("question", F.lit(1), F.floor(F.length("question") * 0.9).cast("int"))
    asked = qa.filter("row_no % 20 = 0").select(F.col("row_no").alias("q"), cut.alias("t"))
    return K.near_matches(asked, qa.select(F.col("row_no").alias("key"), F.col("question").alias("t")), "q", "key", "t")


def c15_merged_hits(spark: SparkSession, d: str) -> DataFrame:
    top = P._top(spark, d).select("q", F.col("source_doc").alias("doc"), F.col("doc").alias("chunk"), "rank", "chars")
    return K.merge_neighbours(top).select("q", "doc", "first_rank", "n_members", "chars")


def x1_unsupported_claims(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "manufacturing_chunks").filter("approved_answer is not null")
    return rows.select("row_no", F.explode(K.unsupported(F.col("approved_answer"), F.col("question_text"))).alias("term"))


def m12_rater_agreement(spark: SparkSession, d: str) -> DataFrame:
    return K.agreement(table(spark, d, "document_labels"), "doc_id", "rater", "toxic")


def m8_regression_gate(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of the cosine run that fall more than 0.02 below the BM25 run."""
    rows = P.m5_mode_summary(spark, d).unpivot(["mode"], ["hit", "recall", "mrr", "ndcg"], "metric", "value")
    wide = rows.groupBy("metric").agg(F.max(F.when(F.col("mode") == "bm25", F.col("value"))).alias("baseline"), F.max(F.when(F.col("mode") == "cosine", F.col("value"))).alias("value"))
    return wide.select("*", (F.col("value") < F.col("baseline") - 0.02).alias("worse"))


def m10_shadow(spark: SparkSession, d: str) -> DataFrame:
    """How often the first document changes between two runs."""
    a, b = ({"a": x.filter("rank = 1").select("q", F.col("item").alias("x"))}["a"] for x in P._runs(spark, d))
    both = a.join(b.withColumnRenamed("x", "y"), "q", "full")
    return both.agg(F.count("*").alias("queries"), F.sum((~F.col("x").eqNullSafe(F.col("y"))).cast("long")).alias("changed"), F.sum((F.col("y").isNull() & F.col("x").isNotNull()).cast("long")).alias("lost"))


def st14_drift(spark: SparkSession, d: str) -> DataFrame:
    """Week against week: stability of values by quantile bins and greatest distance, with the verdict of fixed limits."""
    a, b = _weeks(spark, d)
    psi, ks = S.psi(a, b, "value").select("psi").scalar(), S.ks(a, b, "value").select("d").scalar()
    one = spark.range(1).select(psi.alias("psi"), ks.alias("d"))
    return one.select("psi", "d", F.when((F.col("psi") >= 0.25) | (F.col("d") >= 0.2), "alert").when((F.col("psi") >= 0.1) | (F.col("d") >= 0.1), "warn").otherwise("ok").alias("verdict"))


def f8_question_types(spark: SparkSession, d: str) -> DataFrame:
    """Rules as data: the first kind, in order of priority, one of whose words the question holds."""
    q = F.col("query")
    kind = F.lit("other")
    for name, words in reversed(_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(q, F.lit(w))
        kind = F.when(hit, name).otherwise(kind)
    return table(spark, d, "semantic_challenge_v2_cases").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def t15_perturbed(spark: SparkSession, d: str) -> DataFrame:
    """Each query in one of eight disturbed forms picked by hash: wide letters, spaces, a swap, no punctuation, a filler, a casual ending, short vowels, lower case."""
    q = F.col("query")
    pick = F.pmod(F.conv(F.substring(F.md5(F.col("case_id")), 1, 8), 16, 10).cast("long"), F.lit(8))
    wide = F.translate(q, "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", "０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    swap = F.concat(F.substring(q, 1, 2), F.substring(q, 4, 1), F.substring(q, 3, 1), F.substring(q, 5, 1_000_000))
    forms = [wide, F.regexp_replace(q, "([0-9]+)", " $1 "), swap, F.regexp_replace(q, r"\p{P}", ""), F.concat(F.lit("えーと、"), q), F.regexp_replace(q, "(ですか|ますか)[?？]?$", "っけ？"), F.replace(q, F.lit("ー"), F.lit("")), F.lower(q)]
    form = F.element_at(F.array(*forms), (pick + 1).cast("int"))
    return table(spark, d, "semantic_challenge_v2_cases").filter("query is not null").select("row_no", pick.alias("kind"), form.alias("form"))


def a12_feedback_by_tenant(spark: SparkSession, d: str) -> DataFrame:
    """Users' last verdicts (error bad, purchase good) per tenant, with the upper bound of the bad share."""
    e = table(spark, d, "events").filter("event_type in ('error', 'purchase')")
    last = R.first_by_key(e, ["user_id"], F.col("ts").desc(), F.col("event_id"))
    per = last.groupBy((F.col("user_id") % 5).alias("tenant")).agg(F.count("*").alias("n"), F.sum((F.col("event_type") == "error").cast("long")).alias("bad"))
    return per.select("tenant", "n", "bad", F.round(S.binomial_upper("bad", "n"), 6).alias("upper"))


def a13_case_summary(spark: SparkSession, d: str) -> DataFrame:
    """Cases overall, by category and by category and answerability, in one pass."""
    c = table(spark, d, "semantic_challenge_v2_cases").select(F.coalesce("challenge_category", F.lit("none")).alias("category"), F.coalesce(F.col("answerable").cast("string"), F.lit("unknown")).alias("answerable"), F.size(F.coalesce("gold_chunk_ids", F.array())).alias("golds"))
    g = c.rollup("category", "answerable").agg(F.count("*").alias("n"), F.round(F.avg("golds"), 6).alias("mean_golds"))
    return g.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("answerable", F.lit("all")).alias("answerable"), "n", "mean_golds")


def f6_record_page(spark: SparkSession, d: str) -> DataFrame:
    """The second page of fifty, newest first, of approved Japanese answers that speak of a permission."""
    rows = table(spark, d, "approved_qa_alias_fixture").filter((F.col("status") == "approved") & (F.lower(F.substring("language", 1, 2)) == "ja") & F.contains("approved_answer", F.lit("許可")))
    return rows.orderBy(F.desc("created_at"), "row_no").offset(50).limit(50).select("row_no", "qa_id")


def ss8_probe_notices(spark: SparkSession, d: str) -> DataFrame:
    """Per tenant: runs of failures announced at the second failure, with their length."""
    from pyspark.sql import Window as W

    from ..operators.logs import islands
    from .operations import _calls

    runs = islands(_calls(spark, d), "tenant", ["ts", "event_id"], F.col("event_type") == "error")
    numbered = runs.withColumn("k", F.row_number().over(W.partitionBy("tenant", "island").orderBy("ts", "event_id")))
    per = numbered.groupBy("tenant", "island").agg(F.count("*").alias("n"), F.max(F.when(F.col("k") == 2, F.col("event_id"))).alias("announced_at"))
    return per.filter("n >= 2")


def r2_by_label(spark: SparkSession, d: str) -> DataFrame:
    """Of each label, how many of the ten nearest vectors share it (m2 with labels as relevance)."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    near = P.r2_dense_topk(spark, d).filter("q <> doc")
    both = near.join(e.select(F.col("vec_id").alias("q"), F.col("label").alias("ql")), "q").join(e.select(F.col("vec_id").alias("doc"), "label"), "doc")
    return both.groupBy("ql").agg(F.count("*").alias("n"), F.sum((F.col("label") == F.col("ql")).cast("long")).alias("same"))


QUERIES = {f.__name__: f for f in (r2_by_label, r12_keyword_score, r13_keyword_boost, r27_feedback, j2_near_match, c15_merged_hits, x1_unsupported_claims, m8_regression_gate, m10_shadow, m12_rater_agreement, st14_drift, f8_question_types, t15_perturbed, a12_feedback_by_tenant, a13_case_summary, f6_record_page, ss8_probe_notices)}

_CODES = lambda c: f"list_distinct(list_concat(list_filter(list_transform(regexp_extract_all(lower({c}), '{X.CODE}'), lambda t: regexp_replace(t, '{X.CODE_TAIL}', '')), lambda t: length(t) >= 2), list_transform(list_filter(list_transform(regexp_extract_all(lower({c}), '{X.CODE}'), lambda t: regexp_replace(t, '{X.CODE_TAIL}', '')), lambda t: length(t) >= 2), lambda t: regexp_replace(t, '[._:/-]', '', 'g'))))"
_KW = f"""{P._L}, t10 AS (SELECT * FROM (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc) AS rank FROM lanes) WHERE rank <= 10),
f AS (SELECT row_no AS doc, {INDEX('title')} AS a, {INDEX('question_text')} AS b, {INDEX('text')} AS c FROM manufacturing_chunks), ask AS (SELECT row_no AS q, {_CODES('normalized_question')} AS terms FROM manufacturing_chunks WHERE row_no % 20 = 0 AND normalized_question IS NOT NULL),
kw AS (SELECT q, doc, rank, round(least(coalesce(list_sum(list_transform(terms, lambda t: CASE WHEN coalesce(contains(a, t), false) THEN 0.28::DOUBLE WHEN coalesce(contains(b, t), false) THEN 0.22::DOUBLE WHEN coalesce(contains(c, t), false) THEN 0.14::DOUBLE ELSE 0::DOUBLE END)), 0), 1.0), 4) AS score FROM t10 JOIN f USING (doc) JOIN ask USING (q))"""
_SK = lambda c: f"regexp_replace({INDEX(c)}, '{X.PUNCT}', '', 'g')"
_NUMS = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[a-z0-9]*[0-9][a-z0-9._:-]*[a-z0-9]|[0-9]'))"
_F8 = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(query, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{k}'" for k, ws in _WORDS.items()) + " ELSE 'other' END"
_PICK = "CAST('0x' || substr(md5(case_id), 1, 8) AS BIGINT) % 8"
T15_FORM = f"""CASE {_PICK} WHEN 0 THEN translate(query, '0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', '０１２３４５６７８９ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ') WHEN 1 THEN regexp_replace(query, '([0-9]+)', ' \\1 ', 'g') WHEN 2 THEN substr(query, 1, 2) || substr(query, 4, 1) || substr(query, 3, 1) || substr(query, 5) WHEN 3 THEN regexp_replace(query, '\\p{{P}}', '', 'g') WHEN 4 THEN 'えーと、' || query WHEN 5 THEN regexp_replace(query, '(ですか|ますか)[?？]?$', 'っけ？') WHEN 6 THEN replace(query, 'ー', '') ELSE lower(query) END"""
def _drift_sql() -> str:
    from .stats import SQL as stats_sql

    verdict = "CASE WHEN psi >= 0.25 OR d >= 0.2 THEN 'alert' WHEN psi >= 0.1 OR d >= 0.1 THEN 'warn' ELSE 'ok' END AS verdict"
    return f"SELECT psi, d, {verdict} FROM ({stats_sql['st8_psi']}), (SELECT d FROM ({stats_sql['st9_ks']}))"


SQL = {
    "st14_drift": _drift_sql(),
    "a12_feedback_by_tenant": "SELECT tenant, n, k AS bad, upper FROM (" + upper_sql("SELECT user_id % 5 AS tenant, count(*) FILTER (event_type = 'error') AS k, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type IN ('error', 'purchase')) WHERE r = 1 GROUP BY 1", "tenant") + ")",
    "r2_by_label": f"WITH {P._SIM}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM sims) WHERE rank <= 10 AND q <> doc) SELECT a.label AS ql, count(*) AS n, count(*) FILTER (a.label = b.label) AS same FROM t JOIN embeddings a ON a.vec_id = q JOIN embeddings b ON b.vec_id = doc GROUP BY 1",
    "r12_keyword_score": f"{_KW} SELECT q, doc, rank, score FROM kw",
    "r13_keyword_boost": f"{_KW}, m AS (SELECT *, least(0.05 * score, 0.05) AS b FROM kw) SELECT q, doc, rank, row_number() OVER (PARTITION BY q ORDER BY greatest(rank - CASE WHEN b > 0 THEN 1 ELSE 0 END, 1), b DESC, rank) AS new_rank FROM m",
    "r27_feedback": "WITH s AS (SELECT unnest(gold_chunk_ids) AS id, 0.03 AS w FROM semantic_challenge_v2_cases UNION ALL SELECT unnest(distractor_chunk_ids), -0.06 FROM semantic_challenge_v2_cases) SELECT id, count(*) AS n, round(greatest(least(sum(w::DOUBLE), 0.05), -0.10), 6)::DOUBLE AS adjustment FROM s WHERE id IS NOT NULL GROUP BY 1",
    "j2_near_match": f"WITH a AS (SELECT row_no AS q, {_SK('substr(question, 1, CAST(floor(length(question) * 0.9) AS BIGINT))')} AS a FROM approved_qa_alias_fixture WHERE row_no % 20 = 0), b AS (SELECT row_no AS key, {_SK('question')} AS b FROM approved_qa_alias_fixture) SELECT DISTINCT q, key FROM a, b WHERE length(a) >= 18 AND length(b) >= 18 AND least(length(a), length(b)) >= 0.8 * greatest(length(a), length(b)) AND (contains(a, b) OR contains(b, a))",
    "x1_unsupported_claims": f"WITH r AS (SELECT row_no, {_NUMS('approved_answer')} AS a, coalesce({_NUMS('question_text')}, []) AS b FROM manufacturing_chunks WHERE approved_answer IS NOT NULL) SELECT row_no, unnest(list_filter(a, lambda x: NOT list_contains(b, x))) AS term FROM r",
    "m12_rater_agreement": "WITH v AS (SELECT doc_id, rater, toxic AS v, sum(toxic) OVER (PARTITION BY doc_id) AS s, count(*) OVER (PARTITION BY doc_id) AS n FROM document_labels WHERE toxic IS NOT NULL), o AS (SELECT rater, v, 2 * (s - v) - (n - 1) AS lean FROM v WHERE 2 * (s - v) <> n - 1), c AS (SELECT rater, count(*) AS n, count(*) FILTER (v = 1 AND lean > 0) AS tp, count(*) FILTER (v = 1 AND lean < 0) AS fp, count(*) FILTER (v = 0 AND lean > 0) AS fn, count(*) FILTER (v = 0 AND lean < 0) AS tn FROM o GROUP BY 1), k AS (SELECT *, (tp + tn) / n AS seen, ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n) AS chance FROM c) SELECT rater, n, tp, fp, fn, tn, CASE WHEN chance < 1 THEN round((seen - chance) / (1 - chance), 6) ELSE 1.0 END AS kappa FROM k",
    "m8_regression_gate": f"{P._ME}, s AS (SELECT 'bm25' AS mode, * FROM met_a UNION ALL SELECT 'cosine', * FROM met_b), u AS (" + " UNION ALL ".join(f"SELECT mode, '{m}' AS metric, round(avg({m}), 6) AS value FROM s GROUP BY 1" for m in ("hit", "recall", "mrr", "ndcg")) + ") SELECT metric, max(CASE WHEN mode = 'bm25' THEN value END) AS baseline, max(CASE WHEN mode = 'cosine' THEN value END) AS value, max(CASE WHEN mode = 'cosine' THEN value END) < max(CASE WHEN mode = 'bm25' THEN value END) - 0.02 AS worse FROM u GROUP BY 1",
    "m10_shadow": f"{P._L}, {P._run_sql('bm25', 'run_a')}, {P._run_sql('cosine', 'run_b')} SELECT count(*) AS queries, count(*) FILTER (a.item IS DISTINCT FROM b.item) AS changed, count(*) FILTER (b.item IS NULL AND a.item IS NOT NULL) AS lost FROM (SELECT * FROM run_a WHERE rank = 1) a FULL JOIN (SELECT * FROM run_b WHERE rank = 1) b ON a.q = b.q",
    "f8_question_types": f"SELECT {_F8} AS kind, count(*) AS n FROM semantic_challenge_v2_cases GROUP BY 1",
    "t15_perturbed": f"SELECT row_no, {_PICK} AS kind, {T15_FORM} AS form FROM semantic_challenge_v2_cases WHERE query IS NOT NULL",
    "a13_case_summary": "WITH c AS (SELECT coalesce(challenge_category, 'none') AS category, coalesce(CAST(answerable AS VARCHAR), 'unknown') AS answerable, coalesce(len(gold_chunk_ids), 0) AS golds FROM semantic_challenge_v2_cases) SELECT coalesce(category, 'all') AS category, coalesce(answerable, 'all') AS answerable, count(*) AS n, round(avg(golds), 6) AS mean_golds FROM c GROUP BY ROLLUP (category, answerable)",
    "f6_record_page": "SELECT row_no, qa_id FROM approved_qa_alias_fixture WHERE status = 'approved' AND lower(substr(language, 1, 2)) = 'ja' AND contains(approved_answer, '許可') ORDER BY created_at DESC, row_no LIMIT 50 OFFSET 50",
    "ss8_probe_notices": "WITH f AS (SELECT *, user_id % 5 AS tenant, event_type = 'error' AS f FROM events), s AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER w, false) THEN 1 ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY tenant ORDER BY ts, event_id)), i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY tenant ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY tenant, island ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY tenant, island) AS n FROM i WHERE f) SELECT tenant, island, n, event_id AS announced_at FROM r WHERE n >= 2 AND k = 2",
}
