"""Containment, candidate pools, guards and further rank rules over the case, answer and vector tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import reconcile as C
from ..operators import retrieval as R
from ..operators import stats as S
from ..operators.bigrams import most_alike
from ..sources.tables import materialize, table
from . import retrieval as P
from .reconciling import _STRONG
from .text import INDEX

CASES, CHUNKS, ANSWERS = "semantic_challenge_v2_cases", "semantic_challenge_v2_chunks", "approved_qa_alias_fixture"
# Parameters of the queries below: groups of words that mean alike, pairs that mean the opposite, endings of spoken questions.
SYNONYMS = {"inspect": ("点検", "確認", "inspect", "check"), "replace": ("交換", "取り替え", "replace", "更换"), "clean": ("清掃", "掃除", "clean", "清洁")}
OPPOSITES = (("停止", "起動"), ("外す", "取り付ける"))
ENDINGS = ["教えてください", "知りたい", "やり方は", "ですか", "ますか", "って何", "とは"]


def n9_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How much of the characters of a question its answer has, and how many of its codes the answer names."""
    rows = table(spark, d, ANSWERS).select("row_no", X.evidence_key(F.col("question")).alias("a"), X.evidence_key(F.col("approved_answer")).alias("b"))
    rows = materialize(rows, "eval-forms")
    named = F.size(F.filter(F.array_distinct(F.regexp_extract_all("a", F.lit("[a-z0-9]+-[a-z0-9]+"), F.lit(0))), lambda t: F.contains(F.col("b"), t)))
    return rows.select("row_no", X.overlap_share(F.col("a"), F.col("b")).alias("overlap"), F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), named).cast("long").alias("codes"))


def j14_synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers that share a meaning, or speak of opposites."""
    rows = table(spark, d, ANSWERS).filter("question is not null and approved_answer is not null")
    has = lambda c, words: F.array_contains(F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.col(c), w)), True)
    shared = F.array_compact(F.array(*[F.when(has("question", w) & has("approved_answer", w), k) for k, w in SYNONYMS.items()]))
    against = F.lit(False)
    for a, b in OPPOSITES:
        against = against | (has("question", (a,)) & has("approved_answer", (b,))) | (has("question", (b,)) & has("approved_answer", (a,)))
    out = rows.select("row_no", F.array_join(shared, ",").alias("shared"), against.alias("against"))
    return out.groupBy("shared", "against").agg(F.count("*").alias("n"))


def j16_terms_held(spark: SparkSession, d: str) -> DataFrame:
    """Required terms of the cases and the chunks that hold them."""
    terms = table(spark, d, CASES).select(F.explode("required_gold_support_terms").alias("term"))
    held = C.holding(table(spark, d, CHUNKS), "row_no", "text", terms, "term")
    return held.groupBy("term").agg(F.count("*").alias("chunks"))


def r21_prefer(spark: SparkSession, d: str) -> DataFrame:
    """Equal whole scores are broken by preferring answers, then shorter rows."""
    top = P._top(spark, d, 20).join(table(spark, d, P.CHUNKS).select(F.col("row_no").alias("doc"), (F.col("chunk_type") == "qa_pair").alias("pair")), "doc").withColumnRenamed("rank", "old")
    return R.ranked(top, F.floor("bm25").desc(), F.col("pair").desc_nulls_last(), F.col("chars"), F.col("doc"), k=10).select("q", "doc", "rank")


def r22_guards(spark: SparkSession, d: str) -> DataFrame:
    """What the distance of the nearest vector says of each question: nothing found, too far, near."""
    vectors, asked = P._chunk_vectors(spark, d)
    near = R.dense_topk(vectors, asked, 2).filter("q <> doc").groupBy("q").agg(F.min(F.round(1 - F.col("cosine"), 6)).alias("distance"))
    out = asked.select("q").join(near, "q", "left")
    guard = F.when(F.col("distance").isNull(), "no_results").when(F.col("distance") > 0.95, "too_far").when(F.col("distance") > 0.65, "doubtful").otherwise("near")
    return out.select("q", "distance", guard.alias("guard"))


def r26_features(spark: SparkSession, d: str) -> DataFrame:
    """Similar approved questions of cases with row_no divisible by 20, with a bonus for equal numbers and a malus where one negates."""
    asked = table(spark, d, CASES).filter("row_no % 20 = 0").select(F.col("row_no").alias("q"), F.col("query").alias("text"))
    known = table(spark, d, ANSWERS).select(F.col("row_no").alias("key"), F.col("question").alias("text"))
    numbers = lambda c: F.array_distinct(F.regexp_extract_all(F.col(c), F.lit("[0-9]+"), F.lit(0)))
    negates = lambda c: F.col(c).rlike("ない|ません|不|无| not |never|without")
    return most_alike(asked, known, "q", "key", "text", 0.4, 5, numbers, negates, 0.08, 0.04).select("q", "key", "score", "rank")


def r29_plain_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, CASES).filter("query is not null").select("row_no", X.without_endings(F.col("query"), ENDINGS).alias("plain"))


def w8_due_sources(spark: SparkSession, d: str) -> DataFrame:
    """Sources whose newest version is older than the schedule of its type allows on the first of July."""
    m = C.newest(table(spark, d, "source_manifest").filter("source_doc is not null"), ["source_doc"], F.desc_nulls_last("updated_at"), F.col("row_no"))
    days = F.when(F.col("source_type") == "pdf", 90).when(F.col("source_type") == "xlsx", 30).otherwise(60)
    late = F.datediff(F.lit("2026-07-01").cast("date"), F.to_date("updated_at")) - days
    return m.filter(late > 0).select("source_doc", late.cast("long").alias("days_late"))


def x6_pools(spark: SparkSession, d: str) -> DataFrame:
    """Every case ranks its own gold and distractor chunks by shared bigrams: the rank of the first gold one."""
    cases = table(spark, d, CASES).select("row_no", "query", "gold_chunk_ids", "distractor_chunk_ids")
    pool = cases.select("row_no", F.explode("gold_chunk_ids").alias("id"), F.lit(1).alias("label")).unionByName(cases.select("row_no", F.explode("distractor_chunk_ids").alias("id"), F.lit(0).alias("label")))
    pool = pool.filter("id is not null").groupBy("row_no", "id").agg(F.max("label").alias("label"))
    rows = table(spark, d, CHUNKS).filter("id is not null")
    texts = R.first_by_key(rows, ["id"], F.col("updated_at").desc_nulls_last(), F.col("row_no"))
    grams = lambda c: F.array_distinct(X.let(X.strong_key(F.col(c)), X.char_bigrams))
    known = materialize(texts.select("id", grams("text").alias("h")), "pool-texts")
    asked = materialize(cases.filter("query is not null").select("row_no", grams("query").alias("g")), "pool-queries")
    common = F.size(F.array_intersect("g", "h"))
    scored = pool.join(known, "id").join(asked, "row_no").select(F.col("row_no").alias("q"), "id", "label", F.round(common / F.greatest(F.size("g"), F.lit(1)), 6).alias("score"))
    ranked = R.ranked(scored, F.col("score").desc(), F.col("id"))
    return ranked.groupBy("q").agg(F.count("*").alias("pool"), F.sum("label").alias("golds"), F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("first_gold"))


def x14_distances(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of the distance to the nearest other vector, by label."""
    near = P.r2_dense_topk(spark, d).filter("q <> doc").groupBy("q").agg(F.min(F.round(1 - F.col("cosine"), 6)).alias("distance"))
    labelled = near.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("q"), "label"), "q")
    out = S.percentiles(labelled, ["label"], "distance", [0.5, 0.9])
    return out.select("label", "n", F.round(F.col("p")[0], 6).alias("p50"), F.round(F.col("p")[1], 6).alias("p90"))


def x16_vector_or_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Where vectors alone and the fusion of all lanes find the first relevant chunk."""
    named = P._named(spark, d)
    vector = named.filter("lane = 'dense' and rank <= 10").select("q", F.col("doc").alias("item"), "rank")
    hybrid = R.ranked(R.rrf(named, F.lit(1.0)), F.col("fused").desc(), F.col("doc"), k=10).select("q", F.col("doc").alias("item"), "rank")
    return M.rerank_gain(vector, hybrid, P._qrels(spark, d))


def x23_levels(spark: SparkSession, d: str) -> DataFrame:
    """The same records at three levels: whole, with masks, without texts."""
    rows = table(spark, d, ANSWERS)
    hidden = F.substring(F.sha2(F.concat(F.lit("salt:"), F.coalesce("tenant_id", F.lit(""))), 256), 1, 12)
    standard = rows.select("row_no", F.lit("standard").alias("level"), "tenant_id", F.sha2(X.mask_pii(F.col("question")), 256).alias("text"))
    anonymous = rows.select("row_no", F.lit("anonymous").alias("level"), hidden.alias("tenant_id"), F.lit(None).cast("string").alias("text"))
    detailed = rows.select("row_no", F.lit("detailed").alias("level"), "tenant_id", F.sha2("question", 256).alias("text"))
    return standard.unionByName(anonymous).unionByName(detailed)


QUERIES = {f.__name__: f for f in (n9_overlap, j14_synonyms, j16_terms_held, r21_prefer, r22_guards, r26_features, r29_plain_queries, w8_due_sources, x6_pools, x14_distances, x16_vector_or_hybrid, x23_levels)}

_EK = lambda c: f"regexp_replace({INDEX(c)}, '{X.WS}', '', 'g')"
_CHARS = lambda c: f"list_distinct(list_filter(string_split({c}, ''), lambda x: x <> ''))"
_ANY = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{w}')" for w in ws) + ")"
_SHARED = ", ".join(f"CASE WHEN {_ANY('question', w)} AND {_ANY('approved_answer', w)} THEN '{k}' END" for k, w in SYNONYMS.items())
_AGAINST = " OR ".join(f"(contains(question, '{a}') AND contains(approved_answer, '{b}')) OR (contains(question, '{b}') AND contains(approved_answer, '{a}'))" for a, b in OPPOSITES)
_END = f"(?:{'|'.join(ENDINGS)})[?？。!！]*$"
_NEG = lambda c: f"regexp_matches({c}, 'ない|ません|不|无| not |never|without')"
_G2 = lambda c: f"list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2)))"


def _plain_sql() -> str:
    steps = "WITH s0 AS (SELECT row_no, trim(query) AS p FROM semantic_challenge_v2_cases WHERE query IS NOT NULL)"
    for i in range(3):
        steps += f", s{i + 1} AS (SELECT row_no, coalesce(nullif(trim(regexp_replace(p, '{_END}', '')), ''), p) AS p FROM s{i})"
    return steps + " SELECT row_no, p AS plain FROM s3"


_TENANT_NEAR = f"near AS (SELECT q, min(round(1 - cosine, 6)) AS distance FROM (SELECT q, doc, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM csims WHERE own) WHERE rank <= 2 AND q <> doc GROUP BY 1)"
SQL = {
    "n9_overlap": f"WITH f AS MATERIALIZED (SELECT row_no, {_EK('question')} AS a, {_EK('approved_answer')} AS b FROM approved_qa_alias_fixture) SELECT row_no, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN round(len(list_intersect({_CHARS('a')}, {_CHARS('b')})) / greatest(len({_CHARS('a')}), 1), 6) END AS overlap, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN len(list_filter(list_distinct(regexp_extract_all(a, '[a-z0-9]+-[a-z0-9]+')), lambda t: contains(b, t))) END AS codes FROM f",
    "j14_synonyms": f"SELECT concat_ws(',', {_SHARED}) AS shared, ({_AGAINST}) AS against, count(*) AS n FROM approved_qa_alias_fixture WHERE question IS NOT NULL AND approved_answer IS NOT NULL GROUP BY 1, 2",
    "j16_terms_held": "WITH t AS (SELECT DISTINCT unnest(required_gold_support_terms) AS term FROM semantic_challenge_v2_cases) SELECT term, count(DISTINCT row_no) AS chunks FROM t JOIN semantic_challenge_v2_chunks ON contains(text, term) WHERE term <> '' GROUP BY 1",
    "r21_prefer": f"{P._L}, {P._TOP(20)}, k AS (SELECT row_no AS doc, chunk_type = 'qa_pair' AS pair FROM manufacturing_chunks) SELECT q, doc, rank FROM (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY floor(bm25) DESC, pair DESC NULLS LAST, chars, doc) AS rank FROM top JOIN k USING (doc)) WHERE rank <= 10",
    "r22_guards": f"WITH {P._CHUNK_SIMS}, {_TENANT_NEAR} SELECT c.row_no AS q, distance, CASE WHEN distance IS NULL THEN 'no_results' WHEN distance > 0.95 THEN 'too_far' WHEN distance > 0.65 THEN 'doubtful' ELSE 'near' END AS guard FROM cv c LEFT JOIN near ON near.q = c.row_no WHERE c.row_no % 20 = 0 AND c.normalized_question IS NOT NULL",
    "r26_features": f"""WITH ka AS MATERIALIZED (SELECT row_no AS q, query AS a, {_STRONG('query')} AS k FROM semantic_challenge_v2_cases WHERE row_no % 20 = 0), kb AS MATERIALIZED (SELECT row_no AS key, question AS b, {_STRONG('question')} AS k FROM approved_qa_alias_fixture), ga AS (SELECT q, a, {_G2('k')} AS g FROM ka), gb AS (SELECT key, b, {_G2('k')} AS h FROM kb),
ea AS (SELECT q, len(g) AS na, unnest(g) AS g FROM ga), eb AS (SELECT key, len(h) AS nb, unnest(h) AS g FROM gb), p AS (SELECT q, key, round(count(*) / (na + nb - count(*)), 6) AS jaccard FROM ea JOIN eb USING (g) GROUP BY q, key, na, nb),
s AS (SELECT q, key, round(jaccard + CASE WHEN len(list_intersect(regexp_extract_all(a, '[0-9]+'), regexp_extract_all(b, '[0-9]+'))) > 0 THEN 0.08 ELSE 0.0 END - CASE WHEN {_NEG('a')} <> {_NEG('b')} THEN 0.04 ELSE 0.0 END, 6)::DOUBLE AS score FROM p JOIN ga USING (q) JOIN gb USING (key) WHERE jaccard >= 0.4)
SELECT q, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, key) AS rank FROM s) WHERE rank <= 5""",
    "r29_plain_queries": _plain_sql(),
    "w8_due_sources": "WITH m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_doc ORDER BY updated_at DESC NULLS LAST, row_no) AS r FROM source_manifest WHERE source_doc IS NOT NULL) WHERE r = 1), l AS (SELECT source_doc, datediff('day', CAST(updated_at AS DATE), DATE '2026-07-01') - CASE source_type WHEN 'pdf' THEN 90 WHEN 'xlsx' THEN 30 ELSE 60 END AS days_late FROM m) SELECT * FROM l WHERE days_late > 0",
    "x6_pools": f"""WITH p0 AS (SELECT row_no, unnest(gold_chunk_ids) AS id, 1 AS label FROM semantic_challenge_v2_cases UNION ALL SELECT row_no, unnest(distractor_chunk_ids), 0 FROM semantic_challenge_v2_cases), p AS (SELECT row_no, id, max(label) AS label FROM p0 WHERE id IS NOT NULL GROUP BY 1, 2),
t0 AS MATERIALIZED (SELECT id, {_STRONG('text')} AS k FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, row_no) AS r FROM semantic_challenge_v2_chunks WHERE id IS NOT NULL) WHERE r = 1), t AS (SELECT id, {_G2('k')} AS h FROM t0), a0 AS MATERIALIZED (SELECT row_no, {_STRONG('query')} AS k FROM semantic_challenge_v2_cases WHERE query IS NOT NULL), a AS (SELECT row_no, {_G2('k')} AS g FROM a0),
s AS (SELECT row_no AS q, id, label, round(len(list_intersect(g, h)) / greatest(len(g), 1), 6) AS score FROM p JOIN t USING (id) JOIN a USING (row_no)), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM s)
SELECT q, count(*) AS pool, CAST(sum(label) AS BIGINT) AS golds, min(CASE WHEN label = 1 THEN rank END) AS first_gold FROM r GROUP BY 1""",
    "x14_distances": f"WITH {P._SIM}, n AS (SELECT q, min(round(1 - cosine, 6)) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM sims) WHERE rank <= 10 AND q <> doc GROUP BY 1) SELECT label, count(*) AS n, round(quantile_cont(distance, 0.5), 6) AS p50, round(quantile_cont(distance, 0.9), 6) AS p90 FROM n JOIN embeddings ON vec_id = q GROUP BY 1",
    "x16_vector_or_hybrid": f"{P._N}, {P._QRELS}, fused AS (SELECT q, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused FROM named GROUP BY 1, 2), hy AS (SELECT q, doc AS item, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fused DESC, doc) AS rank FROM fused) WHERE rank <= 10), ve AS (SELECT q, doc AS item, rank FROM named WHERE lane = 'dense' AND rank <= 10), qq AS (SELECT DISTINCT q, item FROM qrels), a AS (SELECT q, min(rank) AS before FROM qq JOIN ve USING (q, item) GROUP BY 1), b AS (SELECT q, min(rank) AS after FROM qq JOIN hy USING (q, item) GROUP BY 1) SELECT q, before, after, before - after AS gain, before IS NOT NULL AND after IS NULL AS dropped FROM (SELECT DISTINCT q FROM qq) LEFT JOIN a USING (q) LEFT JOIN b USING (q)",
    "x23_levels": f"SELECT row_no, 'standard' AS level, tenant_id, sha256(regexp_replace(regexp_replace(question, '{X.EMAIL}', '[email]', 'g'), '[0-9]', '#', 'g')) AS text FROM approved_qa_alias_fixture UNION ALL SELECT row_no, 'anonymous', substr(sha256('salt:' || coalesce(tenant_id, '')), 1, 12), NULL FROM approved_qa_alias_fixture UNION ALL SELECT row_no, 'detailed', tenant_id, sha256(question) FROM approved_qa_alias_fixture",
}
