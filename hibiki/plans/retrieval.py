"""Retrieval and metric queries: the questions of rows whose row_no is divisible by 20 against all chunks of the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import metrics as M
from ..operators import retrieval as R
from ..sources.tables import materialize, spread, table
from .text import INDEX, TOKENS

CHUNKS, CASES = "manufacturing_chunks", "semantic_challenge_v2_cases"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, CHUNKS).select("row_no", "text")).select(F.col("row_no").alias("doc"), X.heuristic_tokens(F.col("text")).alias("tokens"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, CHUNKS).filter("row_no % 20 = 0 and normalized_question is not null").select(F.col("row_no").alias("q"), F.col("normalized_question").alias("query"), "qa_id", "language")


def _queries(spark: SparkSession, d: str, text=lambda c: c) -> DataFrame:
    return _asked(spark, d).select("q", X.heuristic_tokens(text(F.col("query"))).alias("tokens"))


def _lanes(spark: SparkSession, d: str) -> DataFrame:
    return R.lanes(_docs(spark, d), _queries(spark, d))


def _chunk_vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(doc, v, tenant) of the chunks and (q, v, tenant) of the questions: the vector of a row is that of its number."""
    rows = table(spark, d, CHUNKS).select("row_no", "normalized_question", F.coalesce(F.nullif(F.trim("tenant_id"), F.lit("")), F.lit("default")).alias("tenant"))
    both = rows.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("row_no"), F.col("embedding").alias("v")), "row_no")
    asked = both.filter("row_no % 20 = 0 and normalized_question is not null")
    return both.select(F.col("row_no").alias("doc"), "v", "tenant"), asked.select(F.col("row_no").alias("q"), "v", "tenant")


def _named(spark: SparkSession, d: str) -> DataFrame:
    s = materialize(_lanes(spark, d), "lanes")
    vectors, asked = _chunk_vectors(spark, d)
    dense = R.vector_lane(vectors.drop("tenant"), asked.drop("tenant"))
    return materialize(R.union_lanes({"dense": dense, "keyword": R.keyword_lane(s), "exact": R.exact_lane(s)}), "named")


def r1_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(_lanes(spark, d), F.col("bm25").desc(), F.col("doc"), k=10).select("q", "doc", "bm25", "rank")


def r3_keyword_rank(spark: SparkSession, d: str) -> DataFrame:
    return R.keyword_lane(_lanes(spark, d))


def r5_exact_lane(spark: SparkSession, d: str) -> DataFrame:
    return R.exact_lane(_lanes(spark, d)).select("q", "doc", "score", "rank")


def r6_rrf(spark: SparkSession, d: str) -> DataFrame:
    weight = F.when(F.col("lane") == "exact", 1.5).otherwise(1.0)
    return R.ranked(R.rrf(_named(spark, d), weight), F.col("fused").desc(), F.col("doc"), k=10)


def r7_dbsf(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(R.dbsf(_named(spark, d)), F.col("fused").desc(), F.col("doc"), k=10)


def r8_hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    lanes = _named(spark, d)
    return R.hybrid_topk(lanes, R.rrf(lanes, F.lit(1.0)), 5)


def r9_routed_weights(spark: SparkSession, d: str) -> DataFrame:
    kinds = _asked(spark, d).select("q", R.query_type(F.col("query")).alias("kind"))
    lanes = _named(spark, d).join(kinds, "q")
    return R.ranked(R.rrf(lanes, R.routed_weight(F.col("kind"), F.col("lane"))), F.col("fused").desc(), F.col("doc"), k=10)


def r10_query_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, CASES).groupBy(R.query_type(F.col("query")).alias("kind")).agg(F.count("*").alias("n"))


def r17_multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Two variants of each query, whole and without its codes, fused by rank; the variant costs a penalty."""
    docs = _docs(spark, d)
    whole = R.ranked(R.lanes(docs, _queries(spark, d)), F.col("bm25").desc(), F.col("doc"), k=20).select("q", "doc", "rank", F.lit(1.0).alias("weight"))
    plain = R.lanes(docs, _queries(spark, d, lambda c: F.regexp_replace(c, "[A-Za-z0-9]+-[A-Za-z0-9]+", " ")))
    plain = R.ranked(plain, F.col("bm25").desc(), F.col("doc"), k=20).select("q", "doc", "rank", F.lit(0.95).alias("weight"))
    return R.ranked(R.rrf(whole.unionByName(plain), F.col("weight")), F.col("fused").desc(), F.col("doc"), k=10)


def r18_union_first(spark: SparkSession, d: str) -> DataFrame:
    lanes = _named(spark, d).withColumn("pass", F.when(F.col("lane") == "exact", 0).when(F.col("lane") == "keyword", 1).otherwise(2))
    return R.first_by_key(lanes, ["q", "doc"], F.col("pass"), F.col("rank")).select("q", "doc", "lane", "rank")


def _top(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    top = R.ranked(_lanes(spark, d), F.col("bm25").desc(), F.col("doc"), k=k)
    info = table(spark, d, CHUNKS).select(F.col("row_no").alias("doc"), "id", "source_doc", "doc_id", "chunk_index", F.length("text").alias("chars"))
    return top.join(info, "doc")


def r19_page_diversity(spark: SparkSession, d: str) -> DataFrame:
    return R.diverse(_top(spark, d), "source_doc", 2).select("q", "doc", "source_doc", "rank")


def r20_context_cut(spark: SparkSession, d: str) -> DataFrame:
    return R.context_cut(_top(spark, d), "chars", 1000).select("q", "doc", "rank", "chars_before")


def r23_best_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The three sentences of each best document that hold most of the query's terms."""
    best = R.ranked(_lanes(spark, d), F.col("bm25").desc(), F.col("doc"), k=1).select("q", "doc")
    text = table(spark, d, CHUNKS).select(F.col("row_no").alias("doc"), F.posexplode(F.split("text", "[。.!?！？\n]+")).alias("pos", "s")).filter("length(s) > 0")
    both = best.join(text, "doc").join(_queries(spark, d).select("q", F.col("tokens").alias("qt")), "q").withColumn("form", X.index_form(F.col("s")))
    score = F.size(F.filter("qt", lambda t: F.contains(F.col("form"), t))).cast("long")
    both = both.select("q", "doc", F.col("pos").cast("long").alias("pos"), (10 * score - F.when(F.length("s") > 120, 2).otherwise(0)).alias("score"))
    return R.ranked(both.filter("score > 0"), F.col("score").desc(), F.col("pos"), k=3)


def r28_suggest(spark: SparkSession, d: str) -> DataFrame:
    """Suggestions for whole typed texts, the first halves of queries: prefix before inside, question before alias, shorter first.

    A text that holds the typed one holds its first characters, up to eight: windows of that length are joined on, the
    rest is compared directly.  Empty typed texts suggest nothing.
    """
    asked = table(spark, d, CASES).filter("row_no % 20 = 0").select(F.col("row_no").alias("q"), X.index_form(F.col("query")).alias("f"))
    asked = asked.select("q", F.substring("f", F.lit(1), F.ceil(F.length("f") / 2).cast("int")).alias("p")).filter("p <> ''")
    asked = materialize(asked.withColumn("head", F.substring("p", 1, 8)), "typed")
    qa = table(spark, d, "approved_qa_alias_fixture")
    texts = qa.select("row_no", X.index_form(F.col("question")).alias("t"), F.lit(0).alias("alias")).unionByName(qa.select("row_no", F.explode("approved_aliases").alias("t"), F.lit(1).alias("alias")).withColumn("t", X.index_form(F.col("t"))))
    texts = materialize(texts.filter("t <> ''"), "suggested")
    window = lambda n: F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substring(F.col("t"), i, F.lit(n)))))
    hits = None
    for n in [r["n"] for r in asked.select(F.length("head").alias("n")).distinct().collect()]:  # at most eight lengths
        some = asked.filter(F.length("head") == n)
        part = texts.filter(F.length("t") >= n).withColumn("w", window(n)).join(some, F.col("w") == F.col("head")).filter(F.contains("t", F.col("p")))
        part = part.select("q", "row_no", "alias", F.when(F.startswith("t", F.col("p")), 0).otherwise(1).alias("inside"), F.length("t").alias("n"))
        hits = part if hits is None else hits.unionByName(part)
    if hits is None:
        return spark.createDataFrame([], "q long, row_no long, rank long")
    one = R.first_by_key(hits, ["q", "row_no"], F.col("inside"), F.col("alias"), F.col("n"))
    return R.ranked(one, F.col("inside"), F.col("alias"), F.col("n"), F.col("row_no"), k=5).select("q", "row_no", "rank")


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("v")), e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("v"))


def r2_dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.dense_topk(*_vectors(spark, d), 10)


def r31_int8_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.int8_topk(*_vectors(spark, d), 10)


def r31_binary_topk(spark: SparkSession, d: str) -> DataFrame:
    return R.binary_topk(*_vectors(spark, d), 10)


def r31_truncated_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest by the first half of the dimensions."""
    vectors, asked = _vectors(spark, d)
    return R.dense_topk(vectors.withColumn("v", F.slice("v", 1, 32)), asked.withColumn("v", F.slice("v", 1, 32)), 10)


def r2_tenant_topk(spark: SparkSession, d: str) -> DataFrame:
    """The nearest chunks of the question's own tenant."""
    return R.dense_topk(*_chunk_vectors(spark, d), 10)


def m7_int8_recall(spark: SparkSession, d: str) -> DataFrame:
    exact, rough = r2_dense_topk(spark, d).select("q", "doc"), r31_int8_topk(spark, d).select("q", "doc", F.lit(1).alias("hit"))
    return exact.join(rough, ["q", "doc"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def m7_binary_recall(spark: SparkSession, d: str) -> DataFrame:
    exact, rough = r2_dense_topk(spark, d).select("q", "doc"), r31_binary_topk(spark, d).select("q", "doc", F.lit(1).alias("hit"))
    return exact.join(rough, ["q", "doc"], "left").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("recall"))


def _one_per_id(spark: SparkSession, d: str) -> DataFrame:
    """The chunks without re-deliveries: of each id the newest version, then the longest text, then the least row (C16)."""
    rows = table(spark, d, "manufacturing_chunks")
    return R.first_by_key(rows, ["id"], F.col("updated_at").desc_nulls_last(), F.length("text").desc_nulls_last(), F.col("row_no"))


def c16_newest_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _one_per_id(spark, d).select("id", "row_no")


def j3_parent_expand(spark: SparkSession, d: str) -> DataFrame:
    chunks = _one_per_id(spark, d).select(F.col("id").alias("chunk"), F.col("parent_chunk_id").alias("parent"), "row_no", "chunk_index")
    hits = chunks.select(F.pmod("row_no", F.lit(50)).alias("q"), "chunk", F.round(F.col("chunk_index") * 0.01, 6).alias("score"))
    return R.expand_parents(hits, chunks)


def j4_neighbours(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, CHUNKS).select(F.col("doc_id").alias("doc"), "chunk_index")
    hits = _top(spark, d, 5).select("q", F.col("doc_id").alias("doc"), "chunk_index", F.round(F.col("rank") * 0.1, 6).alias("score"))
    return R.expand_neighbours(hits, chunks)


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    """Relevant to a question: the rows of its qa_id, its own row most."""
    rows = table(spark, d, CHUNKS).filter("qa_id is not null").select("qa_id", F.col("row_no").alias("item"))
    both = _asked(spark, d).join(rows, "qa_id")
    return both.select("q", "item", F.when(F.col("q") == F.col("item"), 2).otherwise(1).alias("grade"))


def _runs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = materialize(_lanes(spark, d), "lanes")
    return tuple(R.ranked(s, F.col(c).desc(), F.col("doc"), k=10).select("q", F.col("doc").alias("item"), "rank") for c in ("bm25", "cosine"))


def m1_credit(spark: SparkSession, d: str) -> DataFrame:
    return M.credit(_runs(spark, d)[0], _qrels(spark, d))


def m2_metrics(spark: SparkSession, d: str) -> DataFrame:
    return M.at_k(_runs(spark, d)[0], _qrels(spark, d))


def m3_slices(spark: SparkSession, d: str) -> DataFrame:
    kinds = _asked(spark, d).select("q", F.explode(F.array(F.lit("all"), F.coalesce("language", F.lit("none")))).alias("slice"))
    return M.summary(m2_metrics(spark, d).join(kinds, "q"), "slice")


def m5_mode_summary(spark: SparkSession, d: str) -> DataFrame:
    a, b = _runs(spark, d)
    q = _qrels(spark, d)
    return M.summary(M.at_k(a, q).withColumn("mode", F.lit("bm25")).unionByName(M.at_k(b, q).withColumn("mode", F.lit("cosine"))), "mode")


def m6_candidate_miss(spark: SparkSession, d: str) -> DataFrame:
    return m2_metrics(spark, d).agg(F.round(1 - F.avg("hit"), 6).alias("miss_rate"))


def j12_paired_changes(spark: SparkSession, d: str) -> DataFrame:
    a, b = _runs(spark, d)
    q = _qrels(spark, d)
    return M.paired_changes(M.at_k(a, q), M.at_k(b, q), "mrr")


QUERIES = {f.__name__: f for f in (r1_bm25_topk, r2_dense_topk, r3_keyword_rank, r5_exact_lane, r6_rrf, r7_dbsf, r8_hybrid_topk, r9_routed_weights, r10_query_types, r17_multi_query, r18_union_first, r19_page_diversity, r20_context_cut, r23_best_sentences, r28_suggest, r2_tenant_topk, r31_binary_topk, r31_truncated_topk, r31_int8_topk, m7_int8_recall, m7_binary_recall, c16_newest_by_id, j3_parent_expand, j4_neighbours, m1_credit, m2_metrics, m3_slices, m5_mode_summary, m6_candidate_miss, j12_paired_changes)}

# ------------------------------------------------------------------------------------------------------------- SQL


def _lanes_sql(query: str = "normalized_question", name: str = "lanes") -> str:
    return f"""ds_{name} AS MATERIALIZED (SELECT row_no AS doc, {INDEX('text')} AS s FROM manufacturing_chunks), docs_{name} AS (SELECT doc, {TOKENS} AS t FROM ds_{name}),
as_{name} AS MATERIALIZED (SELECT row_no AS q, {INDEX(query)} AS s FROM manufacturing_chunks WHERE row_no % 20 = 0 AND normalized_question IS NOT NULL), qs_{name} AS (SELECT q, {TOKENS} AS t FROM as_{name}),
post_{name} AS (SELECT doc, len(t) AS n, unnest(t) AS term FROM docs_{name}), df_{name} AS (SELECT term, count(*) AS df FROM post_{name} GROUP BY 1),
{name} AS (SELECT q, doc, round(sum(ln(1 + ((SELECT count(*) FROM docs_{name}) - df + 0.5) / (df + 0.5)) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * p.n / (SELECT avg(len(t)) FROM docs_{name})))), 6) AS bm25,
  round(count(*) / sqrt(CAST(p.n AS DOUBLE) * a.qn), 6) AS cosine, CAST(sum(CASE WHEN regexp_matches(p.term, '{R.EXACT}') AND length(p.term) >= 4 THEN 1 ELSE 0 END) AS BIGINT) AS exact
  FROM post_{name} p JOIN df_{name} USING (term) JOIN (SELECT q, len(t) AS qn, unnest(t) AS term FROM qs_{name}) a USING (term) GROUP BY q, doc, p.n, a.qn)"""


_L = "WITH " + _lanes_sql()
_KEYWORD = "SELECT q, doc, bm25 AS score, rank, round(least(0.25 + 0.02 * (rank - 1), 0.95), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY exact > 0 DESC, exact DESC, bm25 DESC, doc) AS rank FROM lanes) WHERE rank <= 20"
_EXACT = "SELECT q, doc, CAST(exact AS DOUBLE) AS score, rank, 0.25 AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY exact DESC, bm25 DESC, doc) AS rank FROM lanes WHERE exact > 0) WHERE rank <= 20"
_COSINE = lambda a, b: f"round(list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[])) * list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 6)"
_TENANT = "coalesce(nullif(trim(tenant_id), ''), 'default')"
_CHUNK_SIMS = f"cv AS (SELECT row_no, normalized_question, {_TENANT} AS tenant, embedding AS v FROM manufacturing_chunks JOIN embeddings ON vec_id = row_no), csims AS (SELECT a.row_no AS q, b.row_no AS doc, a.tenant = b.tenant AS own, {_COSINE('a.v', 'b.v')} AS cosine FROM cv a, cv b WHERE a.row_no % 20 = 0 AND a.normalized_question IS NOT NULL)"
_DENSE = "SELECT q, doc, cosine AS score, rank, round(1 - cosine, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM csims) WHERE rank <= 20"
_N = f"{_L}, {_CHUNK_SIMS}, named AS (SELECT *, 'dense' AS lane FROM ({_DENSE}) UNION ALL SELECT *, 'keyword' FROM ({_KEYWORD}) UNION ALL SELECT *, 'exact' FROM ({_EXACT}))"
_TOPK = "SELECT q, doc, fused, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fused DESC, doc) AS rank FROM fused) WHERE rank <= 10"
_KIND = r"""CASE WHEN trim(query) = '' THEN 'other' WHEN regexp_matches(query, '[「『"“][^」』"”]+[」』"”]') THEN 'exact_lookup' WHEN regexp_matches(query, '[A-Za-z]+-?[0-9]{2,}|[0-9]+[A-Z][0-9]*-[A-Z0-9]+') THEN 'identifier'
WHEN regexp_matches(query, 'とは[？?。]?$|^what is ') THEN 'exact_lookup' WHEN regexp_matches(query, '手順|方法|やり方|手続き|how (do|should|to)') THEN 'procedure' WHEN regexp_matches(query, '[？?]$') THEN 'faq' WHEN length(query) <= 8 THEN 'ambiguous' WHEN length(query) >= 18 THEN 'broad' ELSE 'other' END"""
_WEIGHT = "CASE " + " ".join(f"WHEN kind = '{k}' THEN CASE lane WHEN 'dense' THEN {a} WHEN 'keyword' THEN {b} ELSE {c} END" for k, (a, b, c) in R.ROUTES.items()) + " ELSE 1.0 END"
_TOP = lambda k: f"top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc) AS rank FROM lanes) JOIN (SELECT row_no AS doc, id, source_doc, doc_id, chunk_index, length(text) AS chars FROM manufacturing_chunks) USING (doc) WHERE rank <= {k})"
_COS = "sum(CAST(x AS DOUBLE) * CAST(y AS DOUBLE))"
_SIM = "sims AS (SELECT a.vec_id AS q, b.vec_id AS doc, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"
_QRELS = "qrels AS (SELECT a.row_no AS q, b.row_no AS item, CASE WHEN a.row_no = b.row_no THEN 2 ELSE 1 END AS grade FROM manufacturing_chunks a JOIN manufacturing_chunks b USING (qa_id) WHERE a.row_no % 20 = 0 AND a.normalized_question IS NOT NULL)"


def _run_sql(col: str, name: str) -> str:
    return f"{name} AS (SELECT q, rank, doc AS item FROM (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY {col} DESC, doc) AS rank FROM lanes) WHERE rank <= 10)"


def _metric_sql(run: str, name: str) -> str:
    return f"""{name} AS (SELECT q, n_relevant, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(coalesce(n / n_relevant, 0), 6) AS recall, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg
FROM (SELECT q, count(*) AS n_relevant, sum(CASE WHEN place <= 10 THEN (pow(2, grade) - 1) / log2(place + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY grade DESC, item) AS place FROM qrels) GROUP BY 1)
LEFT JOIN (SELECT q, count(*) AS n, min(rank) AS first, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM (SELECT q, item, grade, min(rank) AS rank FROM qrels JOIN {run} USING (q, item) GROUP BY 1, 2, 3) GROUP BY 1) USING (q))"""


_ME = f"{_L}, {_QRELS}, {_run_sql('bm25', 'run_a')}, {_run_sql('cosine', 'run_b')}, {_metric_sql('run_a', 'met_a')}, {_metric_sql('run_b', 'met_b')}"
_MEANS = "count(*) AS queries, round(avg(hit), 6) AS hit, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg"
_NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, length(text) DESC NULLS LAST, row_no) AS r FROM manufacturing_chunks) WHERE r = 1)"
SQL = {
    "r1_bm25_topk": f"{_L} SELECT q, doc, bm25, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc) AS rank FROM lanes) WHERE rank <= 10",
    "r2_dense_topk": f"WITH {_SIM} SELECT q, doc, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM sims) WHERE rank <= 10",
    "r2_tenant_topk": f"WITH {_CHUNK_SIMS} SELECT q, doc, cosine, rank FROM (SELECT q, doc, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM csims WHERE own) WHERE rank <= 10",
    "r31_truncated_topk": f"WITH s AS (SELECT a.vec_id AS q, b.vec_id AS doc, {_COSINE('a.embedding[1:32]', 'b.embedding[1:32]')} AS cosine FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0) SELECT q, doc, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM s) WHERE rank <= 10",
    "r31_binary_topk": f"WITH s AS (SELECT a.vec_id AS q, b.vec_id AS doc, {_COSINE('a.embedding', 'b.embedding')} AS cosine, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: CASE WHEN b.embedding[i] > 0 THEN CAST(a.embedding[i] AS DOUBLE) ELSE -CAST(a.embedding[i] AS DOUBLE) END)) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))), 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc) AS r FROM s) SELECT q, doc, cosine, rank FROM (SELECT q, doc, cosine, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, doc) AS rank FROM r WHERE r <= 160) WHERE rank <= 10",
    "r3_keyword_rank": f"{_L} {_KEYWORD}",
    "r5_exact_lane": f"{_L} SELECT q, doc, score, rank FROM ({_EXACT})",
    "r6_rrf": f"{_N}, fused AS (SELECT q, doc, round(sum(CASE WHEN lane = 'exact' THEN 1.5 ELSE 1.0 END::DOUBLE / (60 + rank)), 9) AS fused FROM named GROUP BY 1, 2) {_TOPK}",
    "r7_dbsf": f"{_N}, put AS (SELECT q, doc, CASE WHEN s > 1e-12 THEN (score - (m - 3 * s)) / (6 * s) ELSE 0.5 END AS x FROM (SELECT *, avg(score) OVER w AS m, stddev_pop(score) OVER w AS s FROM named WHERE lane <> 'exact' WINDOW w AS (PARTITION BY q, lane)) UNION ALL SELECT q, doc, 1.0 FROM named WHERE lane = 'exact'), fused AS (SELECT q, doc, round(sum(x), 6) AS fused FROM put GROUP BY 1, 2) {_TOPK}",
    "r8_hybrid_topk": f"""{_N}, fused AS (SELECT q, doc, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS fused, max(CASE WHEN lane = 'keyword' THEN 1 ELSE 0 END) AS kw, max(CASE WHEN lane = 'dense' THEN 1 ELSE 0 END) AS dn, min(distance)::DOUBLE AS score FROM named GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY fused DESC, kw DESC, doc) AS rank FROM fused), m AS (SELECT *, max(CASE WHEN rank <= 5 THEN dn END) OVER (PARTITION BY q) AS dense_in, min(CASE WHEN dn = 1 THEN rank END) OVER (PARTITION BY q) AS best, least(5, max(rank) OVER (PARTITION BY q)) AS last FROM r)
SELECT q, doc, fused, CASE WHEN dense_in = 0 AND best IS NOT NULL AND rank = best THEN last ELSE rank END AS rank, score FROM m WHERE CASE WHEN dense_in = 0 AND best IS NOT NULL THEN rank < last OR rank = best ELSE rank <= 5 END""",
    "r9_routed_weights": f"{_N}, k AS (SELECT row_no AS q, {_KIND.replace('query', 'normalized_question')} AS kind FROM manufacturing_chunks WHERE row_no % 20 = 0 AND normalized_question IS NOT NULL), fused AS (SELECT q, doc, round(sum(CAST({_WEIGHT} AS DOUBLE) / (60 + rank)), 9) AS fused FROM named JOIN k USING (q) GROUP BY 1, 2) {_TOPK}",
    "r10_query_types": f"SELECT {_KIND} AS kind, count(*) AS n FROM semantic_challenge_v2_cases GROUP BY 1",
    "r17_multi_query": "WITH " + _lanes_sql(name="la") + ", " + _lanes_sql("regexp_replace(normalized_question, '[A-Za-z0-9]+-[A-Za-z0-9]+', ' ', 'g')", "lb") + f", u AS (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc) AS rank, 1.0 AS weight FROM la UNION ALL SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc), 0.95 FROM lb), fused AS (SELECT q, doc, round(sum(weight::DOUBLE / (60 + rank)), 9) AS fused FROM u WHERE rank <= 20 GROUP BY 1, 2) {_TOPK}",
    "r18_union_first": f"{_N} SELECT q, doc, lane, rank FROM (SELECT *, row_number() OVER (PARTITION BY q, doc ORDER BY CASE lane WHEN 'exact' THEN 0 WHEN 'keyword' THEN 1 ELSE 2 END, rank) AS r FROM named) WHERE r = 1",
    "r19_page_diversity": f"{_L}, {_TOP(20)} SELECT q, doc, source_doc, rank FROM (SELECT *, row_number() OVER (PARTITION BY q, source_doc ORDER BY rank) AS n FROM top) WHERE n <= 2 OR source_doc IS NULL",
    "r20_context_cut": f"{_L}, {_TOP(20)} SELECT q, doc, rank, chars_before FROM (SELECT *, CAST(coalesce(sum(chars) OVER (PARTITION BY q ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS chars_before FROM top) WHERE chars_before < 1000",
    "r23_best_sentences": f"""{_L}, {_TOP(1)}, s AS (SELECT row_no AS doc, string_split_regex(text, '[。.!?！？\\n]+') AS l FROM manufacturing_chunks), e AS (SELECT doc, unnest(l) AS s, unnest(range(0, len(l))) AS pos FROM s),
f AS (SELECT q, doc, pos, 10 * len(list_filter(t, lambda x: contains({INDEX('s')}, x))) - CASE WHEN length(s) > 120 THEN 2 ELSE 0 END AS score FROM top JOIN e USING (doc) JOIN qs_lanes USING (q) WHERE length(s) > 0)
SELECT q, doc, pos, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, pos) AS rank FROM f WHERE score > 0) WHERE rank <= 3""",
    "r28_suggest": f"""WITH f AS (SELECT row_no AS q, {INDEX('query')} AS f FROM semantic_challenge_v2_cases WHERE row_no % 20 = 0), a AS (SELECT q, substr(f, 1, CAST(ceil(length(f) / 2.0) AS BIGINT)) AS p FROM f), t AS (SELECT row_no, {INDEX('question')} AS t, 0 AS alias FROM approved_qa_alias_fixture UNION ALL SELECT row_no, {INDEX('x')}, 1 FROM (SELECT row_no, unnest(approved_aliases) AS x FROM approved_qa_alias_fixture)),
h AS (SELECT q, row_no, alias, CASE WHEN starts_with(t, p) THEN 0 ELSE 1 END AS inside, length(t) AS n FROM a JOIN t ON contains(t, p) WHERE p <> '' AND t <> ''), o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, row_no ORDER BY inside, alias, n) AS r FROM h) WHERE r = 1)
SELECT q, row_no, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY inside, alias, n, row_no) AS rank FROM o) WHERE rank <= 5""",
    "c16_newest_by_id": f"WITH {_NEWEST} SELECT id, row_no FROM newest",
    "j3_parent_expand": f"WITH {_NEWEST}, h AS (SELECT row_no % 50 AS q, id AS chunk, parent_chunk_id AS parent, round(chunk_index * 0.01, 6)::DOUBLE AS score FROM newest) SELECT q, coalesce(p.id, chunk) AS chunk, min(score) AS score FROM h LEFT JOIN newest p ON h.parent = p.id GROUP BY 1, 2",
    "j4_neighbours": f"{_L}, {_TOP(5)}, a AS (SELECT q, doc_id AS doc, chunk_index + o AS chunk_index, CASE WHEN o = 0 THEN round(rank * 0.1, 6) ELSE round(rank * 0.1, 6) + 0.01 END::DOUBLE AS score FROM (SELECT *, unnest([-1, 0, 1]) AS o FROM top)) SELECT q, doc, chunk_index, round(min(score), 6) AS score FROM a JOIN (SELECT DISTINCT doc_id AS doc, chunk_index FROM manufacturing_chunks) USING (doc, chunk_index) GROUP BY 1, 2, 3",
    "m1_credit": f"{_L}, {_QRELS}, {_run_sql('bm25', 'run_a')} SELECT q, item, grade, min(rank) AS rank FROM qrels JOIN run_a USING (q, item) GROUP BY 1, 2, 3",
    "m2_metrics": f"{_ME} SELECT * FROM met_a",
    "m3_slices": f"{_ME} SELECT slice, {_MEANS} FROM met_a JOIN (SELECT row_no AS q, unnest(['all', coalesce(language, 'none')]) AS slice FROM manufacturing_chunks) USING (q) GROUP BY 1",
    "m5_mode_summary": f"{_ME} SELECT mode, {_MEANS} FROM (SELECT *, 'bm25' AS mode FROM met_a UNION ALL SELECT *, 'cosine' FROM met_b) GROUP BY 1",
    "m6_candidate_miss": f"{_ME} SELECT round(1 - avg(hit), 6) AS miss_rate FROM met_a",
    "j12_paired_changes": f"{_ME} SELECT CASE WHEN a.q IS NULL THEN 'only_b' WHEN b.q IS NULL THEN 'only_a' WHEN b.mrr > a.mrr THEN 'improved' WHEN b.mrr < a.mrr THEN 'worsened' ELSE 'unchanged' END AS state, count(*) AS n FROM met_a a FULL JOIN met_b b ON a.q = b.q GROUP BY 1",
}
SQL["m7_binary_recall"] = f"SELECT round(avg(CASE WHEN b.q IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM ({SQL['r2_dense_topk']}) a LEFT JOIN ({SQL['r31_binary_topk']}) b ON a.q = b.q AND a.doc = b.doc"
