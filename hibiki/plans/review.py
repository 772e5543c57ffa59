"""Reviews, dashboards, rank lifts, golden checks and robustness over the event, case and chunk tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import logs as L
from ..operators import metrics as M
from ..operators import retrieval as R
from ..operators import review as V
from ..sources.tables import materialize, table
from . import retrieval as P
from .operations import _calls
from .quality import _PICK, T15_FORM, t15_perturbed
from .text import INDEX, TOKENS

KANA_TERM, KANJI_TERM = rf"[{X.KATAKANA}]{{3,}}", rf"[{X.KANJI}]{{2,}}"


def _events(spark: SparkSession, d: str) -> DataFrame:
    """Events as exchanges: a request per event, a trace per user and day, k from the properties."""
    e = table(spark, d, "events")
    trace = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("-"), F.to_date("ts").cast("string"))
    return e.select("event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("long").alias("k"), F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("request"), trace.alias("trace"))


def _chats(spark: SparkSession, d: str) -> DataFrame:
    mode = F.when(F.col("k") % 5 == 0, "no_answer").when(F.col("k") % 5 == 1, "candidates_only").otherwise("answered")
    return _events(spark, d).filter("event_type in ('view', 'click')").select("request", "trace", mode.alias("mode"), "event_type", "k", F.col("ts").alias("at"), F.col("event_id").alias("tie"))


def _feedback(spark: SparkSession, d: str) -> DataFrame:
    """Errors are bad feedback, purchases good, signups ask for a person; every other one names the request before it."""
    kind = F.when(F.col("event_type") == "error", "bad").when(F.col("event_type") == "purchase", "good").otherwise("human_review")
    token = F.when(F.col("k") % 2 == 0, F.concat(F.lit("e"), (F.col("event_id") - 1).cast("string"))).otherwise(F.col("trace"))
    return _events(spark, d).filter("event_type in ('error', 'purchase', 'signup')").select(token.alias("token"), kind.alias("kind"), F.when(F.col("k") % 3 == 0, F.col("k").cast("string")).alias("selected"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))


def _joined(spark: SparkSession, d: str) -> DataFrame:
    records = _chats(spark, d).select(F.col("request").alias("id"), "request", "trace", "mode", "event_type")
    reviews = _events(spark, d).filter("event_type = 'signup'").select(F.concat(F.lit("e"), (F.col("event_id") - 2).cast("string")).alias("id"), F.when(F.col("k") % 2 == 0, "correct").otherwise("wrong").alias("verdict"), F.col("ts").alias("at"), F.col("event_id").alias("tie"))
    return V.joined_records(records, _feedback(spark, d), reviews)


def j5_review_queue(spark: SparkSession, d: str) -> DataFrame:
    chats = _chats(spark, d).select(F.col("trace").alias("token"), "request", "mode", "at", "tie")
    said = _feedback(spark, d)
    return V.review_queue(chats, said)


def j6_joined_records(spark: SparkSession, d: str) -> DataFrame:
    return _joined(spark, d).select("id", "mode", "feedback", "verdict")


def a5_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return V.dashboard(_joined(spark, d), "mode", F.col("mode") == "no_answer", F.col("event_type") == "click")


def ss7_quota_ledger(spark: SparkSession, d: str) -> DataFrame:
    """Per day: tokens reserved and settled, each reservation once by its last word, and what is still open."""
    e = _events(spark, d).filter("event_type in ('view', 'click', 'purchase')")
    last = V._newest(e.select(F.concat("trace", F.lit("/"), (F.col("k") % 7).cast("string")).alias("reservation"), F.to_date("ts").cast("string").alias("day"), "event_type", "k", "ts", "event_id"), "reservation", "ts", "event_id")
    done = F.col("event_type") == "purchase"
    return last.groupBy("day").agg(F.count("*").alias("reservations"), F.sum(F.when(done, F.col("k")).otherwise(0)).alias("settled"), F.sum(F.when(~done, F.col("k")).otherwise(0)).alias("reserved"))


def j17_business_share(spark: SparkSession, d: str) -> DataFrame:
    """Per tenant: seconds up and down that fall into business hours nine hours east of UTC; a probe holds for 300 seconds at most."""
    calls = _calls(spark, d).withColumn("ts", F.col("ts") + F.expr("INTERVAL 9 HOURS"))
    held = L.held_intervals(calls, "tenant", "ts", F.col("event_type") != "error", "event_id")
    worked = L.business_micros(F.col("start"), F.col("end"))
    per = held.select("tenant", "ok", worked.alias("us")).groupBy("tenant").agg(*[F.round(F.sum(F.when(c, F.col("us")).otherwise(0)) / 1e6, 3).alias(n) for c, n in ((F.col("ok"), "up"), (~F.col("ok"), "down"))])
    return per.withColumn("share", F.round(F.col("up") / (F.col("up") + F.col("down")), 6))


def r14_heuristic_rerank(spark: SparkSession, d: str) -> DataFrame:
    """The ten best of each question, lifted by hits of quoted terms, codes, katakana and kanji in text, title, section and question."""
    top = R.ranked(P._lanes(spark, d), F.col("bm25").desc(), F.col("doc"), k=10).select("q", "doc", "rank")
    form = lambda c, n: X.index_form(c).alias(n)
    rows = table(spark, d, P.CHUNKS).select(F.col("row_no").alias("doc"), form(F.col("text"), "text"), form(F.col("title"), "title_f"), form(F.array_join("section_path", " "), "section_f"), form(F.col("question_text"), "question_f"), (F.col("chunk_type") == "qa_pair").alias("faq"))
    asked = P._asked(spark, d).select("q", X.index_form(F.col("query")).alias("f"), R.query_type(F.col("query")).alias("kind"))
    found = lambda p: F.array_distinct(F.regexp_extract_all("f", F.lit(p), F.lit(0)))
    codes = F.array_distinct(F.filter(F.transform(F.regexp_extract_all("f", F.lit(X.CODE), F.lit(0)), lambda t: F.regexp_replace(t, X.CODE_TAIL, "")), lambda t: F.length(t) >= 2))
    terms = asked.select("q", "kind", F.array_distinct(X.quoted_terms(F.col("f"))).alias("quoted_t"), codes.alias("alnum_t"), found(KANA_TERM).alias("kata_t"), found(KANJI_TERM).alias("kanji_t"))
    terms = materialize(terms.withColumn("id_t", F.filter("alnum_t", lambda t: t.rlike("[0-9]"))), "terms")
    both = top.join(materialize(rows, "fields"), "doc").join(terms, "q")
    count = lambda t, field: F.size(F.filter(t, lambda x: F.coalesce(F.contains(F.col(field), x), F.lit(False)))).cast("long")
    every = F.array_distinct(F.concat("quoted_t", "kata_t", "kanji_t", "alnum_t"))
    hits = both.select(
        "q", "doc", "rank", "faq", (F.col("kind") == "procedure").alias("procedure"), (F.col("kind") == "other").alias("other"),
        count("quoted_t", "text").alias("quoted"), count("id_t", "text").alias("ids"), count("alnum_t", "text").alias("alnum"), count("kata_t", "text").alias("katakana"), count("kanji_t", "text").alias("kanji"),
        F.lit(0).cast("long").alias("short"), count(every, "title_f").alias("title"), count(every, "section_f").alias("section"), count(every, "question_f").alias("question"), F.lit(0).cast("long").alias("alias"), count("id_t", "question_f").alias("code"),
        F.size(F.array_distinct(F.concat("alnum_t", "kata_t", "kanji_t"))).alias("n_terms"),
    )
    return V.lifted(hits, "n_terms").select("q", "doc", "rank", "lift", "new_rank")


def m4_binary_ndcg(spark: SparkSession, d: str) -> DataFrame:
    return M.binary_at_k(P._runs(spark, d)[0], P._qrels(spark, d))


def m4_rerank_gain(spark: SparkSession, d: str) -> DataFrame:
    """What the set-cosine order gains over BM25 per question."""
    a, b = P._runs(spark, d)
    return M.rerank_gain(a, b, P._qrels(spark, d))


def m9_golden_checks(spark: SparkSession, d: str) -> DataFrame:
    """Cases against the newest texts of their gold chunks: required and forbidden terms."""
    cases = table(spark, d, "semantic_challenge_v2_cases").select("row_no", F.col("gold_chunk_ids").alias("keys"), F.col("required_gold_support_terms").alias("required"), F.col("forbidden_gold_terms").alias("forbidden"))
    rows = table(spark, d, "semantic_challenge_v2_chunks")
    texts = R.first_by_key(rows.filter("id is not null"), ["id"], F.col("updated_at").desc_nulls_last(), F.col("row_no")).select("id", "text")
    return V.golden_checks(cases, texts, "row_no", "id")


def m11_robustness(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of disturbance: how much of the tokens of a query is left, by Jaccard."""
    forms = t15_perturbed(spark, d)
    both = forms.join(table(spark, d, "semantic_challenge_v2_cases").select("row_no", "query"), "row_no")
    tokens = materialize(both.select("kind", X.heuristic_tokens(F.col("query")).alias("a"), X.heuristic_tokens(F.col("form")).alias("b")), "disturbed")
    left = F.size(F.array_intersect("a", "b")) / F.greatest(F.size(F.array_union("a", "b")), F.lit(1))
    return tokens.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg(left), 6).alias("left"))


QUERIES = {f.__name__: f for f in (j5_review_queue, j6_joined_records, a5_dashboard, ss7_quota_ledger, j17_business_share, r14_heuristic_rerank, m4_binary_ndcg, m4_rerank_gain, m9_golden_checks, m11_robustness)}

_E = "e AS (SELECT event_id, ts, event_type, CAST(props->>'$.k' AS BIGINT) AS k, 'e' || event_id AS request, 'u' || user_id || '-' || strftime(ts, '%Y-%m-%d') AS trace FROM events)"
_CHAT = "chat AS (SELECT request, trace, CASE WHEN k % 5 = 0 THEN 'no_answer' WHEN k % 5 = 1 THEN 'candidates_only' ELSE 'answered' END AS mode, event_type, ts, event_id FROM e WHERE event_type IN ('view', 'click'))"
_FB = "fb AS (SELECT CASE WHEN k % 2 = 0 THEN 'e' || (event_id - 1) ELSE trace END AS token, CASE event_type WHEN 'error' THEN 'bad' WHEN 'purchase' THEN 'good' ELSE 'human_review' END AS kind, CASE WHEN k % 3 = 0 THEN CAST(k AS VARCHAR) END AS selected, ts, event_id FROM e WHERE event_type IN ('error', 'purchase', 'signup'))"
_J6 = f"WITH {_E}, {_CHAT}, {_FB}, last AS (SELECT token, arg_max(kind, (ts, event_id)) AS kind FROM fb GROUP BY 1), rv AS (SELECT 'e' || (event_id - 2) AS id, arg_max(CASE WHEN k % 2 = 0 THEN 'correct' ELSE 'wrong' END, (ts, event_id)) AS verdict FROM e WHERE event_type = 'signup' GROUP BY 1), j AS (SELECT c.request AS id, mode, event_type, coalesce(a.kind, b.kind) AS feedback, verdict FROM chat c LEFT JOIN last a ON a.token = c.request LEFT JOIN last b ON b.token = c.trace LEFT JOIN rv ON rv.id = c.request)"
_F = lambda c: INDEX(c)
_HIT = lambda ts, f: f"len(list_filter({ts}, lambda x: coalesce(contains({f}, x), false)))"
_R14 = f"""{P._L}, t10 AS (SELECT * FROM (SELECT q, doc, row_number() OVER (PARTITION BY q ORDER BY bm25 DESC, doc) AS rank FROM lanes) WHERE rank <= 10),
f AS MATERIALIZED (SELECT row_no AS doc, {_F('text')} AS text, {_F('title')} AS title_f, {_F("array_to_string(section_path, ' ')")} AS section_f, {_F('question_text')} AS question_f, chunk_type = 'qa_pair' AS faq FROM manufacturing_chunks),
a AS MATERIALIZED (SELECT row_no AS q, {P._KIND.replace('query', 'normalized_question')} AS kind, {_F('normalized_question')} AS f FROM manufacturing_chunks WHERE row_no % 20 = 0 AND normalized_question IS NOT NULL),
t AS (SELECT q, kind, list_distinct(regexp_extract_all(f, '{X.QUOTED}', 1)) AS quoted_t, list_distinct(list_filter(list_transform(regexp_extract_all(f, '{X.CODE}'), lambda x: regexp_replace(x, '{X.CODE_TAIL}', '')), lambda x: length(x) >= 2)) AS alnum_t, list_distinct(regexp_extract_all(f, '{KANA_TERM}')) AS kata_t, list_distinct(regexp_extract_all(f, '{KANJI_TERM}')) AS kanji_t FROM a),
u AS (SELECT *, list_filter(alnum_t, lambda x: regexp_matches(x, '[0-9]')) AS id_t, list_distinct(list_concat(list_concat(quoted_t, kata_t), list_concat(kanji_t, alnum_t))) AS every, len(list_distinct(list_concat(alnum_t, list_concat(kata_t, kanji_t)))) AS n_terms FROM t),
h AS (SELECT q, doc, rank, faq, kind, n_terms, {_HIT('quoted_t', 'text')} AS quoted, {_HIT('id_t', 'text')} AS ids, {_HIT('alnum_t', 'text')} AS alnum, {_HIT('kata_t', 'text')} AS katakana, {_HIT('kanji_t', 'text')} AS kanji, {_HIT('every', 'title_f')} AS title, {_HIT('every', 'section_f')} AS section, {_HIT('every', 'question_f')} AS question, {_HIT('id_t', 'question_f')} AS code FROM t10 JOIN f USING (doc) JOIN u USING (q)),
p AS (SELECT *, (quoted > 0 OR ids > 0) AS strong, alnum + katakana + kanji AS lexical, CASE WHEN quoted > 0 THEN 2 + least(1, quoted - 1) ELSE 0 END + CASE WHEN ids > 0 THEN 1 WHEN alnum > 0 THEN 2 ELSE 0 END + CASE WHEN katakana > 0 THEN 2 ELSE 0 END + CASE WHEN kanji > 0 THEN 2 ELSE 0 END + least(2, title) + CASE WHEN section > 0 THEN 1 ELSE 0 END + CASE WHEN question > 0 THEN 2 ELSE 0 END + CASE WHEN code > 0 THEN 1 ELSE 0 END + CASE WHEN kind = 'procedure' THEN 1 ELSE 0 END AS raw FROM h),
l AS (SELECT *, CAST(least(CASE WHEN NOT strong AND n_terms > 1 AND lexical < 2 AND title = 0 AND question = 0 THEN 0 WHEN kind = 'other' AND NOT strong THEN least(raw, 2) ELSE raw END, CASE WHEN strong THEN 3 ELSE 2 END) AS BIGINT) AS lift FROM p)
SELECT q, doc, rank, lift, row_number() OVER (PARTITION BY q ORDER BY greatest(1, rank - lift), CASE WHEN strong THEN 0 ELSE 1 END, -(quoted + ids + code), -(title + section + question), -lexical, rank) AS new_rank FROM l"""
SQL = {
    "j5_review_queue": f"""WITH {_E}, {_CHAT}, {_FB}, first AS (SELECT trace AS token, arg_min(request, (ts, event_id)) AS request FROM chat GROUP BY 1),
said AS (SELECT token, request, CASE WHEN kind = 'human_review' THEN kind WHEN coalesce(trim(selected), '') <> '' THEN 'bad_with_selection' ELSE 'bad_without_selection' END AS reason FROM fb JOIN first USING (token) WHERE kind IN ('bad', 'human_review')),
loud AS (SELECT DISTINCT token FROM fb WHERE kind IN ('bad', 'human_review')), items AS (SELECT token, request, reason, CASE WHEN reason = 'bad_without_selection' THEN 'medium' ELSE 'high' END AS priority, 'feedback' AS source FROM said
UNION ALL SELECT trace, request, mode, CASE WHEN mode = 'no_answer' THEN 'medium' ELSE 'low' END, 'chat' FROM chat WHERE mode = 'no_answer' OR (mode = 'candidates_only' AND trace NOT IN (SELECT token FROM loud)))
SELECT DISTINCT 'review_' || substr(sha256(concat_ws('|', token, request, reason)), 1, 20) AS review_id, token, request, reason, priority, source FROM items""",
    "j6_joined_records": f"{_J6} SELECT id, mode, feedback, verdict FROM j",
    "a5_dashboard": f"""{_J6}, t AS (SELECT count(*) AS records, count(*) FILTER (mode = 'no_answer') AS abstained, count(*) FILTER (event_type = 'click') AS degraded, count(*) FILTER (feedback = 'bad' AND verdict IS NULL) AS waiting FROM j)
SELECT 'mode' AS part, mode AS name, count(*) AS n FROM j GROUP BY 2 UNION ALL SELECT 'feedback', feedback, count(*) FROM j WHERE feedback IS NOT NULL GROUP BY 2 UNION ALL SELECT 'verdict', verdict, count(*) FROM j WHERE verdict IS NOT NULL GROUP BY 2
UNION ALL SELECT 'total', 'records', records FROM t UNION ALL SELECT 'total', 'abstained', abstained FROM t UNION ALL SELECT 'total', 'degraded', degraded FROM t UNION ALL SELECT 'total', 'bad and unreviewed', waiting FROM t""",
    "ss7_quota_ledger": f"WITH {_E}, r AS (SELECT trace || '/' || (k % 7) AS reservation, arg_max(strftime(ts, '%Y-%m-%d'), (ts, event_id)) AS day, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(k, (ts, event_id)) AS k FROM e WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1) SELECT day, count(*) AS reservations, CAST(sum(CASE WHEN event_type = 'purchase' THEN k ELSE 0 END) AS BIGINT) AS settled, CAST(sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE k END) AS BIGINT) AS reserved FROM r GROUP BY 1",
    "j17_business_share": "WITH p AS (SELECT user_id % 5 AS tenant, event_type <> 'error' AS ok, ts + INTERVAL 9 HOUR AS s, lead(ts + INTERVAL 9 HOUR) OVER (PARTITION BY user_id % 5 ORDER BY ts, event_id) AS n FROM events), i AS (SELECT tenant, ok, s, least(n, s + INTERVAL 300 SECOND) AS e FROM p WHERE n IS NOT NULL), d AS (SELECT *, unnest(range(CAST(s AS DATE)::TIMESTAMP, CAST(e AS DATE)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM i), w AS (SELECT tenant, ok, CASE WHEN dayofweek(d) IN (0, 6) THEN 0 ELSE greatest(epoch_us(least(e, d + INTERVAL 21 HOUR)) - epoch_us(greatest(s, d + INTERVAL 8 HOUR)), 0) END AS us FROM d), g AS (SELECT tenant, round(sum(CASE WHEN ok THEN us ELSE 0 END) / 1e6, 3) AS up, round(sum(CASE WHEN ok THEN 0 ELSE us END) / 1e6, 3) AS down FROM w GROUP BY 1) SELECT *, round(up / (up + down), 6) AS share FROM g",
    "r14_heuristic_rerank": _R14,
    "m4_binary_ndcg": f"""{P._L}, {P._QRELS}, {P._run_sql('bm25', 'run_a')}, d AS (SELECT DISTINCT q, item FROM qrels), n AS (SELECT q, list_sum(list_transform(range(1, least(count(*), 10) + 1), lambda i: 1 / log2(i + 1))) AS idcg FROM d GROUP BY 1), g AS (SELECT q, min(rank) AS first, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT q, item, min(rank) AS rank FROM d JOIN run_a USING (q, item) GROUP BY 1, 2) GROUP BY 1)
SELECT q, CASE WHEN first IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS hit, round(coalesce(1.0 / first, 0), 6)::DOUBLE AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg FROM n LEFT JOIN g USING (q)""",
    "m4_rerank_gain": f"{P._L}, {P._QRELS}, {P._run_sql('bm25', 'run_a')}, {P._run_sql('cosine', 'run_b')}, q AS (SELECT DISTINCT q, item FROM qrels), a AS (SELECT q, min(rank) AS before FROM q JOIN run_a USING (q, item) GROUP BY 1), b AS (SELECT q, min(rank) AS after FROM q JOIN run_b USING (q, item) GROUP BY 1) SELECT q, before, after, before - after AS gain, before IS NOT NULL AND after IS NULL AS dropped FROM (SELECT DISTINCT q FROM q) LEFT JOIN a USING (q) LEFT JOIN b USING (q)",
    "m9_golden_checks": """WITH t AS (SELECT id, text FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, row_no) AS r FROM semantic_challenge_v2_chunks WHERE id IS NOT NULL) WHERE r = 1),
c AS (SELECT row_no, list_filter(coalesce(required_gold_support_terms, []), lambda x: x IS NOT NULL AND trim(x) <> '') AS req, list_filter(coalesce(forbidden_gold_terms, []), lambda x: x IS NOT NULL AND trim(x) <> '') AS forb, gold_chunk_ids AS ids FROM semantic_challenge_v2_cases),
k AS (SELECT DISTINCT row_no, unnest(ids) AS id FROM c), x AS (SELECT row_no, list(text) FILTER (text IS NOT NULL) AS texts FROM k JOIN t USING (id) GROUP BY 1),
y AS (SELECT c.row_no, req, forb, coalesce(texts, []) AS texts FROM c LEFT JOIN x USING (row_no))
SELECT row_no, len(texts) AS texts, len(list_filter(req, lambda r: len(list_filter(texts, lambda s: contains(s, r))) = 0)) = 0 AS all_held, len(list_filter(req, lambda r: len(list_filter(texts, lambda s: contains(s, r))) > 0)) > 0 AS any_held, len(list_filter(forb, lambda r: len(list_filter(texts, lambda s: contains(s, r))) > 0)) > 0 AS forbidden_held FROM y""",
    "m11_robustness": f"WITH c AS (SELECT {_PICK} AS kind, query, {T15_FORM} AS form FROM semantic_challenge_v2_cases WHERE query IS NOT NULL), xa AS MATERIALIZED (SELECT kind, form, {INDEX('query')} AS s FROM c), a AS (SELECT kind, form, {TOKENS} AS a FROM xa), xb AS MATERIALIZED (SELECT kind, a, {INDEX('form')} AS s FROM a), b AS (SELECT kind, a, {TOKENS} AS b FROM xb) SELECT kind, count(*) AS n, round(avg(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)), 6) AS \"left\" FROM b GROUP BY 1",
}
