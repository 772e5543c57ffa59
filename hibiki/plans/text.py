"""Text functions over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import spread, table
from .folding import nfkc_sql

DOCS, CHUNKS, CASES, ANSWERS = "documents", "semantic_challenge_v2_chunks", "semantic_challenge_v2_cases", "approved_qa_alias_fixture"

_FROM, _TO = (x.replace("'", "''") for x in X.DASHES_AND_QUOTES)
INDEX = lambda c: f"lower(trim(regexp_replace(translate({nfkc_sql(c)}, '{_FROM}', '{_TO}'), '{X.WS}', ' ', 'g')))"
TOKENS = f"""list_distinct(list_filter(list_concat(list_concat(regexp_extract_all(s, '{X.QUOTED}', 1),
  list_filter(list_transform(regexp_extract_all(s, '{X.CODE}'), lambda t: regexp_replace(t, '{X.CODE_TAIL}', '')), lambda t: length(t) >= 2)),
  list_concat(list_concat(regexp_extract_all(s, '[{X.KATAKANA}]{{2,}}'), regexp_extract_all(s, '[{X.KANJI}]{{2,}}')),
  list_transform([string_split(regexp_replace(s, '{X.COMPACT}', '', 'g'), '')], lambda l: list_transform(range(1, len(l)), lambda i: l[i] || l[i + 1]))[1])), lambda t: NOT regexp_matches(t, '^[{X.HIRAGANA}]{{1,3}}$')))"""


def n2_index_form(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, DOCS).select("doc_id", "text")).select("doc_id", X.index_form(F.col("text")).alias("form"))
    return rows.select("doc_id", F.sha2("form", 256).alias("form_sha"), F.length("form").cast("long").alias("n"))


def n3_match_form(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("question")
    changed = F.array_join(F.array_compact(F.array(F.when(X.index_form(c) != c, "index"), F.when(X.match_form(c) != X.index_form(c), "fold"))), ",")
    return table(spark, d, ANSWERS).select("row_no", X.match_form(c).alias("form"), changed.alias("rules"))


def n6_strong_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, CASES).groupBy(X.strong_key(F.col("query")).alias("strong_key")).agg(F.count("*").alias("n"), F.min("row_no").alias("first_row"))


def n8_evidence_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, CHUNKS).select("row_no", F.sha2(X.evidence_key(F.col("text")), 256).alias("key_sha"))


def n12_pii_mask(spark: SparkSession, d: str) -> DataFrame:
    m = X.mask_pii(F.col("text"))
    return table(spark, d, DOCS).select("doc_id", F.sha2(m, 256).alias("masked_sha"), (F.length(m) - F.length(F.regexp_replace(m, "#", ""))).cast("long").alias("n_masked"))


def f9_garbled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).groupBy("source").agg(F.sum(X.is_garbled(F.col("text")).cast("long")).alias("n_garbled"), F.count("*").alias("n_docs"))


def t1_tokens(spark: SparkSession, d: str) -> DataFrame:
    tokens = spread(table(spark, d, CHUNKS).select("row_no", "text")).select("row_no", X.heuristic_tokens(F.col("text")).alias("t"))
    return tokens.select("row_no", F.size("t").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.array_sort("t"), "\x01"), 256).alias("tokens_sha"))


def t1_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    tokens = spread(table(spark, d, DOCS).select("text")).select(F.explode(X.heuristic_tokens(F.col("text"))).alias("term"))
    return tokens.groupBy("term").agg(F.count("*").alias("df"))


def t2_code_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, CHUNKS).select("row_no", F.explode(X.code_tokens(F.col("text"))).alias("code"))


def t3_bigrams(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, CHUNKS).select(F.explode(F.regexp_extract_all("text", F.lit(rf"[{X.KATAKANA}{X.KANJI}]{{2,}}"), F.lit(0))).alias("run"))
    return runs.select(F.explode(X.char_bigrams(F.col("run"))).alias("g")).groupBy(F.concat(F.lit("2g:"), "g").alias("term")).agg(F.count("*").alias("n"))


def t13_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, DOCS).groupBy("source").agg(F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.max(X.token_estimate(F.col("text"))).alias("most"))


_SLICES = {"year": "(19|20)[0-9]{2}", "amount": "[0-9]+(\\.[0-9]+)? ?(kg|mm|cm|MPa|bar|V|℃|L|分|個)", "negation": "(ない|ません|不|not |never |without )", "condition": "(場合|とき|たら|if |when |once |after )", "code": "[A-Z0-9]+-[A-Z0-9]+", "katakana": f"[{X.KATAKANA}]{{3,}}"}


def t14_slices(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("query")
    named = [F.when(q.rlike(p), n) for n, p in _SLICES.items()] + [F.when(F.length(q) <= 12, "short")]
    return table(spark, d, CASES).select(F.explode(F.array_append(F.array_compact(F.array(*named)), F.lit("all"))).alias("slice")).groupBy("slice").agg(F.count("*").alias("n"))


def t16_hash_split(spark: SparkSession, d: str) -> DataFrame:
    share = X.hash_share(F.col("doc_id"), "split")
    return table(spark, d, DOCS).select("doc_id", share.alias("share"), F.when(share < 8000, "dev").otherwise("test").alias("split"))


def t17_stable_ids(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat_ws("\x01", F.coalesce("tenant_id", F.lit("default")), "source_doc", F.col("chunk_index").cast("string"), "text")
    return table(spark, d, CHUNKS).select("row_no", F.concat(F.lit("c_"), F.substring(F.sha1(key), 1, 16)).alias("stable_id"))


# Marks of questions, answers, steps and articles at the start of a line.
_MARKS = {"q": "^[ \\t]*(Q|Ｑ|問|質問)[0-9０-９]*[.:：．、]", "a": "^[ \\t]*(A|Ａ|答|回答)[0-9０-９]*[.:：．、]", "steps": "^[ \\t]*([0-9]{1,2}[.)．]|手順[0-9])", "articles": "^(第[0-9一二三四五六七八九十]+[条章節]|■|【|[0-9]+\\.[0-9]+ )", "rows": "\\|.*\\||\\t"}


def c1_doc_type(spark: SparkSession, d: str) -> DataFrame:
    """faq with three questions and answers or more, balanced; table, procedure or policy by the share of lines; else text."""
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.trim(x)) > 0)
    rows = table(spark, d, DOCS).select("doc_id", lines.alias("l"))
    count = lambda p: F.size(F.filter("l", lambda x: x.rlike(p)))
    rows = rows.select("doc_id", F.size("l").alias("n"), *[count(p).alias(k) for k, p in _MARKS.items()])
    balanced = F.least("q", "a") * 2 >= F.greatest("q", "a")
    kind = F.when((F.col("q") >= 3) & (F.col("a") >= 3) & balanced, "faq").when(F.col("rows") * 2 >= F.col("n"), "table").when(F.col("steps") >= 3, "procedure").when(F.col("articles") >= 2, "policy").otherwise("text")
    return rows.select("doc_id", kind.alias("kind"), F.col("n").cast("long").alias("n_lines"))


def c7_fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, DOCS).select("doc_id", F.explode(X.fixed_windows(F.col("text"), 400, 80)).alias("w"))
    return w.select("doc_id", F.col("w.no").cast("long").alias("no"), F.col("w.start").cast("long").alias("start"), F.sha2("w.piece", 256).alias("piece_sha"))


def c9_reassemble(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, DOCS).select("doc_id", "text", F.explode(X.fixed_windows(F.col("text"), 400, 0)).alias("w"))
    parts = F.array_sort(F.collect_list(F.struct("w.no", "w.piece")))
    whole = w.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"), F.count("*").alias("n_parts"))
    return whole.select("doc_id", F.sha2("text", 256).alias("text_sha"), "n_parts")


QUERIES = {f.__name__: f for f in (n2_index_form, n3_match_form, n6_strong_key, n8_evidence_key, n12_pii_mask, f9_garbled, t1_tokens, t1_document_frequency, t2_code_tokens, t3_bigrams, t13_token_estimate, t14_slices, t16_hash_split, t17_stable_ids, c1_doc_type, c7_fixed_windows, c9_reassemble)}

_FOLD = f"translate({INDEX('question')}, '{X.WAVES[0]}', '{X.WAVES[1]}')"
_GARBLED = f"CASE WHEN length(text) = 0 THEN true ELSE (length(text) - length(regexp_replace(text, '{X.BAD}', '', 'g'))) > 0.02 * length(text) OR (length(text) - length(regexp_replace(text, '{X.LETTER}', '', 'g'))) < 0.1 * length(text) END"
_WIDE = f"(length(text) - length(regexp_replace(text, '{X.WIDE}', '', 'g')))"
_EST = f"(CAST({_WIDE} AS BIGINT) // 2 + CAST(length(text) - {_WIDE} AS BIGINT) // 4 + 1)"
_LINES = "list_filter(string_split(text, chr(10)), lambda x: length(trim(x)) > 0)"
SQL = {
    "n2_index_form": f"SELECT doc_id, sha256({INDEX('text')}) AS form_sha, length({INDEX('text')}) AS n FROM documents",
    "n3_match_form": f"SELECT row_no, {_FOLD} AS form, concat_ws(',', CASE WHEN {INDEX('question')} <> question THEN 'index' END, CASE WHEN {_FOLD} <> {INDEX('question')} THEN 'fold' END) AS rules FROM approved_qa_alias_fixture",
    "n6_strong_key": f"SELECT regexp_replace({INDEX('query')}, '{X.PUNCT}', '', 'g') AS strong_key, count(*) AS n, min(row_no) AS first_row FROM semantic_challenge_v2_cases GROUP BY 1",
    "n8_evidence_key": f"SELECT row_no, sha256(regexp_replace({INDEX('text')}, '{X.WS}', '', 'g')) AS key_sha FROM semantic_challenge_v2_chunks",
    "n12_pii_mask": f"WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(text, '{X.EMAIL}', '[email]', 'g'), '[0-9]', '#', 'g') AS m FROM documents) SELECT doc_id, sha256(m) AS masked_sha, length(m) - length(replace(m, '#', '')) AS n_masked FROM m",
    "f9_garbled": f"SELECT source, CAST(sum(CASE WHEN {_GARBLED} THEN 1 ELSE 0 END) AS BIGINT) AS n_garbled, count(*) AS n_docs FROM documents GROUP BY 1",
    "t1_tokens": f"WITH x AS MATERIALIZED (SELECT row_no, {INDEX('text')} AS s FROM semantic_challenge_v2_chunks), t AS (SELECT row_no, {TOKENS} AS t FROM x) SELECT row_no, len(t) AS n_tokens, sha256(array_to_string(list_sort(t), chr(1))) AS tokens_sha FROM t",
    "t1_document_frequency": f"WITH x AS MATERIALIZED (SELECT {INDEX('text')} AS s FROM documents), t AS (SELECT unnest({TOKENS}) AS term FROM x) SELECT term, count(*) AS df FROM t GROUP BY 1",
    "t2_code_tokens": f"WITH r AS (SELECT row_no, list_filter(list_transform(regexp_extract_all(lower(text), '{X.CODE}'), lambda t: regexp_replace(t, '{X.CODE_TAIL}', '')), lambda t: length(t) >= 2) AS r FROM semantic_challenge_v2_chunks) SELECT row_no, unnest(list_distinct(list_concat(r, list_transform(r, lambda t: regexp_replace(t, '[._:/-]', '', 'g'))))) AS code FROM r",
    "t3_bigrams": f"WITH r AS (SELECT unnest(regexp_extract_all(text, '[{X.KATAKANA}{X.KANJI}]{{2,}}')) AS run FROM semantic_challenge_v2_chunks), g AS (SELECT unnest(list_transform(range(1, length(run)), lambda i: substr(run, i, 2))) AS g FROM r) SELECT '2g:' || g AS term, count(*) AS n FROM g GROUP BY 1",
    "t13_token_estimate": f"SELECT source, CAST(sum({_EST}) AS BIGINT) AS tokens, max({_EST}) AS most FROM documents GROUP BY 1",
    "t14_slices": " UNION ALL ".join([f"SELECT '{n}' AS slice, count(*) AS n FROM semantic_challenge_v2_cases WHERE regexp_matches(query, '{p}')" for n, p in _SLICES.items()] + ["SELECT 'short' AS slice, count(*) AS n FROM semantic_challenge_v2_cases WHERE length(query) <= 12 HAVING count(*) > 0", "SELECT 'all' AS slice, count(*) AS n FROM semantic_challenge_v2_cases"]),
    "t16_hash_split": "WITH h AS (SELECT doc_id, CAST('0x' || substr(sha256('split:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 AS share FROM documents) SELECT doc_id, share, CASE WHEN share < 8000 THEN 'dev' ELSE 'test' END AS split FROM h",
    "t17_stable_ids": "SELECT row_no, 'c_' || substr(sha1(concat_ws(chr(1), coalesce(tenant_id, 'default'), source_doc, CAST(chunk_index AS VARCHAR), text)), 1, 16) AS stable_id FROM semantic_challenge_v2_chunks",
    "c1_doc_type": f"WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents), n AS (SELECT doc_id, len(l) AS n, " + ", ".join(f"len(list_filter(l, lambda x: regexp_matches(x, '{p}'))) AS {k}" for k, p in _MARKS.items()) + " FROM l) SELECT doc_id, CASE WHEN q >= 3 AND a >= 3 AND least(q, a) * 2 >= greatest(q, a) THEN 'faq' WHEN rows * 2 >= n THEN 'table' WHEN steps >= 3 THEN 'procedure' WHEN articles >= 2 THEN 'policy' ELSE 'text' END AS kind, n AS n_lines FROM n",
    "c7_fixed_windows": "WITH w AS (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 400 THEN 1 ELSE CAST(ceil((length(text) - 80) / 320.0) AS BIGINT) END)) AS no FROM documents) SELECT doc_id, no, no * 320 AS start, sha256(substr(text, no * 320 + 1, 400)) AS piece_sha FROM w",
    "c9_reassemble": "SELECT doc_id, sha256(text) AS text_sha, CAST(ceil(length(text) / 400.0) AS BIGINT) AS n_parts FROM documents WHERE length(text) > 0",
}
