"""Arrow functions over the corpus tables.

Where SQL cannot read a text, it can write one: the round trips render known numbers, dates, amounts, pairs and rows of a
table as text, read them back and are held against the tables themselves.  The rest is tested against goldens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking as C
from ..functions import japanese as J
from ..functions import text as X
from ..sources.tables import spread, table
from .folding import nfkc_sql


def n1_profiles(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "semantic_challenge_v2_cases").select("row_no", "query"))
    return q.select("row_no", *[J.normalized_as(p)("query").alias(p) for p in J.PROFILES])


def t5_salient_terms(spark: SparkSession, d: str) -> DataFrame:
    terms = spread(table(spark, d, "semantic_challenge_v2_cases").select("row_no", "query")).select(F.explode(J.salient_of("query")).alias("term"))
    return terms.groupBy("term").agg(F.count("*").alias("n"))


def t11_quantities(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.explode(J.quantities_of("text")).alias("q"))
    return q.groupBy("q.kind", "q.unit").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def c6_target_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(C.chunks_of("text")).alias("chunk_index", "chunk"))
    return c.select("doc_id", "chunk_index", F.length("chunk").alias("chars"), F.concat(F.lit("c_"), F.substring(F.sha1("chunk"), 1, 16)).alias("chunk_id"))


def c2_parents_and_children(spark: SparkSession, d: str) -> DataFrame:
    """Each document as a parent row and its chunks as child rows, numbered together."""
    docs = spread(table(spark, d, "documents").filter("text is not null").select("doc_id", "text"))
    kids = docs.select("doc_id", F.posexplode(C.chunks_of("text")).alias("i", "text"))
    both = docs.select("doc_id", F.lit(0).alias("chunk_index"), F.lit("parent").alias("chunk_role"), "text").unionByName(kids.select("doc_id", (F.col("i") + 1).alias("chunk_index"), F.lit("child").alias("chunk_role"), "text"))
    parent = F.concat(F.lit("p_"), F.col("doc_id").cast("string"))
    return both.select("doc_id", "chunk_index", "chunk_role", F.when(F.col("chunk_role") == "child", parent).alias("parent_chunk_id"), F.length("text").alias("chars"))


def c8_sentence_windows(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(C.windows_of("text")).alias("no", "w")).select("doc_id", "no", F.length("w").alias("chars"))


def n10_joined_lines(spark: SparkSession, d: str) -> DataFrame:
    lines = lambda c: F.size(F.split(c, "\n"))
    j = spread(table(spark, d, "documents").select("doc_id", "text")).withColumn("joined", C.joined_of("text"))
    return j.select("doc_id", lines("text").alias("lines_before"), lines("joined").alias("lines_after"))


def n1_text_form(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "semantic_challenge_v2_chunks").select("row_no", F.sha2(X.text_form(F.col("text")), 256).alias("form_sha"))


def n1_dense(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "semantic_challenge_v2_chunks").select("row_no", "text"))
    return q.select("row_no", F.sha2(J.normalized_as("dense")("text"), 256).alias("form_sha"))


def n3_rules(spark: SparkSession, d: str) -> DataFrame:
    """How often each rule of the match profile changes a query."""
    q = spread(table(spark, d, "semantic_challenge_v2_cases").select("query"))
    return q.select(F.explode(J.rules_of("match")("query")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def n5_kept_form(spark: SparkSession, d: str) -> DataFrame:
    q = spread(table(spark, d, "semantic_challenge_v2_cases").select("row_no", "query"))
    return q.select("row_no", J.kept_form("query").alias("form"))


def t7_query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Quoted, code and salient terms of every query, the first kind that has a term first."""
    q = spread(table(spark, d, "semantic_challenge_v2_cases").select("row_no", "query")).select("row_no", X.index_form(F.col("query")).alias("f"), J.salient_of("query").alias("salient"))
    salient = F.transform("salient", F.lower)
    codes = F.filter(salient, lambda t: t.rlike(f"^{X.CODE}$"))
    exact = F.array_distinct(F.concat(X.quoted_terms(F.col("f")), F.filter(codes, lambda t: t.rlike("[0-9]")), codes, salient))
    return q.select("row_no", exact.alias("terms")).select("row_no", F.posexplode("terms").alias("place", "term"))


def t9_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Order keys and prices written in numerals, digit by digit and by myriads, and read again."""
    o = spread(table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("price")))
    digits = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "〇一二三四五六七八九")
    high, low = F.floor(F.col("price") / 10_000).cast("long"), F.pmod("price", F.lit(10_000))
    mixed = F.concat(F.when(high > 0, F.concat(high.cast("string"), F.lit("万"))).otherwise(F.lit("")), F.when((low > 0) | (high == 0), low.cast("string")).otherwise(F.lit("")))
    return o.select("o_orderkey", J.number_text(digits).cast("long").alias("key_read"), J.number_text(mixed).cast("long").alias("price_read"))


def t10_dates(spark: SparkSession, d: str) -> DataFrame:
    """Order dates written in three ways and read again."""
    o = spread(table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("t")))
    y, m, day = (f("t").cast("string") for f in (F.year, F.month, F.dayofmonth))
    era = (F.year("t") - 1988).cast("string")
    text = F.concat(F.lit("納期は平成"), era, F.lit("年"), m, F.lit("月"), day, F.lit("日、"), F.lit("H"), era, F.lit("."), m, F.lit("."), day, F.lit("、"), y, F.lit("/"), m, F.lit("/"), day, F.lit("です。"))
    return o.select("o_orderkey", J.dates_of(text).alias("f")).select("o_orderkey", F.size("f").cast("long").alias("n"), F.array_join(F.array_distinct(F.transform("f", lambda x: x["canonical"])), ",").alias("days"))


def t11_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Weights, prices and discounts of order lines written into sentences, read again and added up per kind."""
    rows = spread(table(spark, d, "lineitem").select(F.col("l_quantity").cast("long").cast("string").alias("q"), F.floor("l_extendedprice").cast("long").alias("p"), F.round(F.col("l_discount") * 100).cast("long").cast("string").alias("r")))
    price = F.format_number("p", 0)
    text = F.concat(F.lit("品番AB-12の重量は"), "q", F.lit("ｋｇ、価格は"), price, F.lit("円、値引きは"), "r", F.lit("％。"))
    f = rows.select(F.explode(J.quantities_of(text)).alias("f"))
    return f.groupBy("f.kind", "f.unit").agg(F.count("*").alias("n"), F.sum(F.col("f.value").cast("decimal(38,0)")).cast("string").alias("total"))


def c3_faq(spark: SparkSession, d: str) -> DataFrame:
    """Approved pairs of one line each written as marked questions and answers, and taken apart again."""
    qa = spread(table(spark, d, "approved_qa_alias_fixture").filter(r"not question rlike '[\\s\\p{Z}]{2}|^[\\s\\p{Z}]|[\\s\\p{Z}]$|[\\r\\n]' and not approved_answer rlike '^[\\s\\p{Z}]|[\\s\\p{Z}]$|[\\r\\n]' and approved_answer <> ''").select("row_no", "question", "approved_answer"))
    text = F.concat(F.lit("前書き\nQ1. "), "question", F.lit("\nA1. "), "approved_answer", F.lit("\n"))
    return qa.select("row_no", F.explode(C.faq_of(text)).alias("p")).select("row_no", F.sha2(F.concat_ws("|", "p.question", "p.answer"), 256).alias("pair_sha"))


def c5_table_rows(spark: SparkSession, d: str) -> DataFrame:
    """Parts written as tables with bars and read as rows of named values."""
    p = spread(table(spark, d, "part").select("p_partkey", F.concat(F.lit("key | brand | size\n---|---|---\n"), F.col("p_partkey").cast("string"), F.lit(" | "), "p_brand", F.lit(" | "), F.col("p_size").cast("string")).alias("t")))
    return p.select("p_partkey", F.explode(C.table_rows_of("t")).alias("row"))


QUERIES = {f.__name__: f for f in (n1_text_form, n1_dense, n3_rules, n5_kept_form, t7_query_terms, t9_numbers, t10_dates, t11_amounts, c3_faq, c5_table_rows, n1_profiles, t5_salient_terms, t11_quantities, c2_parents_and_children, c6_target_chunks, c8_sentence_windows, n10_joined_lines)}
_FROM, _TO = (x.replace("'", "''") for x in X.DASHES_AND_QUOTES)
_ONE_LINE = "regexp_matches(question, '[\\s\\p{Z}]{2}|^[\\s\\p{Z}]|[\\s\\p{Z}]$|[\\r\\n]')"
SQL: dict[str, str] = {
    "n1_text_form": f"SELECT row_no, sha256(trim(regexp_replace(translate({nfkc_sql('text')}, '{_FROM}', '{_TO}'), '{X.WS}', ' ', 'g'))) AS form_sha FROM semantic_challenge_v2_chunks",
    "n1_dense": rf"""WITH a AS (SELECT row_no, regexp_replace(replace(replace({nfkc_sql('text')}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x{{00}}-\x{{08}}\x{{0b}}\x{{0c}}\x{{0e}}-\x{{1f}}\x{{7f}}\x{{200b}}-\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g') AS s FROM semantic_challenge_v2_chunks)
SELECT row_no, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '[ \t\x{{3000}}\x{{a0}}]+', ' ', 'g'), ' +\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')) AS form_sha FROM a""",
    "t9_numbers": "SELECT o_orderkey, o_orderkey AS key_read, CAST(floor(o_totalprice) AS BIGINT) AS price_read FROM orders",
    "t10_dates": "SELECT o_orderkey, 3::BIGINT AS n, strftime(o_orderdate, '%Y-%m-%d') AS days FROM orders",
    "t11_amounts": "SELECT 'measure' AS kind, 'kg' AS unit, count(*) AS n, CAST(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS VARCHAR) AS total FROM lineitem UNION ALL SELECT 'money', 'JPY', count(*), CAST(CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS VARCHAR) FROM lineitem UNION ALL SELECT 'percent', '%', count(*), CAST(CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS VARCHAR) FROM lineitem",
    "c3_faq": f"SELECT row_no, sha256(question || '|' || approved_answer) AS pair_sha FROM approved_qa_alias_fixture WHERE NOT {_ONE_LINE} AND NOT regexp_matches(approved_answer, '^[\\s\\p{{Z}}]|[\\s\\p{{Z}}]$|[\\r\\n]') AND approved_answer <> ''",
    "c5_table_rows": "SELECT p_partkey, 'key=' || p_partkey || ' / brand=' || p_brand || ' / size=' || p_size AS row FROM part",
}
