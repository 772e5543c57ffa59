import pytest
from pyspark.sql import functions as F

from hibiki import api


@pytest.fixture(scope="module")
def corpus(spark, data):
    from hibiki.sources.tables import table

    rows = table(spark, data, "manufacturing_chunks")
    docs = rows.select(F.col("row_no").alias("doc"), "text", "tenant_id", "source_doc", "qa_id", "searchable")
    asked = rows.filter("row_no % 5 = 0 and normalized_question is not null").select(F.col("row_no").alias("q"), F.col("normalized_question").alias("query"), "qa_id")
    return asked, docs


@pytest.mark.parametrize("fusion", ["rrf", "dbsf", "keyword_only", "dense_only"])
def test_search_finds_the_own_row(spark, corpus, fusion):
    asked, docs = corpus
    run = api.search(asked, docs, api.Options(fusion=fusion, top_k=5))
    rows = run.collect()
    by = {}
    for r in rows:
        by.setdefault(r["q"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 5 for v in by.values())
    qrels = asked.select("q", F.col("q").alias("item"), F.lit(1).alias("grade"))
    assert api.evaluate(run, qrels).first()["hit"] > 0.9
    assert api.compare(run, run, qrels).first()["p"] == 1.0


def test_search_options(spark, corpus):
    asked, docs = corpus
    tenant = {r["doc"] for r in docs.filter("tenant_id = 'tenant-b'").select("doc").collect()}
    run = api.search(asked, docs, api.Options(tenant="tenant-b", where={"searchable": 1}, per_page=1, context_chars=500, routed=True)).collect()
    assert run and {r["doc"] for r in run} <= tenant
    assert api.search(asked.limit(0), docs).count() == 0 and api.search(asked, docs.limit(0)).count() == 0
    for bad in ({"fusion": "x"}, {"top_k": 0}, {"b": 2}):
        with pytest.raises(ValueError):
            api.Options(**bad)


def test_answer_and_reports(spark, data):
    from hibiki.sources.tables import table

    qa = table(spark, data, "approved_qa_alias_fixture")
    asked = qa.filter("status = 'approved'").select(F.col("row_no").alias("q"), F.upper("question").alias("query"))
    assert api.answer(asked, qa).count() == asked.count()
    e = table(spark, data, "events")
    assert api.drift_report(e, e, "value").first()["verdict"] == "ok"
    calls = e.select("user_id", F.col("event_type").alias("outcome"), F.lit(1).alias("tokens"), F.col("value").alias("cost"))
    assert api.usage_report(calls, ["user_id"]).filter("key = 'all'").first()["calls"] == e.count()
    probes = e.select(F.lit("x").alias("target"), F.col("ts").alias("t"), (F.col("event_type") != "error").alias("ok"), F.col("event_id").alias("id"))
    assert api.availability_report(probes, max_gap=100_000).first()["unmonitored"] == 0
