"""Small cases of the operators for reviews, ingest, statistics and search: nulls, empty tables, ties, hot keys."""

import itertools
import math
import random
import re
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki.functions import japanese as J
from hibiki.functions import text as X
from hibiki.operators import bigrams as B
from hibiki.operators import ingest as G
from hibiki.operators import logs as L
from hibiki.operators import metrics as M
from hibiki.operators import orphans as O
from hibiki.operators import reconcile as RC
from hibiki.operators import rerank as K
from hibiki.operators import retrieval as R
from hibiki.operators import review as V
from hibiki.operators import stats as S
from hibiki.sources import store, tables


@pytest.mark.parametrize(
    "given, profile, want",
    [("キー", "match", "キー"), ("サーバーラック", "match", "サーバーラック"), ("1,2,345", "index", "1,2,345"), ("12,345,678個", "index", "12345678個"), ("a\nb", "display", "a\nb"), ("a\r\n\n\n\nb  ", "display", "a\n\nb"), ("統一と十分な三件", "index", "統一と十分な3件"), ("A​B", "display", "AB"), ("", "match", "")],
)
def test_profiles_keep_what_is_no_form(given, profile, want):
    assert J.normalized(given, profile) == want == J.normalized(want, profile)


@pytest.mark.parametrize(
    "given, want",
    [
        ("2024年度の3件", [("fiscal_year", "FY2024", True), ("count", "3件", True)]),
        ("令和元年5月1日", [("date", "2019-05-01", True)]),
        ("H31.4.30と2024-02-30", [("date", "2019-04-30", True), ("date", "2024-02-30", False)]),
        ("2024/4に午後3時30分", [("date", "2024-04", True), ("time", "15:30", True)]),
        ("25時", [("number", "25", True)]),
        ("03-1234-5678と100-0001とzz-10を2個", [("count", "2個", True)]),
        ("10日以内、5営業日、毎月25日", [("duration", "10day", True), ("duration", "5business_day", True), ("number", "25", True)]),
        ("10〜20万円", [("money", "100000JPY", True), ("money", "200000JPY", True)]),
        ("△5%と3分の1", [("percent", "-5%", True), ("number", "3", True), ("number", "1", True)]),
        ("100Aは￥1,200", [("money", "1200JPY", True)]),
        ("", []),
    ],
)
def test_quantities_by_the_grammar(given, want):
    assert [(f.kind, f.canonical, f.valid) for f in J.quantities(given)] == want


def test_equal_amounts_meet_and_terms_stand_alone():
    assert J.quantity_terms("1万5千円") == J.quantity_terms("15,000円") == ["q:money:15000JPY"]
    assert J.salient_terms("「請求書ID」 PR2 AnswerResult S12345 カタカナ語 漢字複合語 PR2") == ["請求書ID", "PR2", "AnswerResult", "S12345", "カタカナ語", "漢字複合語"]
    assert J.salient_terms("設備の点検 ベルト 新カタカナ語") == ["ベルト"] and J.salient_terms("") == []
    assert J.folded_but_kept("①ＡＢ㈱ ｶﾞ") == "①AB㈱ ガ" and J.traced("第三条　１，２００円")[1] == ["nfkc", "thousands", "kanji_numerals"]


def test_nfkc_in_the_jvm_is_that_of_python(spark):
    import unicodedata

    texts = ["ＡＢＣ ﾊﾟｯｷﾝ ㈱ ①…", "が", "ẹ́", "ซ่อมบำรุง", "한글", "plain", "", None, "“q” – x〜"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.nfkc(F.col("t")).alias("n"), X.text_form(F.col("t")).alias("f")).collect()
    for r in rows:
        t = texts[r["i"]]
        assert r["n"] == (None if t is None else unicodedata.normalize("NFKC", t))
        assert r["f"] == (None if t is None else J.text_form(t))


def test_statistics_equal_brute_force(spark):
    rng = random.Random(1)
    rows = [(g, None if rng.random() < 0.1 else float(rng.randint(0, 30))) for g in ("a", "b", None) for _ in range(rng.randint(1, 60))]
    got = {r["g"]: r for r in S.percentiles(spark.createDataFrame(rows, "g string, v double"), ["g"], "v", [0.0, 0.1, 0.5, 0.95, 1.0]).collect()}
    for g in ("a", "b", None):
        v = [x for h, x in rows if h == g and x is not None]
        assert got[g]["n"] == len(v) and np.allclose(got[g]["p"], [np.percentile(v, 100 * q) for q in (0, 0.1, 0.5, 0.95, 1)])
    assert S.percentiles(spark.createDataFrame([], "g string, v double"), ["g"], "v", [0.5]).count() == 0
    for n, k in ((0, 0), (5, 0), (30, 11), (400, 190)):
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0
        assert abs(spark.createDataFrame([(n - k, k)], "b long, c long").select(S.mcnemar_p("b", "c")).first()[0] - exact) < 1e-9
    ups = spark.createDataFrame([(0, 10), (3, 20), (20, 20), (0, 0), (480_000, 1_000_000)], "k long, n long").select("k", "n", S.binomial_upper("k", "n").alias("u")).collect()
    for r in ups:
        if r["n"] and r["k"] < r["n"] <= 100:
            assert abs(sum(math.comb(r["n"], i) * r["u"] ** i * (1 - r["u"]) ** (r["n"] - i) for i in range(r["k"] + 1)) - 0.05) < 1e-9
    assert [r["u"] for r in ups[2:4]] == [1.0, 1.0] and 0.48 < ups[4]["u"] < 0.482
    points = [(g, float(x), float(rng.random() < x / 20)) for g in "ab" for x in range(20) for _ in range(3)]
    fit = {(r["g"], r["x"]): r["fitted"] for r in S.isotonic(spark.createDataFrame(points, "g string, x double, y double"), "g", "x", "y", parts=5).collect()}
    for g in "ab":
        m = [np.mean([y for h, x, y in points if h == g and x == i]) for i in range(20)]
        want = [max(min(np.mean(m[a : b + 1]) for b in range(i, 20)) for a in range(i + 1)) for i in range(20)]
        assert np.allclose([fit[g, float(i)] for i in range(20)], want, atol=1e-6)
    model = spark.createDataFrame([("a", 1.0, 0.1), ("a", 2.0, 0.4)], "g string, x double, fitted double")
    asked = spark.createDataFrame([("a", 0.5), ("a", 1.5), ("a", 9.0), ("z", 1.0)], "g string, x double")
    assert {(r["g"], r["x"]): r["fitted"] for r in S.isotonic_predict(model, asked, "g", "x").collect()} == {("a", 0.5): 0.1, ("a", 1.5): 0.1, ("a", 9.0): 0.4, ("z", 1.0): None}
    front = spark.createDataFrame([(i, rng.randint(0, 9), rng.randint(0, 9)) for i in range(60)] + [(99, None, 3)], "k int, m int, l int")
    rows = [r for r in front.collect() if r["m"] is not None]
    want = {r["k"] for r in rows if not any(o["m"] >= r["m"] and o["l"] <= r["l"] and (o["m"] > r["m"] or o["l"] < r["l"]) for o in rows)}
    assert {r["k"] for r in S.pareto_front(front, "k", "m", "l").collect()} == want
    assert S.sign_flip(spark.createDataFrame([], "k long, x double"), "k", "x").collect()[0]["p"] is None
    assert S.sign_flip(spark.createDataFrame([(i, 1.0) for i in range(40)], "k long, x double"), "k", "x").first()["p"] < 0.01


def test_business_seconds_of_equal_rows_stay_apart(spark):
    import datetime as dt

    a, b = dt.datetime(2024, 1, 5, 20), dt.datetime(2024, 1, 8, 9)
    rows = spark.createDataFrame([(a, b), (a, b), (b, a), (None, b)], "s timestamp_ntz, e timestamp_ntz")
    assert sorted((r["business"] for r in L.business_seconds(rows, "s", "e").collect()), key=lambda x: -1 if x is None else x) == [None, 0.0, 7200.0, 7200.0]


def test_review_queue_and_records(spark):
    chats = spark.createDataFrame([("t1", "r1", "answered", 1, 1), ("t1", "r2", "no_answer", 2, 2), (" ", "r3", "no_answer", 3, 3), ("t2", "r4", "candidates_only", 4, 4), ("t3", "r5", "candidates_only", 5, 5)], "token string, request string, mode string, at int, tie int")
    said = spark.createDataFrame([("t1", "bad", "x", 5, 1), ("t1", "bad", "x", 6, 2), ("t1", "bad", None, 7, 3), ("t2", "human_review", None, 8, 4), ("t9", "bad", None, 9, 5), (None, "bad", "x", 9, 6), ("t3", "good", None, 9, 7)], "token string, kind string, selected string, at int, tie int")
    got = {(r["token"], r["request"], r["reason"], r["priority"]) for r in V.review_queue(chats, said).collect()}
    assert got == {("t1", "r1", "bad_with_selection", "high"), ("t1", "r1", "bad_without_selection", "medium"), ("t2", "r4", "human_review", "high"), ("t1", "r2", "no_answer", "medium"), (None, "r3", "no_answer", "medium"), ("t3", "r5", "candidates_only", "low")}
    records = spark.createDataFrame([("a", "t1", "x"), ("b", "q", "t3"), ("c", None, None)], "id string, request string, trace string")
    judged = spark.createDataFrame([("a", "wrong", 1, 1), ("a", "correct", 2, 1)], "id string, verdict string, at int, tie int")
    out = {r["id"]: (r["feedback"], r["verdict"]) for r in V.joined_records(records, said, judged).collect()}
    assert out == {"a": ("bad", "correct"), "b": ("good", None), "c": (None, None)}
    assert V.review_queue(chats.limit(0), said.limit(0)).count() == 0


def test_lifts_follow_evidence(spark):
    cols = "q long, doc long, rank long, faq boolean, procedure boolean, other boolean, n_terms int, " + ", ".join(f"{h} long" for h in V.HITS)
    row = lambda doc, rank, **h: (1, doc, rank, False, False, False, 3, *[h.get(k, 0) for k in V.HITS])
    df = spark.createDataFrame([row(1, 1), row(2, 2, kanji=1), row(3, 3, ids=1, kanji=1, title=1), row(4, 4, quoted=2, ids=1), row(5, 5)], cols)
    got = {r["doc"]: (r["lift"], r["new_rank"]) for r in V.lifted(df, "n_terms").collect()}
    assert got == {1: (0, 3), 2: (0, 4), 3: (3, 2), 4: (3, 1), 5: (0, 5)}


def test_binary_metrics_and_gain(spark):
    run = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 1, "z")], "q long, rank long, item string")
    rel = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (1, " "), (2, "y"), (3, None)], "q long, item string")
    got = {r["q"]: r for r in M.binary_at_k(run, rel, 3).collect()}
    assert set(got) == {1, 2} and got[2]["hit"] == got[2]["ndcg"] == got[2]["mrr"] == 0
    assert abs(got[1]["ndcg"] - (1 + 0.5) / (1 + 1 / math.log2(3))) < 1e-6
    gain = {r["q"]: (r["gain"], r["dropped"]) for r in M.rerank_gain(run, run.filter("rank > 2"), rel.filter("item is not null")).collect()}
    assert gain == {1: (-2, False), 2: (None, False)}


def test_ingest_cleaning_and_day_files(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x", None, None, None, None, "s"), ("b", " ", None, None, None, None, "s"), ("c", "y", "Parent", " ", [3, 5], 0, "s"), (None, "z", None, None, None, None, "s")], "id string, text string, chunk_role string, tenant_id string, source_pages array<int>, searchable int, source_doc string")
    got = {r["id"]: (r["tenant_id"], r["searchable"], r["source_pages"], r["page_start"], r["page_end"]) for r in G.ingest_rows(rows, "g").collect()}
    assert got == {"a": ("default", 1, [-1], None, None), "c": ("default", 0, [3, 5], 3, 5)} and G.ingest_rows(rows, "g", False).count() == 1
    assert G.set_hash(rows, ["id", "text"]).first() == G.set_hash(rows.orderBy(F.desc("id")), ["id", "text"]).first() and G.set_hash(rows.limit(0), ["id"]).first()["digest"] == "0"
    docs = spark.createDataFrame([(i, "d", f"page {i}\nbody {i % 2} long enough to stay where it is, whatever the page says of it\nend") for i in range(6)] + [(9, None, "x"), (10, "e", None)], "p long, d string, t string")
    out = {r["p"]: (r["cleaned"], r["removed"]) for r in G.cleaned(docs, "p", "d", "t").collect()}
    assert out[0] == ("body 0 long enough to stay where it is, whatever the page says of it", 2) and out[9] == ("x", 0) and out[10][0] is None
    root = str(tmp_path / "log")
    lines = spark.createDataFrame([("2024-01-01", '{"n": 1}'), ("2024-01-02", '{"n": 2}'), ("2024-01-02", "{cut"), ("2024-01-04", '{"n": 4}')], "day string, line string")
    store.write_days(lines, root, "day", "line")
    schema = T.StructType([T.StructField("n", T.LongType())])
    read = store.read_days(spark, root, schema, "2024-01-04", 3).cache()
    assert sorted((str(r["dt"]), r["n"] or 0, r["malformed"] or "") for r in read.collect()) == [("2024-01-02", 0, "{cut"), ("2024-01-02", 2, ""), ("2024-01-04", 4, "")]


def test_search_by_codes_and_tenants(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16))
    rows = [(i, [float(x) for x in v[i]], "ab"[i % 2]) for i in range(300)] + [(900, [0.0] * 16, "a"), (901, [], "a"), (902, None, "b")]
    docs = spark.createDataFrame(rows, "doc long, v array<double>, tenant string")
    asked = docs.filter("doc % 20 = 0 and doc < 300").withColumnRenamed("doc", "q")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {i: [int(j) for j in np.lexsort((np.arange(300), -np.round(unit[i] @ unit.T, 6)))[:10]] for i in range(0, 300, 20)}
    for f, least in ((R.int8_topk, 0.9), (partial(R.binary_topk, oversample=16), 0.9)):
        got = f(docs.drop("tenant"), asked.drop("tenant"), 10).collect()
        assert len(got) == 150 and sum(r["doc"] in want[r["q"]] for r in got) >= least * 150
    own = R.dense_topk(docs, asked, 5).collect()
    assert len(own) == 75 and all(r["doc"] % 2 == r["q"] % 2 for r in own)
    assert [r["doc"] for r in sorted(R.dense_topk(docs.drop("tenant"), asked.drop("tenant"), 10).collect(), key=lambda r: (r["q"], r["rank"]))] == [j for i in sorted(want) for j in want[i]]
    assert R.int8_topk(docs, asked.limit(0), 3).count() == 0


def test_short_keys_match_where_they_may(spark):
    a = spark.createDataFrame([(1, "弁の点検手順"), (2, None), (3, "")], "q long, t string")
    b = spark.createDataFrame([(7, "弁の点検手順は"), (8, "ベルト")], "key long, t string")
    assert K.near_matches(a, b, "q", "key", "t").count() == 0
    assert [(r["q"], r["key"]) for r in K.near_matches(a, b, "q", "key", "t", least_chars=4).collect()] == [(1, 7)]


def test_nearest_by_prefix_filter_equals_all_pairs(spark):
    rng = random.Random(6)
    say = lambda: "".join(rng.choice("弁軸受清掃") for _ in range(rng.randint(0, 12)))
    asked, known = [(i, say()) for i in range(40)] + [(99, None)], [(i, say()) for i in range(80)]
    for least in (0.4, 0.7):
        got = {r["q"]: (r["key"], r["jaccard"]) for r in RC.nearest_by_bigrams(spark.createDataFrame(asked, "q long, t string"), spark.createDataFrame(known, "key long, t string"), "q", "key", "t", least).collect()}
        grams = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
        want = {}
        for q, s in asked:
            best = [(-round(len(grams(s) & grams(t)) / len(grams(s) | grams(t)), 6), k) for k, t in known if s and grams(s) and grams(t)]
            best = [x for x in best if -x[0] >= least]
            if best:
                want[q] = (min(best)[1], -min(best)[0])
        assert got == want


def _shuffled(spark) -> int:
    """Records that the stages of this session have written to shuffles so far."""
    sc = spark.sparkContext
    jvm = sc._jvm
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(jvm.java.util.ArrayList(), False, False, sc._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def _alike(rng, n: int) -> list[str]:
    """Texts of one template, as questions are: all share most bigrams."""
    return [f"試作ラインで停止したあとに動かす{rng.choice('ABC')}{rng.randint(0, 999)}号機を止めずに{rng.choice(['清掃', '点検', '記録'])}できる範囲は" for _ in range(n)]


def _jaccard(s: str, t: str) -> float:
    a, b = ({x[i : i + 2] for i in range(len(x) - 1)} for x in (s.lower(), t.lower()))
    return round(len(a & b) / len(a | b), 6)


def test_nearest_of_texts_that_are_all_alike_moves_no_pairs(spark):
    rng = random.Random(3)
    asked, known = list(enumerate(_alike(rng, 60))), list(enumerate(_alike(rng, 1500)))
    before = _shuffled(spark)
    got = {r["q"]: (r["key"], r["jaccard"]) for r in RC.nearest_by_bigrams(spark.createDataFrame(asked, "q long, t string"), spark.createDataFrame(known, "key long, t string"), "q", "key", "t", 0.5).collect()}
    assert _shuffled(spark) - before < 10_000  # of 90,000 pairs
    best = {q: min((-_jaccard(s, t), k) for k, t in known) for q, s in asked}
    assert got == {q: (k, -x) for q, (x, k) in best.items()}


def test_most_alike_with_marks_and_flags_equals_all_pairs(spark):
    rng = random.Random(4)
    asked, known = _alike(rng, 60) + ["", "号"], _alike(rng, 1500)
    known = [t + rng.choice(["", "", "ない"]) for t in known[:-1]] + [None] + known[:20]
    numbers = lambda c: F.regexp_extract_all(F.col(c), F.lit("[0-9]+"), F.lit(0))
    before = _shuffled(spark)
    a, b = spark.createDataFrame(list(enumerate(asked)), "q long, t string"), spark.createDataFrame(list(enumerate(known)), "key long, t string")
    for block_chars in (10_000_000, 500):
        got = sorted((r["q"], r["rank"], r["key"], r["score"]) for r in B.most_alike(a, b, "q", "key", "t", 0.4, 5, numbers, lambda c: F.col(c).contains("ない"), 0.08, 0.04, block_chars).collect())
        want = []
        for q, s in enumerate(asked):
            rows = [(_jaccard(s, t), t, k) for k, t in enumerate(known) if t and len(s) > 1]
            scored = sorted((-round(x + 0.08 * bool(set(re.findall("[0-9]+", s)) & set(re.findall("[0-9]+", t))) - 0.04 * (("ない" in s) != ("ない" in t)), 6), k) for x, t, k in rows if x >= 0.4)
            want += [(q, i, k, -x) for i, (x, k) in enumerate(scored[:5], 1)]
        assert got == want
    assert _shuffled(spark) - before < 60_000  # of 90,000 pairs, twice


def test_orphans_of_a_hot_key(spark, monkeypatch):
    import datetime as dt
    monkeypatch.setattr(O, "salted_join", partial(O.salted_join, hot_rows=5))
    t = dt.datetime(2024, 1, 5)
    refs = [("a", "f", f"r{i}", "x", "gone" if i % 3 else f"k{i}", t) for i in range(60)] + [("a", "f", "n", "x", "gone", None)]
    parents = [("x", f"k{i}", t - dt.timedelta(days=1 if i % 2 else -1)) for i in range(60)]
    cols = "ref_table string, ref_field string, record_id string, target string, ref_key string, at timestamp"
    found = O.orphan_references(spark.createDataFrame(refs, cols), spark.createDataFrame(parents, "target string, key string, at timestamp"), spark.createDataFrame([], "target string, key string, at timestamp")).collect()
    states = {(r["record_id"], r["orphan_state"]) for r in found}
    assert states == {(f"r{i}", "missing") for i in range(60) if i % 3} | {("n", "missing")} | {(f"r{i}", "late") for i in range(0, 60, 6)}
    assert len(found) == len(states)


def test_intermediates_can_be_released(spark):
    df = tables.materialize(spark.range(3).toDF("n"), "test")
    path = next(p for p in tables._written if "hibiki-test-" in p)
    assert df.count() == 3 and tables.release(path) == 1 and path not in tables._written


def test_two_ranges_of_places(spark):
    runs = list(itertools.product((1, 2), (1, 2, 3)))
    df = spark.createDataFrame([(q, d, 1.0 / d) for q, d in runs], "q long, doc long, s double")
    assert R.ranked(df, F.desc("s"), k=2).count() == 4
