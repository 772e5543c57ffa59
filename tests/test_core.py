import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hibiki.functions import chunking as C
from hibiki.functions import japanese as J
from hibiki.functions import text as X
from hibiki.functions.salting import salted_join
from hibiki.operators import logs as L
from hibiki.operators import orphans as O
from hibiki.operators import reconcile as RC
from hibiki.operators import stats as S
from hibiki.sources import store


@pytest.mark.parametrize("given, want", [("１万", "10000"), ("1万5千", "15000"), ("3.5億", "350000000"), ("二〇二四", "2024"), ("十百", None), ("2.50", "2.5"), ("万億", None), ("壱拾", "10"), ("", None), ("1万2万", None), ("千", "1000")])
def test_numbers(given, want):
    v = J.number(given)
    assert (None if v is None else J.plain(v)) == want


@pytest.mark.parametrize("given, profile, want", [("第三条　１，２００円", "index", "第3条 1200円"), ("  alpha　 beta ", "display", "alpha beta"), ("ＡＢＣ", "dense", "ABC"), ("サ-バ", "index", "サーバ"), ("サーバー", "match", "サーバ")])
def test_profiles(given, profile, want):
    assert J.normalized(given, profile) == want
    assert J.normalized(want, profile) == want


@pytest.mark.parametrize(
    "given, want",
    [
        ("15,000円", [("money", "15000JPY", True)]),
        ("10%", [("percent", "10%", True)]),
        ("第三条", [("article", "3条", True)]),
        ("二人", [("count", "2人", True)]),
        ("2024年4月5日", [("date", "2024-04-05", True)]),
        ("平成31年5月1日", [("date", "2019-05-01", False)]),
        ("令和6年度の午後3時30分", [("fiscal_year", "FY2024", True), ("time", "15:30", True)]),
        ("10〜20万円", [("money", "100000JPY", True), ("money", "200000JPY", True)]),
        ("ZZ-10は十分で一般", []),
        ("", []),
    ],
)
def test_quantities(given, want):
    assert [(f[0], f[1], f[6]) for f in J.quantities(given)] == want


def test_arrow_functions_keep_nulls(spark):
    df = spark.createDataFrame([("三人と2kg",), (None,), ("",)], "t string")
    rows = df.select(J.quantities_of("t").alias("q"), J.number_text("t").alias("n"), C.chunks_of("t").alias("c"), J.salient_of("t").alias("s")).collect()
    assert [x["canonical"] for x in rows[0]["q"]] == ["3人", "2kg"] and rows[1]["q"] is None and rows[2]["q"] == [] and rows[1]["c"] is None and rows[2]["c"] == []


def test_chunking():
    text = "一文目です。二文目です。\n\n" + "長い文です。" * 200 + "\n\n終わり。"
    chunks = C.target_chunks(text, 100, 20, 10)
    assert all(len(c) <= 125 for c in chunks) and "".join(chunks).replace("\n", "") == text.replace("\n", "")
    assert C.target_chunks("") == [] and C.sentence_windows("") == []
    assert C.sentence_windows("あい。うえ。おか。きく。", 6, 0.5) == ["あい。うえ。", "うえ。おか。", "おか。きく。"]
    assert C.faq_pairs("Q: 何か\n続き\nA: 答え\nQ: 空") == [("何か続き", "答え")]
    assert C.table_rows("a|b\n1|2\n3|", "t") == ["t / a=1 / b=2", "t / a=3"]
    assert C.join_wrapped("これは途中で切れた\n文です。\n・項目") == "これは途中で切れた文です。\n・項目"


def test_text_functions_and_edges(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",), ("軸受 AB-12 「点検」",)], "t string")
    r = df.select(X.heuristic_tokens(F.col("t")).alias("k"), X.char_bigrams(F.col("t")).alias("g"), X.fixed_windows(F.col("t"), 4, 1).alias("w"), X.is_garbled(F.col("t")).alias("b")).collect()
    assert r[0]["k"] is None and r[0]["g"] is None and r[0]["w"] is None and r[0]["b"] is None
    assert r[1]["g"] == [] and r[1]["w"] == [] and r[1]["b"] is True and r[2]["g"] == []
    assert r[3]["k"][:3] == ["点検", "ab-12", "軸受"]
    with pytest.raises(ValueError):
        X.fixed_windows(F.col("t"), 4, 4)


def test_long_texts_are_linear(spark):
    import time

    df = spark.createDataFrame([("軸受点検" * 20_000,)], "t string")
    start = time.time()
    assert df.select(F.size(X.heuristic_tokens(F.col("t"))).alias("n")).first()["n"] > 3
    assert time.time() - start < 20


def test_statistics_known_values(spark):
    one = spark.createDataFrame([(0, 5), (0, 0), (3, 3)], "b int, c int").select(F.round(S.mcnemar_p("b", "c"), 6).alias("p")).collect()
    assert [r["p"] for r in one] == [0.0625, 1.0, 1.0]
    p = spark.createDataFrame([("f", "a", 0.01), ("f", "b", 0.04), ("f", "c", 0.03)], "f string, k string, p double")
    assert {r["k"]: r["adjusted"] for r in S.holm(p, "f", "k", "p").collect()} == {"a": 0.03, "b": 0.06, "c": 0.06}
    assert {r["k"]: r["adjusted"] for r in S.benjamini_hochberg(p, "f", "k", "p").collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}
    x = spark.createDataFrame([(float(i % 10),) for i in range(100)], "v double")
    assert S.psi(x, x, "v").first()["psi"] == 0 and S.ks(x, x, "v").first()["d"] == 0
    iso = spark.createDataFrame([("g", 0.2, 0.0), ("g", 0.2, 1.0), ("g", 0.3, 1.0), ("g", 0.4, 1.0)], "g string, x double, y double")
    assert sorted((r["x"], r["fitted"]) for r in S.isotonic(iso, "g", "x", "y").collect()) == [(0.2, 0.5), (0.3, 1.0), (0.4, 1.0)]
    c = spark.createDataFrame([(i / 10,) for i in range(1, 5)], "s double")
    assert S.conformal_threshold(c, "s", 0.4).first()["threshold"] == 0.3 and S.conformal_threshold(c, "s", 0.01).first()["threshold"] is None
    front = spark.createDataFrame([(1, 5, 2.0), (2, 5, 2.0), (3, 4, 1.0), (4, 4, 3.0), (5, 3, 1.0)], "k int, m int, l double")
    assert sorted(r["k"] for r in S.pareto_front(front, "k", "m", "l").collect()) == [1, 2, 3]


def test_running_sums_with_ties(spark):
    df = spark.createDataFrame([(i // 3,) for i in range(300)], "x int")
    got = S.running_sums(df, F.col("x"), {"n": F.lit(1)}).distinct().collect()
    assert {r["x"]: r["n"] for r in got} == {i: 3 * (i + 1) for i in range(100)}


def test_salted_join_loses_nothing(spark):
    many = spark.createDataFrame([("hot", i) for i in range(500)] + [("cold", 900), (None, 901)], "k string, id int")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    got = salted_join(many, one, ["k"], "n", "id", hot_rows=50, salts=7).collect()
    assert sorted(r["id"] for r in got) == [*range(500), 900] and {r["m"] for r in got} == {499, 900}


def brute_orphans(refs, parents, tombstones):
    out = set()
    for table, field, record, target, key, at in refs:
        if key is None or not key.strip():
            continue
        versions = [v or dt.datetime.min for t, k, v in parents if (t, k) == (target, key)]
        month = at.strftime("%Y-%m") if at else None
        if not versions:
            state = "missing"
        elif at is None:
            continue
        else:
            known = [v for v in versions if v <= at]
            gone = [x for t, k, x in tombstones if (t, k) == (target, key) and x and x <= at]
            state = "late" if not known else "deleted" if gone and max(gone) > max(known) else None
        if state:
            out.add((table, field, record, key, state, month))
    return out


def test_orphans_equal_brute_force(spark):
    rng = random.Random(8)
    day = lambda: dt.datetime(2026, 1, 1) + dt.timedelta(hours=rng.randint(0, 24 * 150))
    keys = [f"k{i}" for i in range(40)]
    parents = [("t", rng.choice(keys[:32]), day()) for _ in range(60)] + [("t", "k1", None), ("u", "k0", day()), ("t", None, day())]
    tombs = [("t", rng.choice(keys), day()) for _ in range(40)] + [("t", "k2", None)]
    refs = [("r", "f", f"id{i}", "t", rng.choice(keys + ["K1", " k1", "", None, "　"]), day()) for i in range(400)] + [("r", "f", "n", "t", "k1", None), ("r", "f", "n", "t", "zz", None)] * 2
    refs += [("r", "f", f"hot{i}", "t", "k3", day()) for i in range(200)]
    refs += [("r", "f", "tie", t, k, v) for t, k, v in parents[:10]]
    rdf = spark.createDataFrame(refs, "ref_table string, ref_field string, record_id string, target string, ref_key string, at timestamp")
    pdf, tdf = spark.createDataFrame(parents, "target string, key string, at timestamp"), spark.createDataFrame(tombs, "target string, key string, at timestamp")
    rdf = rdf.withColumns({"period": F.lit(1), "key": F.lit("x"), "orphan_state": F.lit("?")})  # names of its own
    got = O.orphan_references(rdf, pdf, tdf, keys_per_bucket=7).collect()
    assert {tuple(r) for r in got} == brute_orphans(refs, parents, tombs) and len(got) == len({tuple(r) for r in got})
    assert O.orphan_references(rdf.limit(0), pdf, tdf).count() == 0
    assert {r["orphan_state"] for r in O.orphan_references(rdf, pdf.limit(0), tdf).collect()} == {"missing"}


def test_where_language(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "n int, s string")
    ids = lambda clause: [r["n"] for r in df.filter(store.where(clause)).orderBy("n").collect()]
    assert ids(None) == ids({}) == [1, 2, 3]
    assert ids({"s": "a"}) == [1] and ids({"s": {"$ne": "a"}}) == [2, 3] and ids({"s": {"$nin": ["a"]}}) == [2, 3]
    assert ids({"$or": [{"n": {"$gte": 3}}, {"$and": [{"n": {"$lt": 2}}, {"s": {"$in": ["a", "b"]}}]}]}) == [1, 3]
    for bad in ({"$not": 1}, {"n": {"$like": 1}}, {"$and": []}):
        with pytest.raises(ValueError):
            store.where(bad)


def test_where_reaches_the_scan(spark, data):
    plan = spark.read.parquet(f"{data}/semantic_challenge_v2_chunks.parquet").filter(store.where({"searchable": 1})).select("row_no")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<row_no:bigint,searchable:int>" in plan


def test_store_and_logs(spark, tmp_path):
    old = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    new = spark.createDataFrame([(2, "z", 9), (3, "w", 9)], "id int, v string, extra int")
    assert sorted((r["id"], r["v"], r["extra"]) for r in store.upsert(old, new, ["id"]).collect()) == [(1, "x", None), (2, "z", 9), (3, "w", 9)]
    assert [r["id"] for r in store.delete(old, new, ["id"]).collect()] == [1]
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "甲"}\n\n{bad\n{"id": "2", "text": " "}\n{"id": "3"}\n')
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())])
    log = store.read_log(spark, f"file://{tmp_path}/a.jsonl", schema)
    assert [r["malformed"] for r in log.collect() if r["malformed"]] == ["{bad"]
    assert [r["id"] for r in store.read_chunks(spark, f"file://{tmp_path}/a.jsonl", schema).collect()] == ["1"]


@pytest.mark.parametrize("encoding, delimiter", list(itertools.product(["utf-8", "utf-8-sig", "cp932", "euc_jp"], ",\t;|")))
def test_csv_sniffing(spark, tmp_path, encoding, delimiter):
    path = tmp_path / "t.csv"
    path.write_bytes("".join(delimiter.join(r) + "\n" for r in (["項目", "値"], ["軸受の交換手順", "12"])).encode(encoding))
    rows = store.read_csv(spark, f"file://{path}").collect()
    assert [tuple(r) for r in rows] == [("軸受の交換手順", "12")] and rows[0].__fields__ == ["項目", "値"]


def test_store_problems(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [1.0]), (3, []), (4, None), (5, [1.0, float("nan")])], "id int, v array<double>")
    assert {r["problem"]: r["n"] for r in store.problems(df, "id", "v").collect()} == {"null key": 1, "repeated key": 1, "empty vector": 2, "other length": 1, "not finite": 1}


def test_logs(spark):
    t = lambda s: dt.datetime(2026, 1, 5, 9) + dt.timedelta(seconds=s)
    rows = [("a", i, t(s), ok) for i, (s, ok) in enumerate([(0, True), (60, False), (120, False), (200, True), (4000, True)])]
    df = spark.createDataFrame(rows, T.StructType([T.StructField("k", T.StringType()), T.StructField("i", T.IntegerType()), T.StructField("at", T.TimestampNTZType()), T.StructField("ok", T.BooleanType())]))
    r = L.availability(df, "k", "at", F.col("ok"), "i").first()
    assert (r["up"], r["down"], r["unmonitored"], r["outages"]) == (360.0, 140.0, 3500.0, 1)
    runs = L.islands(df, "k", ["at", "i"], ~F.col("ok")).select("island").collect()
    assert [x["island"] for x in runs] == [1, 1]
    spans = df.limit(1).select("k", F.lit(dt.datetime(2026, 1, 2, 20)).cast("timestamp_ntz").alias("s"), F.lit(dt.datetime(2026, 1, 5, 9)).cast("timestamp_ntz").alias("e"))
    assert L.business_seconds(spans, "s", "e").first()["business"] == 7200.0
    limited = L.rate_limited(df, "k", "at", "i", 2, 3600).orderBy("i").collect()
    assert [x["allowed"] for x in limited] == [True, True, False, False, True]


def test_diff_and_alignment(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", None)], "k string, d string")
    b = spark.createDataFrame([("y", "2"), ("z", None), ("w", "1")], "k string, d string")
    assert {r["k"]: r["change"] for r in RC.diff(a, b, "k", "d").collect()} == {"x": "deleted", "y": "modified", "z": "same", "w": "added"}
    assert tuple(RC.alignment(a, b, "k").first()) == (2, 1, 1, 0.5)
    assert tuple(RC.alignment(a.limit(0), b.limit(0), "k").first()) == (0, 0, 0, None)


def test_breaker_stream_equals_batch(spark, data, tmp_path):
    from hibiki.streaming import logs as B

    schema = "key string, event_id long, at timestamp, ok boolean"
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=20 * i), rng.random() < 0.4) for i in range(120)]
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    want = sorted(map(tuple, B.breaker_batch(spark.createDataFrame(rows, schema), 3, 60.0).collect()))
    assert {"passed", "failed", "refused"} == {r[3] for r in want}
    out = B.breaker_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), 3, 60.0)
    q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == want


def test_newest_state_store(spark, tmp_path):
    from hibiki.streaming import logs as B

    store_dir = f"file://{tmp_path}/s"
    df = lambda rows: spark.createDataFrame(rows, "k string, t int, v string")
    B.write_newest(df([("a", 1, "x"), ("b", 1, "y")]), store_dir, ["k"], ["t"])
    for _ in range(2):  # a batch delivered again changes nothing
        B.write_newest(df([("a", 3, "z"), ("b", 0, "w"), ("a", None, "n")]), store_dir, ["k"], ["t"])
    assert sorted(map(tuple, B.read_newest(spark, store_dir).collect())) == [("a", 3, "z"), ("b", 1, "y")]
