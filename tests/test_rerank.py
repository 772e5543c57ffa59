from pyspark.sql import functions as F

from hibiki.operators import rerank as K


def test_near_matches(spark):
    base = "北倉庫で動かす機械の軸受を交換する手順を教えて"
    asked = spark.createDataFrame([(1, base), (2, base + "ください。"), (3, "短い"), (4, None), (5, base * 2)], "q long, t string")
    known = spark.createDataFrame([(7, base + "くださ"), (8, "全く別の長い長い長い長い長い長い文章です")], "key long, t string")
    assert sorted((r["q"], r["key"]) for r in K.near_matches(asked, known, "q", "key", "t").collect()) == [(1, 7), (2, 7)]
    assert K.near_matches(asked.limit(0), known, "q", "key", "t").count() == 0


def test_merged_neighbours(spark):
    hits = spark.createDataFrame([(1, "d", 10, 1, 500), (1, "e", 11, 2, 100), (1, "d", 12, 3, 600), (1, "d", 13, 4, 300), (1, "d", 14, 5, 100)], "q long, doc string, chunk long, rank long, chars long")
    got = [(r["doc"], r["first_rank"], r["members"], r["chars"]) for r in K.merge_neighbours(hits, 1200).orderBy("first_rank").collect()]
    assert got == [("d", 1, [10, 12], 1100), ("e", 2, [11], 100), ("d", 4, [13, 14], 400)]


def test_field_scores_and_boost(spark):
    df = spark.createDataFrame([(1, 1, ["a", "b"], "xa", None), (1, 2, ["a", "b"], "ab", "b"), (1, 3, [], "a", "a")], "q long, rank int, t array<string>, f string, g string")
    s = df.withColumn("s", K.field_score(F.col("t"), [(F.col("f"), 0.5), (F.col("g"), 0.2)], 0.9))
    assert [r["s"] for r in s.orderBy("rank").collect()] == [0.5, 0.9, 0.0]
    assert [r["new_rank"] for r in K.boosted(s, F.col("s")).orderBy("rank").collect()] == [2, 1, 3]


def test_unsupported_terms(spark):
    df = spark.createDataFrame([("AB-12 は 3.5 mm", "ab-12"), ("なし", None), (None, "x")], "c string, e string")
    assert [r[0] for r in df.select(K.unsupported(F.col("c"), F.col("e"))).collect()] == [["3.5"], [], None]


def test_rater_agreement(spark):
    rows = [(d, r, v) for d in range(10) for r, v in (("a", d % 2), ("b", d % 2), ("c", (d + 1) % 2))] + [(99, "a", None), (98, "a", 1)]
    got = {r["r"]: r for r in K.agreement(spark.createDataFrame(rows, "d int, r string, v int"), "d", "r", "v").collect()}
    assert got["c"]["n"] == 10 and got["c"]["kappa"] == -1.0 and "a" not in got  # a's others disagree
    assert K.feedback_adjustments(spark.createDataFrame([("x", "good")] * 9 + [("y", "bad"), (None, "bad"), ("z", "?")], "k string, s string"), "k", "s", {"good": 0.03, "bad": -0.06}).orderBy("k").collect() == [("x", 9, 0.05), ("y", 1, -0.06), ("z", 1, 0.0)]
