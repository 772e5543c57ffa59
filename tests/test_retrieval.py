import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hibiki.operators import metrics as M
from hibiki.operators import retrieval as R


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(0, ["a", "b"]), (1, ["a"]), (2, ["c"]), (3, []), (4, None)], "doc long, tokens array<string>")
    queries = spark.createDataFrame([(7, ["a", "a", "z"]), (8, []), (9, None)], "q long, tokens array<string>")
    got = {r["doc"]: r["bm25"] for r in R.lanes(docs, queries, k1=1.2).collect()}
    idf, mean = math.log(1 + (5 - 2 + 0.5) / 2.5), 4 / 4
    want = {d: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * n / mean)) for d, n in ((0, 2), (1, 1))}
    assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 2e-6 for d in want)
    assert R.lanes(docs.limit(0), queries).count() == 0 and R.lanes(docs, queries.limit(0)).count() == 0


def test_lanes_in_blocks_and_batches_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(30)] + ["ab-12", "x99z"]
    docs = [(i, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for i in range(300)]
    queries = [(q, [rng.choice(words) for _ in range(4)]) for q in range(23)]
    ddf, qdf = spark.createDataFrame(docs, "doc long, tokens array<string>"), spark.createDataFrame(queries, "q long, tokens array<string>")
    n, mean = len(docs), sum(len(t) for _, t in docs) / len(docs)
    df = {w: sum(w in t for _, t in docs) for w in words}
    want = {}
    for q, qt in queries:
        rows = []
        for d, t in docs:
            hit = set(qt) & set(t)
            if hit:
                s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in hit)
                rows.append((-round(s, 6), d))
        want[q] = [d for _, d in sorted(rows)[:5]]
    out = R.ranked(R.lanes(ddf, qdf, keep=5, block=7, batch_docs=11), F.col("bm25").desc(), F.col("doc"), k=5).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["q"], r["rank"])):
        got.setdefault(r["q"], []).append(r["doc"])
    assert got == {q: v for q, v in want.items() if v}


def lane(spark, rows):
    return spark.createDataFrame(rows, "q long, doc string, score double, rank long, distance double")


def test_rrf_prefers_exact_hits(spark):
    lanes = R.union_lanes({"dense": lane(spark, [(1, "A", 0.9, 1, 0.1), (1, "B", 0.8, 2, 0.2)]), "keyword": lane(spark, [(1, "B", 3.0, 1, 0.25), (1, "C", 2.0, 2, 0.27)]), "exact": lane(spark, [(1, "C", 1.0, 1, 0.25)])})
    fused = R.rrf(lanes, F.when(F.col("lane") == "exact", 2.0).otherwise(1.0), 10)
    assert [r["doc"] for r in fused.orderBy(F.desc("fused")).collect()] == ["C", "B", "A"]


def test_dbsf_of_single_and_flat_lanes(spark):
    lanes = R.union_lanes({"dense": lane(spark, [(1, "A", 0.9, 1, 0.1)]), "keyword": lane(spark, [(1, "B", 2.0, 1, 0.3), (1, "C", 2.0, 2, 0.3)])})
    assert {r["doc"]: r["fused"] for r in R.dbsf(lanes).collect()} == {"A": 0.5, "B": 0.5, "C": 0.5}


def test_hybrid_keeps_a_dense_hit(spark):
    lanes = R.union_lanes({"dense": lane(spark, [(1, "Z", 0.9, 9, 0.1)]), "keyword": lane(spark, [(1, d, 1.0, i + 1, 0.3) for i, d in enumerate("ABC")])})
    top = R.hybrid_topk(lanes, R.rrf(lanes, F.lit(1.0)), 2).orderBy("rank").collect()
    assert [(r["doc"], r["rank"]) for r in top] == [("A", 1), ("Z", 2)]


def test_dense_topk_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 5))
    rows = [(i, [float(x) for x in r]) for i, r in enumerate(v)] + [(90, None), (91, []), (92, [0.0] * 5)]
    df = spark.createDataFrame(rows, "doc long, v array<double>")
    q = df.filter("doc % 20 = 0").select(F.col("doc").alias("q"), "v")
    got = {(r["q"], r["rank"]): r["doc"] for r in R.dense_topk(df, q, 3, block=2).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in (0, 20, 40):
        best = sorted(range(60), key=lambda j: (-round(float(unit[i] @ unit[j]), 6), j))[:3]
        assert [got[(i, k)] for k in (1, 2, 3)] == best
    assert R.dense_topk(df, q.limit(0)).count() == 0


def test_int8_recall(spark, data):
    from hibiki.plans import retrieval as P

    assert P.m7_int8_recall(spark, data).first()["recall"] >= 0.9


def test_context_cut_and_diversity(spark):
    df = spark.createDataFrame([(1, d, r, p, 60) for r, (d, p) in enumerate((("a", "x"), ("b", "x"), ("c", None), ("d", None), ("e", "x")), 1)], "q long, doc string, rank long, page string, chars int")
    assert [r["doc"] for r in R.diverse(df, "page", 1).orderBy("rank").collect()] == ["a", "c", "d"]
    assert [r["doc"] for r in R.context_cut(df, "chars", 100).orderBy("rank").collect()] == ["a", "b"]


def test_metrics_known_values(spark):
    run = spark.createDataFrame([(1, r, x) for r, x in enumerate("cba", 1)] + [(2, 1, "n")], "q long, rank long, item string")
    qrels = spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "z", 1)], "q long, item string, grade int")
    got = {r["q"]: r for r in M.at_k(run, qrels, 3).collect()}
    assert got[1]["ndcg"] == pytest.approx(0.6934264036172708, abs=1e-6) and got[1]["mrr"] == 0.5 and got[1]["recall"] == 1
    assert got[2]["hit"] == 0 and got[2]["ndcg"] == 0
    again = spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], "q long, rank long, item string")
    assert M.credit(again, qrels).collect()[0]["rank"] == 1


def test_parents_and_neighbours(spark):
    chunks = spark.createDataFrame([("p", None), ("c1", "p"), ("c2", "p"), ("o", "gone")], "chunk string, parent string")
    hits = spark.createDataFrame([(1, "c1", 0.4), (1, "c2", 0.2), (1, "o", 0.3)], "q long, chunk string, score double")
    assert {r["chunk"]: r["score"] for r in R.expand_parents(hits, chunks).collect()} == {"p": 0.2, "o": 0.3}
    near = spark.createDataFrame([("d", i) for i in range(4)], "doc string, chunk_index int")
    seeds = spark.createDataFrame([(1, "d", 0, 0.5), (1, "d", 2, 0.1)], "q long, doc string, chunk_index int, score double")
    assert {r["chunk_index"]: r["score"] for r in R.expand_neighbours(seeds, near).collect()} == {0: 0.5, 1: 0.11, 2: 0.1, 3: 0.11}
