"""Retrieval metrics. run: q, rank, item (one row per place). qrels: q, item, grade (one row per relevant item)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def credit(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(q, item, grade, rank): each relevant item credited once, at its first rank; items not found have no row."""
    return qrels.join(run, ["q", "item"]).groupBy("q", "item", "grade").agg(F.min("rank").alias("rank"))


def at_k(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(q, n_relevant, hit, recall, mrr, ndcg) at k of every query that has relevant items; gains 2^grade - 1."""
    gain, discount = F.pow(F.lit(2.0), "grade") - 1, F.log2(F.col("place") + 1)
    found = credit(run.filter(F.col("rank") <= k), qrels)
    got = found.select("q", "grade", F.col("rank").alias("place")).groupBy("q").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.sum(gain / discount).alias("dcg"))
    best = qrels.withColumn("place", F.row_number().over(W.partitionBy("q").orderBy(F.desc("grade"), "item")))
    ideal = best.groupBy("q").agg(F.count("*").alias("n_relevant"), F.sum(F.when(F.col("place") <= k, gain / discount)).alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "q", "left").select(
        "q",
        "n_relevant",
        zero((F.col("n") > 0).cast("double")).alias("hit"),
        F.round(zero(F.col("n") / F.col("n_relevant")), 6).alias("recall"),
        F.round(zero(1 / F.col("first")), 6).alias("mrr"),
        F.round(zero(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"),
    )


def summary(per_query: DataFrame, *by: str) -> DataFrame:
    """Means of at_k over all queries of each group."""
    return per_query.groupBy(*by).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit", "recall", "mrr", "ndcg")])


def paired_changes(a: DataFrame, b: DataFrame, metric: str) -> DataFrame:
    """(state, n): queries improved, worsened and unchanged from run a to run b, and those of one run only."""
    both = a.select("q", F.col(metric).alias("x")).join(b.select("q", F.col(metric).alias("y")), "q", "full")
    state = F.when(F.col("x").isNull(), "only_b").when(F.col("y").isNull(), "only_a").when(F.col("y") > F.col("x"), "improved").when(F.col("y") < F.col("x"), "worsened").otherwise("unchanged")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def binary_at_k(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(q, hit, mrr, ndcg) with relevance yes or no, of every query with relevant items: a miss counts as 0, not as nothing.

    An item retrieved twice is credited once, at its first place; labels that are repeated or blank count once or not.
    """
    wanted = qrels.filter(F.col("item").isNotNull() & (F.trim(F.col("item").cast("string")) != "")).select("q", "item").distinct()
    found = wanted.join(run.filter(F.col("rank") <= k), ["q", "item"]).groupBy("q", "item").agg(F.min("rank").alias("rank"))
    got = found.groupBy("q").agg(F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    gains = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    ideal = wanted.groupBy("q").agg(F.count("*").alias("n")).select("q", gains.alias("idcg"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return ideal.join(got, "q", "left").select("q", zero(F.col("first").isNotNull().cast("double")).alias("hit"), F.round(zero(1 / F.col("first")), 6).alias("mrr"), F.round(zero(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"))


def rerank_gain(before: DataFrame, after: DataFrame, qrels: DataFrame) -> DataFrame:
    """(q, before, after, gain, dropped): the best rank of a relevant item in two runs; gain is null where one has none."""
    best = lambda run, n: qrels.select("q", "item").distinct().join(run, ["q", "item"]).groupBy("q").agg(F.min("rank").alias(n))
    out = qrels.select("q").distinct().join(best(before, "before"), "q", "left").join(best(after, "after"), "q", "left")
    return out.select("q", "before", "after", (F.col("before") - F.col("after")).alias("gain"), (F.col("before").isNotNull() & F.col("after").isNull()).alias("dropped"))
