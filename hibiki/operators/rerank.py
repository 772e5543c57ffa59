"""Rescoring of ranked rows, feedback signals, near matches, claim checks and merged neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X


def field_score(terms: Column, fields: list[tuple[Column, float]], cap: float = 1.0) -> Column:
    """Sum over terms of the weight of the first field that contains the term, at most *cap*; null fields contain nothing."""

    def of(t: Column) -> Column:
        out = F.lit(0.0)
        for text, weight in reversed(fields):
            out = F.when(F.coalesce(F.contains(text, t), F.lit(False)), weight).otherwise(out)
        return out

    return F.round(F.least(F.aggregate(F.transform(terms, of), F.lit(0.0), lambda a, x: a + x), F.lit(cap)), 4)


def boosted(df: DataFrame, boost: Column, places: int = 1) -> DataFrame:
    """df reranked: rows with a boost move up by at most *places*; equal places by boost, then old rank."""
    moved = df.withColumn("__b", boost).withColumn("__t", F.greatest(F.col("rank") - F.when(F.col("__b") > 0, places).otherwise(0), F.lit(1)))
    order = W.partitionBy("q").orderBy("__t", F.desc("__b"), "rank")
    return moved.withColumn("new_rank", F.row_number().over(order).cast("long")).drop("__b", "__t")


def feedback_adjustments(signals: DataFrame, key: str, kind: str, weights: dict[str, float], low: float = -0.10, high: float = 0.05) -> DataFrame:
    """(key, n, adjustment): weights of all signals of a key added and clamped; unknown kinds weigh nothing."""
    w = F.lit(0.0)
    for name, x in weights.items():
        w = F.when(F.col(kind) == name, x).otherwise(w)
    out = signals.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.sum(w).alias("s"))
    return out.select(key, "n", F.round(F.greatest(F.least("s", F.lit(high)), F.lit(low)), 6).alias("adjustment"))


def near_matches(asked: DataFrame, known: DataFrame, q: str, key: str, text: str, least_chars: int = 18, ratio: float = 0.8, anchor: int = 8) -> DataFrame:
    """(q, key): strong keys of which one contains the other, the shorter at least *ratio* of the longer.

    Shorter keys than least_chars match nearly anything and are left to exact lookups; 1 lets every key in.  The
    shorter's middle characters, *anchor* of them or all where it has fewer, must stand in the longer: the windows of both
    sides are joined on them, so no side is compared with all of the other.
    """
    anchor = min(anchor, max(1, int(least_chars)))
    a = asked.select(q, X.strong_key(F.col(text)).alias("a")).filter(F.length("a") >= least_chars)
    b = known.select(key, X.strong_key(F.col(text)).alias("b")).filter(F.length("b") >= least_chars)
    middle = lambda c: F.substring(c, F.floor((F.length(c) - anchor) / 2).cast("int") + 1, F.lit(anchor))
    windows = lambda c: F.explode(F.array_distinct(X.let(c, lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - anchor + 1), lambda i: F.substring(s, i, F.lit(anchor))))))
    one = a.withColumn("w", middle(F.col("a"))).join(b.withColumn("w", windows(F.col("b"))), "w")
    two = a.withColumn("w", windows(F.col("a"))).join(b.withColumn("w", middle(F.col("b"))), "w")
    both = one.select(q, key, "a", "b").unionByName(two.select(q, key, "a", "b")).distinct()
    short, long = F.least(F.length("a"), F.length("b")), F.greatest(F.length("a"), F.length("b"))
    return both.filter((short >= ratio * long) & (F.contains("a", F.col("b")) | F.contains("b", F.col("a")))).select(q, key).distinct()


def unsupported(claim: Column, evidence: Column) -> Column:
    """Numbers and codes of a claim that its evidence does not hold; an empty array for none, null for a null claim."""
    found = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]*[0-9][a-z0-9._:-]*[a-z0-9]|[0-9]"), F.lit(0)))
    return F.when(claim.isNotNull(), F.array_except(found(claim), F.coalesce(found(evidence), F.array().cast("array<string>"))))


def merge_neighbours(hits: DataFrame, most_chars: int = 1200) -> DataFrame:
    """(q, doc, first_rank, n_members, chars, members): ranked chunks of one document gathered, best first, while they fit.

    hits: q, doc, chunk, rank, chars; a query's hits are a top-k and are folded in one task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        last: dict[str, int] = {}
        for r in pdf.sort_values("rank").itertuples(index=False):
            i = last.get(r.doc)
            if i is not None and out[i][4] + r.chars <= most_chars:
                out[i][3] += 1
                out[i][4] += r.chars
                out[i][5].append(r.chunk)
            else:
                last[r.doc] = len(out)
                out.append([r.q, r.doc, r.rank, 1, r.chars, [r.chunk]])
        return pd.DataFrame(out, columns=["q", "doc", "first_rank", "n_members", "chars", "members"])

    return hits.select("q", "doc", F.col("chunk").cast("long").alias("chunk"), "rank", F.col("chars").cast("long").alias("chars")).groupBy("q").applyInPandas(fold, "q long, doc string, first_rank long, n_members long, chars long, members array<long>")


def agreement(labels: DataFrame, item: str, rater: str, verdict: str) -> DataFrame:
    """(rater, n, tp, fp, fn, tn, kappa): each rater's yes/no verdicts against the majority of the item's other raters; ties and lone raters are left out."""
    v = labels.filter(F.col(verdict).isNotNull()).select(item, rater, F.col(verdict).cast("int").alias("v"))
    sums = v.groupBy(item).agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    others = v.join(sums, item).select(rater, "v", (2 * (F.col("s") - F.col("v")) - (F.col("n") - 1)).alias("lean")).filter("lean <> 0")
    truth = F.col("lean") > 0
    count = lambda c: F.sum(c.cast("long"))
    out = others.groupBy(rater).agg(F.count("*").alias("n"), count((F.col("v") == 1) & truth).alias("tp"), count((F.col("v") == 1) & ~truth).alias("fp"), count((F.col("v") == 0) & truth).alias("fn"), count((F.col("v") == 0) & ~truth).alias("tn"))
    n = F.col("n").cast("double")
    seen = (F.col("tp") + F.col("tn")) / n
    chance = ((F.col("tp") + F.col("fp")) * (F.col("tp") + F.col("fn")) + (F.col("fn") + F.col("tn")) * (F.col("fp") + F.col("tn"))) / (n * n)
    return out.withColumn("kappa", F.when(chance < 1, F.round((seen - chance) / (1 - chance), 6)).otherwise(1.0))
