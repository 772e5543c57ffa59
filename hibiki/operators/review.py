"""Feedback, reviews and what is made of them: queues, joined records, counts for a dashboard, rank lifts, checks of cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _newest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key in the order of the columns; the aggregate is partial, so hot keys cost nothing."""
    kept = [c for c in df.columns if c != key]
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*kept), F.struct(*order)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in kept])


def _oldest(df: DataFrame, key: str, *order: str) -> DataFrame:
    kept = [c for c in df.columns if c != key]
    best = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*kept), F.struct(*order)).alias("__r"))
    return best.select(key, *[F.col(f"__r.{c}").alias(c) for c in kept])


def review_queue(chats: DataFrame, feedback: DataFrame) -> DataFrame:
    """(review_id, token, request, reason, priority, source), one row per token, request and reason.

    chats: token, request, mode, at, tie.  feedback: token, kind, selected, at, tie.  Feedback joins the first chat of its
    token; feedback without a chat, and rows without a token, are left out.  Bad feedback is of high priority where an
    answer had been selected, else medium; asking for a person is high.  A chat without an answer is medium; one that only
    showed candidates is low, unless its token has bad feedback or a person was asked for.
    """
    clean = lambda df: df.withColumn("token", F.nullif(F.trim("token"), F.lit("")))
    chats, feedback = clean(chats), clean(feedback)
    first = _oldest(chats.select("token", "request", "at", "tie"), "token", "at", "tie").select("token", "request")
    chosen = F.coalesce(F.trim("selected"), F.lit("")) != ""
    reason = F.when((F.col("kind") == "bad") & chosen, "bad_with_selection").when(F.col("kind") == "bad", "bad_without_selection").when(F.col("kind") == "human_review", "human_review")
    said = feedback.select("token", reason.alias("reason")).filter("token is not null and reason is not null").join(first, "token")
    said = said.select("token", "request", "reason", F.when(F.col("reason") == "bad_without_selection", "medium").otherwise("high").alias("priority"), F.lit("feedback").alias("source"))
    loud = feedback.filter("token is not null and kind in ('bad', 'human_review')").select("token").distinct().withColumn("loud", F.lit(True))
    seen = chats.filter("mode in ('no_answer', 'candidates_only')").join(loud, "token", "left").filter("mode = 'no_answer' or loud is null")
    seen = seen.select("token", "request", F.col("mode").alias("reason"), F.when(F.col("mode") == "no_answer", "medium").otherwise("low").alias("priority"), F.lit("chat").alias("source"))
    items = said.unionByName(seen.filter("token is not null or request is not null")).distinct()
    name = F.concat_ws("|", F.coalesce("token", F.lit("")), F.coalesce("request", F.lit("")), "reason")
    return items.select(F.concat(F.lit("review_"), F.substring(F.sha2(name, 256), 1, 20)).alias("review_id"), "token", "request", "reason", "priority", "source")


def joined_records(records: DataFrame, feedback: DataFrame, reviews: DataFrame) -> DataFrame:
    """records (id, request, trace, ...) with the newest feedback and verdict, null where there is none.

    feedback: token, kind, at, tie: that of the request counts, else that of the trace.  reviews: id, verdict, at, tie.
    """
    last = _newest(feedback.select("token", "kind", "at", "tie"), "token", "at", "tie").select("token", "kind")
    by = lambda c, n: last.select(F.col("token").alias(c), F.col("kind").alias(n))
    judged = _newest(reviews.select("id", "verdict", "at", "tie"), "id", "at", "tie").select("id", "verdict")
    out = records.join(by("request", "__r"), "request", "left").join(by("trace", "__t"), "trace", "left").join(judged, "id", "left")
    return out.select(*records.columns, F.coalesce("__r", "__t").alias("feedback"), "verdict")


def dashboard(joined: DataFrame, mode: str, abstained: Column, degraded: Column) -> DataFrame:
    """(part, name, n): totals, modes, feedback and verdicts of joined records in one pass over grouping sets."""
    rows = joined.select(F.coalesce(mode, F.lit("unknown")).alias("mode"), "feedback", "verdict", abstained.cast("long").alias("abstained"), degraded.cast("long").alias("degraded"))
    waiting = ((F.col("feedback") == "bad") & F.col("verdict").isNull()).cast("long")
    sets = [[F.col("mode")], [F.col("feedback")], [F.col("verdict")], []]
    g = rows.withColumn("w", waiting).groupingSets(sets, F.col("mode"), F.col("feedback"), F.col("verdict")).agg(
        F.grouping_id().alias("g"), F.count("*").alias("n"), F.coalesce(F.sum("abstained"), F.lit(0)).alias("abstained"), F.coalesce(F.sum("degraded"), F.lit(0)).alias("degraded"), F.coalesce(F.sum("w"), F.lit(0)).alias("waiting")
    )
    one = lambda part, name, n: F.struct(F.lit(part).alias("part"), name.alias("name"), n.alias("n"))
    totals = F.array(*[one("total", F.lit(c), F.col(k)) for c, k in (("records", "n"), ("abstained", "abstained"), ("degraded", "degraded"), ("bad and unreviewed", "waiting"))])
    each = F.when(F.col("g") == 3, F.array(one("mode", F.col("mode"), F.col("n")))).when(F.col("g") == 5, F.array(one("feedback", F.col("feedback"), F.col("n")))).when(F.col("g") == 6, F.array(one("verdict", F.col("verdict"), F.col("n")))).otherwise(totals)
    return g.select(F.explode(each).alias("e")).select("e.*").filter("name is not null")


HITS = ("quoted", "ids", "alnum", "katakana", "kanji", "short", "title", "section", "question", "alias", "code")


def lifted(ranked: DataFrame, n_terms: str, strong_lift: int = 3, weak_lift: int = 2) -> DataFrame:
    """ranked rows (q, rank from 1, the counts of HITS, flags faq, procedure, other) with *lift* and *new_rank*.

    Points for every kind of hit are added and capped; a row moves up by them at most, and equal places go by strength of
    the evidence, then by the old rank.  A single weak hit of a question of several terms moves nothing.
    """
    c = {k: F.coalesce(k, F.lit(0)) for k in HITS}
    on = lambda k, points: F.when(c[k] > 0, points).otherwise(0)
    strong = (c["quoted"] > 0) | (c["ids"] > 0)
    lexical = c["alnum"] + c["katakana"] + c["kanji"]
    points = F.when(c["quoted"] > 0, 2 + F.least(F.lit(1), c["quoted"] - 1)).otherwise(0) + F.when(c["ids"] > 0, 1).when(c["alnum"] > 0, 2).otherwise(0)
    points = points + on("katakana", 2) + on("kanji", 2) + on("short", 1) + F.least(F.lit(2), c["title"]) + on("section", 1) + on("question", 2) + on("alias", 1) + on("code", 1)
    points = points + F.when(F.col("faq") & (c["short"] > 0), 2).otherwise(0) + F.when(F.col("procedure"), 1).otherwise(0)
    points = F.when(~strong & (F.col(n_terms) > 1) & (lexical < 2) & (c["title"] == 0) & (c["question"] == 0), 0).otherwise(points)
    points = F.when(F.col("other") & ~strong, F.least(points, F.lit(2))).otherwise(points)
    lift = F.least(points, F.when(strong, strong_lift).otherwise(weak_lift)).cast("long")
    rows = ranked.withColumn("lift", lift).withColumn("__to", F.greatest(F.lit(1), F.col("rank") - F.col("lift")))
    order = (F.col("__to"), F.when(strong, 0).otherwise(1), -(c["quoted"] + c["ids"] + c["code"]), -c["short"], -(c["title"] + c["section"] + c["question"] + c["alias"]), -lexical, F.col("rank"))
    return rows.withColumn("new_rank", F.row_number().over(W.partitionBy("q").orderBy(*order)).cast("long")).drop("__to")


def golden_checks(cases: DataFrame, texts: DataFrame, case: str, key: str) -> DataFrame:
    """(case, texts, all_held, any_held, forbidden_held) of cases (case, keys, required, forbidden) against texts (key, text).

    A required term is held if one of the case's texts contains it.  Null and blank terms are no terms; a case without
    required terms holds all of them and none of any; keys without a text count as no text.
    """
    terms = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda t: t.isNotNull() & (F.trim(t) != ""))
    rows = cases.select(case, F.explode_outer(F.array_distinct("keys")).alias(key), terms(F.col("required")).alias("required"), terms(F.col("forbidden")).alias("forbidden"))
    rows = rows.join(texts.select(key, "text"), key, "left")
    held = lambda c: F.transform(c, lambda t: F.coalesce(F.contains(F.col("text"), t), F.lit(False)).cast("int"))
    per = rows.select(case, "text", "required", F.explode_outer(F.arrays_zip(F.col("required").alias("term"), held(F.col("required")).alias("held"))).alias("r"), F.exists("forbidden", lambda t: F.coalesce(F.contains(F.col("text"), t), F.lit(False))).alias("bad"))
    by_term = per.groupBy(case, F.col("r.term").alias("term")).agg(F.max("r.held").alias("held"), F.max("bad").alias("bad"))
    n = rows.groupBy(case).agg(F.count("text").alias("texts"))
    out = by_term.groupBy(case).agg(F.coalesce(F.min("held"), F.lit(1)).alias("all_held"), F.coalesce(F.max("held"), F.lit(0)).alias("any_held"), F.max("bad").alias("forbidden_held"))
    return n.join(out, case).select(case, "texts", (F.col("all_held") == 1).alias("all_held"), (F.col("any_held") == 1).alias("any_held"), F.coalesce("forbidden_held", F.lit(False)).alias("forbidden_held"))
