"""Operators that hold tables against each other: diffs, alignment, freshness, lookups, near matches, typos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.tables import materialize
from .bigrams import most_alike


def newest(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order; orders should end in a unique column."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, change): added, deleted, modified or same, by a full join of two states, each unique by key."""
    a, b = before.select(key, F.col(digest).alias("__a"), F.lit(1).alias("__ina")), after.select(key, F.col(digest).alias("__b"), F.lit(1).alias("__inb"))
    change = F.when(F.col("__ina").isNull(), "added").when(F.col("__inb").isNull(), "deleted").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("modified")
    return a.join(b, key, "full").select(key, change.alias("change"))


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(both, only_a, only_b, jaccard) of the distinct keys of two tables; null keys are left out."""
    x = a.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__a", F.lit(1))
    y = b.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("__b", F.lit(1))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    both = x.join(y, key, "full").agg(one(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"), one(F.col("__b").isNull()).alias("only_a"), one(F.col("__a").isNull()).alias("only_b"))
    total = F.col("both") + F.col("only_a") + F.col("only_b")
    return both.withColumn("jaccard", F.round(F.when(total > 0, F.col("both") / total), 6))


def lookup(asked: DataFrame, q: str, text: str, known: DataFrame, key: str, text_of: str, aliases: str) -> DataFrame:
    """(q, key, how): the least key whose question has the asked strong key, else the least whose alias has it."""
    ask = asked.select(q, X.strong_key(F.col(text)).alias("__k")).filter("__k <> ''")
    direct = known.select(F.col(key).alias("__key"), X.strong_key(F.col(text_of)).alias("__k"), F.lit(0).alias("__how"))
    alias = known.select(F.col(key).alias("__key"), F.explode(aliases).alias("__t")).select("__key", X.strong_key(F.col("__t")).alias("__k"), F.lit(1).alias("__how"))
    best = direct.unionByName(alias).filter("__k <> ''").groupBy("__k").agg(F.min(F.struct("__how", "__key")).alias("__b"))
    return ask.join(best, "__k").select(q, F.col("__b.__key").alias(key), F.when(F.col("__b.__how") == 0, "question").otherwise("alias").alias("how"))


def nearest_by_bigrams(asked: DataFrame, known: DataFrame, q: str, key: str, text: str, least: float) -> DataFrame:
    """(q, key, jaccard): the known text whose bigram set is nearest to the asked one, if at least *least*; ties by key."""
    return most_alike(asked, known, q, key, text, least, 1).select(q, key, F.col("score").alias("jaccard"))


def holding(texts: DataFrame, key: str, text: str, terms: DataFrame, term: str, head: int = 4) -> DataFrame:
    """(key, term), distinct: the terms that a text contains, as written; null and empty terms are contained by none.

    A text that contains a term contains its first characters, up to *head*: windows of those lengths are joined on, the
    whole term is compared afterwards.  Texts are read once per length, at most *head* times.
    """
    asked = materialize(terms.select(F.col(term).alias("__t")).filter(F.col("__t") != "").distinct().withColumn("__h", F.substring("__t", 1, head)), "terms")
    rows = texts.select(F.col(key).alias("__k"), F.col(text).alias("__x")).filter("__x is not null")

    def windows(n: int) -> Column:
        return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("__x") - n + 1), lambda i: F.substring(F.col("__x"), i, F.lit(n))))

    out = None
    for n in range(1, head + 1):
        some = asked.filter(F.length("__h") == n)
        part = rows.filter(F.length("__x") >= n).select("__k", "__x", F.explode(windows(n)).alias("__h")).join(some, "__h").filter(F.contains("__x", F.col("__t"))).select(F.col("__k").alias(key), F.col("__t").alias(term))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def typo_pairs(rare: DataFrame, common: DataFrame, word: str) -> DataFrame:
    """(word, suggestion): rare words one edit away from a common one, found by their one-character deletions."""
    def deletions(df: DataFrame, name: str) -> DataFrame:
        n, w = F.length("__w"), F.col("__w")
        cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))
        return df.select(F.col(word).alias("__w")).filter(n > 0).select(w.alias(name), F.explode(F.array_distinct(F.array_append(cut, w))).alias("__d"))

    both = deletions(rare, "word").join(deletions(common, "suggestion"), "__d").select("word", "suggestion").distinct()
    return both.filter((F.col("word") != F.col("suggestion")) & (F.levenshtein("word", "suggestion", 1) == 1))


def repeated_lines(docs: DataFrame, page: str, group: str, text: str, most_chars: int = 40, least_pages: int = 3, least_share: float = 0.6) -> DataFrame:
    """(group, line, pages, of): short first or last lines that, digits masked, recur on enough pages of their group."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.trim(x)) > 0)
    edges = X.let(lines, lambda a: F.concat(F.slice(a, F.lit(1), F.lit(2)), F.slice(a, F.greatest(F.size(a) - 1, F.lit(1)), F.lit(2))))
    rows = docs.select(page, group, F.explode(F.array_distinct(F.transform(edges, lambda x: F.regexp_replace(F.trim(x), "[0-9]", "#")))).alias("line")).filter(F.length("line") <= most_chars)
    of = docs.groupBy(group).agg(F.countDistinct(page).alias("of"))
    counted = rows.groupBy(group, "line").agg(F.countDistinct(page).alias("pages")).filter(F.col("pages") >= least_pages)
    return counted.join(of, group).filter(F.col("pages") >= least_share * F.col("of")).select(group, "line", "pages", "of")


def heading_blocks(docs: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """(key, block, title, n_lines, n_chars): lines gathered under the heading line before them; block 0 has none."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line")).filter(F.length(F.trim("line")) > 0)
    w = W.partitionBy(key).orderBy("pos")
    cut = lines.withColumn("h", F.col("line").rlike(heading)).withColumn("block", F.sum(F.col("h").cast("long")).over(w))
    title = F.max(F.when(F.col("h"), F.col("line")))
    return cut.groupBy(key, "block").agg(title.alias("title"), F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))
