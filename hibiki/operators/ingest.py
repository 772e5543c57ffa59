"""Rows on their way into a store: defaults, pages, stale and colliding rows, cleaned texts, generations, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reconcile import repeated_lines

#: The roles of chunks that are searched; a chunk without a role is one of them.
CHILD_ROLES = ("child", "leaf")


def is_child(role: Column) -> Column:
    clean = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return (clean == "") | clean.isin(*CHILD_ROLES)


def is_parent(role: Column) -> Column:
    return F.lower(F.trim(F.coalesce(role, F.lit("")))) == "parent"


def tenant_of(tenant: Column) -> Column:
    """The tenant without white space around it; null and blank are "default"."""
    return F.coalesce(F.nullif(F.trim(tenant), F.lit("")), F.lit("default"))


def ingest_rows(rows: DataFrame, generation: str, with_parents: bool = True) -> DataFrame:
    """Rows with id and text, ready for a store: tenant, searchable, pages, page_start, page_end and generation filled.

    Rows without an id or a text are left out, and parents too if they are not asked for.  No pages are [-1]; page_start
    and page_end are the first and last real page, null where there is none.
    """
    out = rows.filter((F.trim("id") != "") & (F.trim("text") != ""))
    out = out if with_parents else out.filter(~is_parent(F.col("chunk_role")))
    pages = F.when(F.size(F.coalesce("source_pages", F.array().cast("array<int>"))) > 0, F.col("source_pages")).otherwise(F.array(F.lit(-1)))
    real = F.filter(pages, lambda p: p >= 1)
    return out.withColumns(
        {"tenant_id": tenant_of(F.col("tenant_id")), "searchable": F.coalesce("searchable", F.lit(1)), "source_pages": pages, "page_start": F.get(real, F.lit(0)), "page_end": F.get(real, F.size(real) - 1), "generation": F.lit(generation)}
    )


def stale_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of *existing* that go: of a document (tenant_id, source_doc) that comes anew, with an id that does not."""
    docs = new.filter("source_doc is not null").select("tenant_id", "source_doc").distinct()
    return existing.join(docs, ["tenant_id", "source_doc"], "left_semi").join(new.select("tenant_id", "source_doc", "id").distinct(), ["tenant_id", "source_doc", "id"], "left_anti")


def collisions(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """(key, tenants): keys of *new* that belong to another tenant already, with how many tenants want them."""
    both = existing.select(key, "tenant_id").distinct().withColumn("old", F.lit(True)).unionByName(new.select(key, "tenant_id").distinct().withColumn("old", F.lit(False)))
    per = both.groupBy(key).agg(F.countDistinct("tenant_id").alias("tenants"), F.bool_or("old").alias("was"), F.bool_or(~F.col("old")).alias("comes"))
    return per.filter("tenants > 1 and was and comes").select(key, "tenants")


def cleaned(docs: DataFrame, page: str, group: str, text: str, most_chars: int = 40, least_pages: int = 3, least_share: float = 0.6) -> DataFrame:
    """docs with *cleaned*, the text without its group's repeated lines, and *removed*, the number of lines that went.

    A group has at most 4 / least_share repeated lines, as each stands at the edge of that share of its pages, so they
    travel as one array per group.  Null texts stay null.
    """
    lines = repeated_lines(docs, page, group, text, most_chars, least_pages, least_share)
    keys = lines.groupBy(group).agg(F.collect_set("line").alias("__keys"))
    masked = lambda x: F.regexp_replace(F.trim(x), "[0-9]", "#")
    gone = lambda x: (F.trim(x) != "") & (F.length(F.trim(x)) <= most_chars) & F.array_contains(F.col("__keys"), masked(x))
    both = docs.join(keys, group, "left").withColumn("__keys", F.coalesce("__keys", F.array().cast("array<string>")))
    split = both.withColumn("__lines", F.split(text, "\n")).withColumn("__kept", F.filter("__lines", lambda x: ~gone(x)))
    return split.withColumn("cleaned", F.array_join("__kept", "\n")).withColumn("removed", (F.size("__lines") - F.size("__kept")).cast("long")).drop("__keys", "__lines", "__kept")


def compare_generations(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """(state, n): keys of two generations that are in both with the same or another text, or in one only; null keys are left out."""
    one = lambda df, n: df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.xxhash64(text)).alias(n), F.lit(1).alias(f"in_{n}"))
    both = one(a, "a").join(one(b, "b"), key, "full")
    state = F.when(F.col("in_a").isNull(), "only_b").when(F.col("in_b").isNull(), "only_a").when(F.col("a").eqNullSafe(F.col("b")), "same").otherwise("changed")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def set_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(n, digest): the number of rows and a fingerprint that does not depend on their order: the sum of 48-bit hashes.

    Two tables with the same rows, repeated ones included, have the same fingerprint; no row is sorted or gathered.
    """
    whole = F.concat_ws("\x01", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    part = F.conv(F.substring(F.sha2(whole, 256), 1, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest"))


def same_form(rows: DataFrame, form: str, text: str, least: int = 2) -> DataFrame:
    """(form, spellings, first, n): forms written in at least *least* ways, with the least spelling and the number of rows."""
    per = rows.filter(F.col(form).isNotNull() & F.col(text).isNotNull()).groupBy(form, text).agg(F.count("*").alias("n"))
    return per.groupBy(form).agg(F.count("*").alias("spellings"), F.min(text).alias("first"), F.sum("n").alias("n")).filter(F.col("spellings") >= least)


def neutral(text: Column) -> Column:
    """Evidence that cannot end its own fence or forge a citation: ``` becomes three primes, [S1] becomes (S1)."""
    return F.regexp_replace(F.replace(text, F.lit("```"), F.lit("'''")), r"\[(S[0-9]+)\]", "($1)")


def shortened(text: Column, most: int, suffix: str = "…") -> Column:
    """At most *most* characters, the suffix included where something went."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(suffix)), F.lit(suffix))).otherwise(text)


def exposition(counters: DataFrame, metric: str, label: str, value: str, name: str) -> DataFrame:
    """(line): counters as lines of the text format that metric collectors read, label values escaped."""
    escaped = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n")), F.coalesce(F.col(label).cast("string"), F.lit("")))
    return counters.select(F.concat(F.lit(f'{metric}{{{name}="'), escaped, F.lit('"} '), F.col(value).cast("string")).alias("line"))
