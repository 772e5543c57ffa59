"""Copies that differ in formatting only, by commutative multiset hashing.

Each (field, normalized value) pair is hashed twice; the hashes are added, in halves so that no sum overflows,
so the order of fields does not matter and nothing is sorted.  Records with equal sums are compared field by
field with the record of the least key of their group before they count as copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.salting import salted_join
from ..sources.tables import materialize

_SPACE = r"(?U)\s+"
_EDGE = r"(?<![\p{Nd}\p{P}])\p{P}+|\p{P}+(?![\p{Nd}\p{P}])"
_SUMS = ["h0", "h1", "h2", "h3", "n_fields"]


def normal(value: Column) -> Column:
    """A value without white space, letter case and punctuation, except marks between two digits; null stays null."""
    return F.regexp_replace(F.lower(F.regexp_replace(value, _SPACE, "")), _EDGE, "")


def payload_fields(payload: Column) -> Column:
    """The fields of a JSON object as map of texts, null if it is not valid JSON or no object."""
    return F.when(F.try_parse_json(payload).isNotNull(), F.from_json(payload, "map<string,string>"))


def fingerprint(fields: Column) -> list[Column]:
    """The multiset hash of a map of normalized values: four sums of half hashes and the number of fields."""
    entries = F.map_entries(fields)
    low, high = F.lit(0xFFFFFFFF).cast("long"), 32

    def total(seed: int, upper: bool) -> Column:
        def half(e: Column) -> Column:
            h = F.xxhash64(F.lit(seed), e["key"], e["value"].isNull(), e["value"])
            return F.shiftrightunsigned(h, high) if upper else h.bitwiseAND(low)

        return F.aggregate(entries, F.lit(0).cast("long"), lambda acc, e: acc + half(e))

    return [total(0, False).alias("h0"), total(0, True).alias("h1"), total(1, False).alias("h2"), total(1, True).alias("h3"), F.size(fields).alias("n_fields")]


def same_fields(a: Column, b: Column) -> Column:
    """Whether two maps hold the same fields with equal values, null equal to null only."""
    return (F.size(a) == F.size(b)) & F.forall(F.map_entries(a), lambda e: F.map_contains_key(b, e["key"]) & F.try_element_at(b, e["key"]).eqNullSafe(e["value"]))


def copies(records: DataFrame, source: str, key: str, fields: str) -> DataFrame:
    """(source, key, first): each record with the least key of its group of copies; a record without a copy is its own first.

    fields is a map<string,string> of raw values.  Records with null fields (payloads that are no JSON object) or
    a null key are left out.  Records that share a hash but not their values are grouped by the values themselves.
    """
    rows = records.select(F.col(source), F.col(key).alias("key"), F.transform_values(fields, lambda _, v: normal(v)).alias("fields")).filter("key is not null and fields is not null")
    rows = materialize(rows.select("*", *fingerprint(F.col("fields"))), "fingerprints")
    groups = rows.groupBy(source, *_SUMS).agg(F.min("key").alias("first"), F.min_by("fields", "key").alias("first_fields"), F.count("*").alias("n"))
    alone = groups.filter("n = 1").select(source, F.col("first").alias("key"), "first")
    several = groups.filter("n > 1")
    members = materialize(salted_join(rows, several, [source, *_SUMS], "n", "key").withColumn("same", same_fields(F.col("fields"), F.col("first_fields"))), "members")
    true = members.filter("same").select(source, "key", "first")
    text = F.to_json(F.array_sort(F.map_entries("fields")))
    false = members.filter("not same").withColumn("text", text)
    apart = false.join(false.groupBy(source, *_SUMS, "text").agg(F.min("key").alias("least")), [source, *_SUMS, "text"]).select(source, "key", F.col("least").alias("first"))
    return alone.unionByName(true).unionByName(apart)
