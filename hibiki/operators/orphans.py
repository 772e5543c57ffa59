"""References to records that do not exist, by bitmaps over dictionary-encoded keys.

Keys are numbered by a dictionary: a bucket by hash and a rank in the bucket.  Per range of 32,768 numbers and
period (month) one bitmap holds the keys referred to, and others the keys whose first version and whose deletions
fall in that period.  Folding the latter over the periods gives the keys that are certainly there all through a
period: begun in an earlier period and not deleted by its end.  References AND-NOT that bitmap survive; they are
decoded, and only they are held against the exact times.

A key with a third of all references is salted where its references meet what is known of it; the timelines of the
surviving keys are split by day, so there such a key is spread over its days.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.salting import salted_join
from ..sources.tables import materialize

RANGE = 1 << 15
_RANK_BITS = 24


def _survivors(pdf: pd.DataFrame) -> pd.DataFrame:
    """One key range: references AND-NOT the keys that are there, period by period."""
    blank = np.zeros(RANGE // 8, np.uint8)
    begun, gone = blank.copy(), blank.copy()
    rows: list[tuple[int, str]] = []
    chunk, target = int(pdf["chunk"].iloc[0]), pdf["target"].iloc[0]

    def bits(of: pd.DataFrame, kind: str) -> np.ndarray:
        out = blank.copy()
        for raw in of.loc[of["kind"] == kind, "bits"]:
            out |= np.frombuffer(raw, np.uint8)
        return out

    for period, of in pdf.groupby("period", sort=True):
        gone |= bits(of, "gone")  # by the end of this period
        orphan = bits(of, "ref") & ~(begun & ~gone)
        rows += [(int(p), period) for p in np.flatnonzero(np.unpackbits(orphan, bitorder="little"))]
        begun |= bits(of, "begun")  # before the next period
    texts = lambda x: pd.Series(x, dtype=object)
    return pd.DataFrame({"target": texts([target] * len(rows)), "key_no": np.array([chunk * RANGE + p for p, _ in rows], np.int64), "period": texts([m for _, m in rows])})


def _number(keys: DataFrame, buckets: int) -> DataFrame:
    """target, key -> key_no: dense ranks within hash buckets."""
    keys = keys.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    rank = F.row_number().over(W.partitionBy("target", "bucket").orderBy("key")) - 1
    return keys.select("target", "key", (F.shiftleft(F.col("bucket").cast("long"), _RANK_BITS) + rank).alias("key_no"))


def _bitmaps(numbered: DataFrame, kind: str) -> DataFrame:
    """(target, chunk, period, kind, bits) of distinct (target, key_no, period)."""
    chunk, place = F.floor(F.col("key_no") / RANGE).cast("long"), F.pmod("key_no", F.lit(RANGE)).cast("long")
    return numbered.groupBy("target", chunk.alias("chunk"), "period").agg(F.bitmap_construct_agg(place).alias("bits")).withColumn("kind", F.lit(kind))


def _period(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM")


def orphan_references(refs: DataFrame, parents: DataFrame, tombstones: DataFrame, keys_per_bucket: int = 16_384) -> DataFrame:
    """(ref_table, ref_field, record_id, ref_key, orphan_state, ref_month), distinct.

    refs: ref_table, ref_field, record_id, target, ref_key, at.  parents: target, key, at (one row per version).
    tombstones: target, key, at.  orphan_state is `missing` (no version at all), `late` (every version is newer than
    the reference) or `deleted` (a deletion up to then is newer than the newest version up to then).

    Null and blank keys are no references.  A version without a time counts as older than everything; a deletion
    without a time is ignored; a reference without a time can only be missing.  Keys compare exactly as written.
    """
    refs = refs.select("ref_table", "ref_field", "record_id", "target", "ref_key", "at").filter(F.col("ref_key").isNotNull() & ~F.col("ref_key").rlike(r"^(?U)\s*$")).distinct()
    refs = materialize(refs.withColumn("period", F.coalesce(_period(F.col("at")), F.lit("9999"))), "refs")
    versions = parents.select("target", "key", F.coalesce("at", F.lit("0001-01-01").cast("timestamp")).alias("at")).filter("key is not null").distinct()
    deletions = tombstones.select("target", "key", "at").filter("key is not null and at is not null").distinct()
    counted = materialize(refs.groupBy("target", "ref_key", "period").agg(F.count("*").alias("n")), "asked")
    ref_keys = counted.select("target", F.col("ref_key").alias("key"), "period")
    firsts = versions.groupBy("target", "key").agg(F.min("at").alias("first")).select("target", "key", _period(F.col("first")).alias("period"))
    gone = deletions.groupBy("target", "key").agg(F.min("at").alias("first")).select("target", "key", _period(F.col("first")).alias("period"))
    known = materialize(ref_keys.withColumn("kind", F.lit("ref")).unionByName(firsts.withColumn("kind", F.lit("begun"))).unionByName(gone.withColumn("kind", F.lit("gone"))), "keys")
    distinct = known.select("target", "key").distinct()
    buckets = max(1, distinct.count() // keys_per_bucket)
    numbers = materialize(_number(distinct, buckets), "numbers")
    numbered = known.join(numbers, ["target", "key"])
    maps = _bitmaps(numbered.filter("kind = 'ref'"), "ref").unionByName(_bitmaps(numbered.filter("kind = 'begun'"), "begun")).unionByName(_bitmaps(numbered.filter("kind = 'gone'"), "gone"))
    left = maps.groupBy("target", "chunk").applyInPandas(_survivors, "target string, key_no long, period string")
    doubtful = left.join(numbers, ["target", "key_no"]).select("target", F.col("key").alias("ref_key"), "period").join(counted, ["target", "ref_key", "period"])
    suspects = salted_join(refs, materialize(doubtful, "doubtful"), ["target", "ref_key", "period"], "n", "record_id")
    none = F.lit("9999-12-31").cast("timestamp")  # stands for no time in the join
    suspects = materialize(suspects.withColumn("asked_at", F.coalesce("at", none)), "suspects")
    asked = suspects.groupBy("target", F.col("ref_key").alias("key"), "at").agg(F.count("*").alias("n"))
    asked = materialize(asked, "times")
    often = asked.select(F.col("target").alias("t"), "key", F.coalesce("at", none).alias("asked_at"), "n")
    states = _states(asked.drop("n"), versions, deletions).withColumn("asked_at", F.coalesce("asked_at", none)).join(often, ["t", "key", "asked_at"])
    states = states.select(F.col("t").alias("target"), F.col("key").alias("ref_key"), "asked_at", "orphan_state", "n")
    found = salted_join(suspects, materialize(states, "states"), ["target", "ref_key", "asked_at"], "n", "record_id")
    return found.select("ref_table", "ref_field", "record_id", "ref_key", "orphan_state", F.when(F.col("at").isNotNull(), _period(F.col("at"))).alias("ref_month")).distinct()


def _states(asked: DataFrame, versions: DataFrame, deletions: DataFrame) -> DataFrame:
    """(t, key, asked_at, orphan_state) of the asked (target, key, time) that are orphans, by exact times."""
    keys = asked.select("target", "key").distinct()
    versions = versions.join(keys, ["target", "key"], "left_semi")
    deletions = deletions.join(keys, ["target", "key"], "left_semi")
    none = F.lit(None).cast("timestamp")
    events = versions.select("target", "key", "at", F.lit(0).alias("what"), F.col("at").alias("version"), none.alias("deletion"))
    events = events.unionByName(deletions.select("target", "key", "at", F.lit(0).alias("what"), none.alias("version"), F.col("at").alias("deletion")))
    asks = asked.filter("at is not null").select("target", "key", "at", F.lit(1).alias("what"), none.alias("version"), none.alias("deletion"))
    line = events.unionByName(asks).withColumn("day", F.to_date("at"))
    days = line.groupBy("target", "key", "day").agg(F.max("version").alias("v"), F.max("deletion").alias("d"))
    earlier = W.partitionBy("target", "key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    carried = days.select("target", "key", "day", F.max("v").over(earlier).alias("version"), F.max("d").over(earlier).alias("deletion"))
    carried = carried.select("target", "key", F.col("day").cast("timestamp").alias("at"), F.lit(-1).alias("what"), "version", "deletion", "day")
    so_far = W.partitionBy("target", "key", "day").orderBy("at", "what").rangeBetween(W.unboundedPreceding, W.currentRow)
    line = line.unionByName(carried).select("target", "key", "at", "what", F.max("version").over(so_far).alias("version"), F.max("deletion").over(so_far).alias("deletion"))
    told = line.filter("what = 1").select("target", "key", F.col("at").alias("asked_at"), "version", "deletion")
    told = told.unionByName(asked.filter("at is null").select("target", "key", F.col("at").alias("asked_at"), none.alias("version"), none.alias("deletion")), allowMissingColumns=True)
    there = versions.select("target", "key").distinct().withColumn("there", F.lit(True))
    told = told.join(there, ["target", "key"], "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("asked_at").isNull(), None).when(F.col("version").isNull(), "late").when(F.col("deletion") > F.col("version"), "deleted")
    return told.select(F.col("target").alias("t"), "key", "asked_at", state.alias("orphan_state")).filter("orphan_state is not null")


def orphan_report(found: DataFrame) -> DataFrame:
    """(ref_table, ref_field, orphan_state, ref_month, n_refs, n_keys): orphans per table and period."""
    return found.groupBy("ref_table", "ref_field", "orphan_state", "ref_month").agg(F.count("*").alias("n_refs"), F.countDistinct("ref_key").alias("n_keys"))
