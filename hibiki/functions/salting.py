"""Joins and groups that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(many: DataFrame, one: DataFrame, on: list[str], count: str, spread_by: str, hot_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """Inner join of *many* rows to *one* row per key, spreading keys with over hot_rows rows over *salts* tasks.

    one has the number of rows of its key in column *count* (dropped).  Hot keys number at most rows / hot_rows,
    which bounds what is broadcast to tell them; all other keys join as usual.  Null keys match nothing.
    The hash of *spread_by*, a column that differs within a key, gives the salt: the same in a repeated task.
    """
    hot = one.filter(F.col(count) > hot_rows).select(*on, F.lit(True).alias("__hot"))
    many = many.join(F.broadcast(hot), on, "left")
    many = many.withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")).otherwise(0)).drop("__hot")
    each = F.when(F.col(count) > hot_rows, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    one = one.withColumn("__salt", F.explode(each)).drop(count)
    return many.join(one, [*on, "__salt"]).drop("__salt")
