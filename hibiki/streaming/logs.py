"""Streaming twins of the log operators: counts per window, running usage, newest state, circuit breaker."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_table(spark: SparkSession, folder: str, name: str, schema: T.StructType) -> DataFrame:
    """A Parquet table of a folder as a stream of files; its time columns without zone become instants."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", 16).option("pathGlobFilter", f"{name}*.parquet").option("recursiveFileLookup", "true").parquet(folder)
    naive = [f.name for f in schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return raw.withColumns({c: F.col(c).cast("timestamp") for c in naive})


def calls_per_window(calls: DataFrame, bucket: str, at: str, seconds: int, limit: int, late: str = "10 minutes") -> DataFrame:
    """(bucket, start, calls, refused) of fixed windows; calls later than *late* behind the newest are left out."""
    w = F.window(at, f"{seconds} seconds")
    counted = calls.withWatermark(at, late).groupBy(w.alias("w"), bucket).agg(F.count("*").alias("calls"))
    return counted.select(bucket, F.col("w.start").alias("start"), "calls", F.greatest(F.col("calls") - limit, F.lit(0)).alias("refused"))


def usage(calls: DataFrame, *by: str, tokens: str) -> DataFrame:
    """Running calls and tokens; written in complete or update mode."""
    return calls.groupBy(*by).agg(F.count("*").alias("calls"), F.sum(tokens).alias("tokens"))


def distinct_events(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """Events without re-deliveries within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def write_newest(batch: DataFrame, store: str, keys: list[str], order: list[str]) -> None:
    """For foreachBatch: keep in the Parquet folder *store* the newest row of each key; each write is a new version, named last.

    Re-running a batch changes nothing, as the newest of equal rows is the same row.
    """
    from pyspark.sql import Window as W

    spark = batch.sparkSession
    versions = _versions(spark, store)
    whole = batch if not versions else spark.read.schema(batch.schema).parquet(f"{store}/v{versions[-1]:08d}").unionByName(batch)
    w = W.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    newest = whole.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    newest.write.mode("overwrite").parquet(f"{store}/v{(versions[-1] + 1 if versions else 0):08d}")


def read_newest(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.parquet(f"{store}/v{_versions(spark, store)[-1]:08d}")


def _versions(spark: SparkSession, store: str) -> list[int]:
    """Versions that were written to the end, oldest first."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(store)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(n[1:]) for n in done if n.startswith("v"))


# ------------------------------------------------------------------------------------------------- circuit breaker


def breaker_step(state: dict[str, Any], at: float, ok: bool, failures: int, open_seconds: float) -> str:
    """Move a breaker by one call: closed, open after *failures* in a row, half open after *open_seconds*, then one probe.

    Returns what became of the call: passed, failed or refused.
    """
    if state["state"] == "open":
        if at - state["since"] < open_seconds:
            return "refused"
        state.update(state="half_open")
    if ok:
        state.update(state="closed", bad=0)
        return "passed"
    state["bad"] += 1
    if state["state"] == "half_open" or state["bad"] >= failures:
        state.update(state="open", since=at, bad=0)
    return "failed"


OUT = "key string, event_id long, at timestamp, outcome string, state string"
STATE = "state string, since double, bad int"


def _fold(key: str, pdf: pd.DataFrame, state: dict[str, Any], failures: int, open_seconds: float) -> pd.DataFrame:
    pdf = pdf.sort_values(["at", "event_id"])
    rows = []
    for at, event_id, ok in zip(pdf["at"], pdf["event_id"], pdf["ok"], strict=True):
        outcome = breaker_step(state, at.timestamp(), bool(ok), failures, open_seconds)
        rows.append((key, event_id, at, outcome, state["state"]))
    return pd.DataFrame(rows, columns=["key", "event_id", "at", "outcome", "state"])


def breaker_batch(calls: DataFrame, failures: int = 3, open_seconds: float = 60.0) -> DataFrame:
    """calls (key, event_id, at, ok) with outcome and state: an ordered fold per key."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        return _fold(key[0], pdf, {"state": "closed", "since": 0.0, "bad": 0}, failures, open_seconds)

    return calls.select("key", "event_id", "at", "ok").groupBy("key").applyInPandas(run, OUT)


def breaker_stream(calls: DataFrame, failures: int = 3, open_seconds: float = 60.0) -> DataFrame:
    """The same over a stream: the state of a key outlives batches, calls are ordered within a batch."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def run(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = dict(zip(("state", "since", "bad"), state.get, strict=True)) if state.exists else {"state": "closed", "since": 0.0, "bad": 0}
        out = _fold(key[0], pd.concat(list(batches)), held, failures, open_seconds)
        state.update((held["state"], float(held["since"]), int(held["bad"])))
        yield out

    return calls.select("key", "event_id", "at", "ok").groupBy("key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
