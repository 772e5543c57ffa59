"""Streams over the events table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, table
from ..streaming import logs as S


def _run(df: DataFrame, mode: str) -> DataFrame:
    """Drain a stream into the shared folder; in complete mode the last batch is the whole result."""
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/hibiki-stream-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{folder}/out").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{folder}/out")).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/out")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    e = S.stream_table(spark, d, "events", table(spark, d, "events").schema)
    return e.select("event_id", F.col("ts").alias("at"), (F.col("user_id") % 5).alias("tenant"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens"))


def ss1_rate_limit_stream(spark: SparkSession, d: str) -> DataFrame:
    out = _run(S.calls_per_window(_calls(spark, d), "tenant", "at", 3600, 3), "complete")
    return out.select("tenant", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "calls", "refused")


def ss3_usage_stream(spark: SparkSession, d: str) -> DataFrame:
    return _run(S.usage(_calls(spark, d), "tenant", "event_type", tokens="tokens"), "complete")


def ss2_breaker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    calls = e.select((F.col("user_id") % 5).cast("string").alias("key"), "event_id", F.col("ts").cast("timestamp").alias("at"), (F.col("event_type") != "error").alias("ok"))
    return S.breaker_batch(calls, 2, 1800.0).groupBy("key", "outcome").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (ss1_rate_limit_stream, ss3_usage_stream, ss2_breaker)}
SQL = {
    "ss1_rate_limit_stream": "SELECT user_id % 5 AS tenant, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS start, count(*) AS calls, greatest(count(*) - 3, 0) AS refused FROM events GROUP BY 1, 2",
    "ss3_usage_stream": "SELECT user_id % 5 AS tenant, event_type, count(*) AS calls, CAST(sum(CAST(props->>'$.k' AS BIGINT)) AS BIGINT) AS tokens FROM events GROUP BY 1, 2",
}
