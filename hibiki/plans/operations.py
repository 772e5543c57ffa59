"""Log analytics over events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs as L
from ..sources.tables import table


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Events as calls: outcome the kind of event, tenant the user modulo 5, tokens from the properties."""
    e = table(spark, d, "events")
    return e.select("event_id", "ts", "user_id", (F.col("user_id") % 5).alias("tenant"), "event_type", F.get_json_object("props", "$.k").cast("long").alias("tokens"), F.col("value").alias("cost"))


def a1_usage_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    return L.usage_by(_calls(spark, d), ["tenant", "user_id", "event_type"], "event_type", "tokens", "cost")


def a2_usage_daily(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))


def a3_daily_pivot(spark: SparkSession, d: str) -> DataFrame:
    kinds = ["view", "click", "purchase", "signup", "error"]
    wide = _calls(spark, d).groupBy(F.to_date("ts").cast("string").alias("day")).pivot("event_type", kinds).count()
    return wide.select("day", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


def a4_quota_rollup(spark: SparkSession, d: str) -> DataFrame:
    local = F.to_date(F.col("ts") + F.expr("INTERVAL 9 HOURS"))
    return L.quota_use(_calls(spark, d), "tenant", "user_id", local, {"user": 10, "tenant": 100, "global": 400})


def a6_product_metrics(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda k: F.round(F.avg((F.col("event_type") == k).cast("double")), 6).alias(f"{k}_rate")
    p = lambda q, n: F.round(F.percentile("cost", F.lit(q)), 6).alias(n)
    return _calls(spark, d).groupBy("tenant").agg(F.count("*").alias("calls"), F.countDistinct("user_id").alias("users"), rate("error"), rate("purchase"), F.round(F.avg("cost"), 6).alias("mean"), p(0.5, "p50"), p(0.95, "p95"))


def a7_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Error rate per day and tenant with at least 20 calls: warn from 0.2, critical from 0.3."""
    per = _calls(spark, d).groupBy(F.to_date("ts").cast("string").alias("day"), "tenant").agg(F.count("*").alias("calls"), F.avg((F.col("event_type") == "error").cast("double")).alias("r"))
    return per.select("day", "tenant", "calls", F.when(F.col("calls") < 20, "quiet").when(F.col("r") >= 0.3, "critical").when(F.col("r") >= 0.2, "warn").otherwise("ok").alias("level"))


def a11_threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    return L.threshold_sweep(_calls(spark, d), "cost", F.col("event_type") == "error", [float(x) for x in range(5, 105, 5)])


def a8_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counters of workers merged: sums, and the greatest of gauges."""
    return _calls(spark, d).groupBy(F.concat_ws("_", F.lit("calls"), "event_type").alias("name")).agg(F.count("*").alias("value"), F.max("tokens").alias("gauge"))


def w1_state_seconds(spark: SparkSession, d: str) -> DataFrame:
    return L.state_seconds(_calls(spark, d), "user_id", "ts", "event_type", "2024-01-31 00:00:00", "event_id")


def w2_error_islands(spark: SparkSession, d: str) -> DataFrame:
    runs = L.islands(_calls(spark, d), "user_id", ["ts", "event_id"], F.col("event_type") == "error")
    return runs.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


def w3_business_seconds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp_ntz").alias("start"), (F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(hours=F.col("o_orderkey").cast("int") % 72)).alias("end"))
    return L.business_seconds(o, "start", "end").select("o_orderkey", "business")


def w4_availability(spark: SparkSession, d: str) -> DataFrame:
    return L.availability(_calls(spark, d), "tenant", "ts", F.col("event_type") != "error", "event_id")


def w5_hash_chain(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    entry = _calls(spark, d).withColumn("digest", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256))
    stored = F.when(F.col("event_id") % 97 == 0, F.lit("tampered")).otherwise(F.lag("digest").over(w))
    return L.chain_breaks(entry.withColumn("previous", stored), "user_id", ["ts", "event_id"], "digest", "previous")


def w6_threads(spark: SparkSession, d: str) -> DataFrame:
    t = L.threads(_calls(spark, d), "user_id", "ts", "event_type", "event_id")
    return t.select("user_id", "turns", "title", F.date_format("updated", "yyyy-MM-dd HH:mm:ss").alias("updated"))


def w7_retention(spark: SparkSession, d: str) -> DataFrame:
    return L.retention(_calls(spark, d), "user_id", "ts", "event_id", "2024-01-08 00:00:00", 20).groupBy("user_id", "fate").agg(F.count("*").alias("n"))


def ss1_rate_limit(spark: SparkSession, d: str) -> DataFrame:
    out = L.rate_limited(_calls(spark, d), "tenant", "ts", "event_id", 3, 3600)
    return out.groupBy("tenant", "window_no").agg(F.count("*").alias("calls"), F.sum((~F.col("allowed")).cast("long")).alias("refused"))


def ss6_late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows that arrive after a watermark of one day behind the newest time delivered on earlier days."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "semantic_challenge_v2_chunks").select("row_no", "updated_at", F.to_date("ingested_at").alias("day"))
    days = rows.groupBy("day").agg(F.max("updated_at").alias("newest"))
    w = W.orderBy("day").rowsBetween(W.unboundedPreceding, -1)  # one row per day
    marks = days.select("day", (F.max("newest").over(w) - F.expr("INTERVAL 1 DAY")).alias("mark"))
    return rows.join(marks, "day").groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum((F.coalesce(F.col("updated_at") < F.col("mark"), F.lit(False))).cast("long")).alias("late"))


def ss9_sliding(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


def ss9_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def a19_deadlines(spark: SparkSession, d: str) -> DataFrame:
    """Orders due within 30 days of a day, the nearest first by the deadline that comes next of three."""
    o = table(spark, d, "orders")
    due = F.array_sort(F.array(*[F.date_add(F.to_date("o_orderdate"), n) for n in (30, 60, 90)]))
    left = F.filter(due, lambda x: x >= F.lit("1998-01-01").cast("date"))
    o = o.select("o_orderkey", F.try_element_at(left, F.lit(1)).alias("due")).filter("due is not null")
    days = F.datediff("due", F.lit("1998-01-01").cast("date"))
    return o.filter(days <= 30).select("o_orderkey", F.col("due").cast("string").alias("due"), days.cast("long").alias("days"))


QUERIES = {f.__name__: f for f in (a1_usage_grouping_sets, a2_usage_daily, a3_daily_pivot, a4_quota_rollup, a6_product_metrics, a7_alerts, a8_counters, a11_threshold_sweep, w1_state_seconds, w2_error_islands, w3_business_seconds, w4_availability, w5_hash_chain, w6_threads, w7_retention, ss1_rate_limit, ss6_late_rows, ss9_sliding, ss9_sessions, a19_deadlines)}

_C = "c AS (SELECT event_id, ts, user_id, user_id % 5 AS tenant, event_type, CAST(props->>'$.k' AS BIGINT) AS tokens, value AS cost FROM events)"
_AGG = "count(*) AS calls, count(*) FILTER (event_type = 'error') AS failed, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 6) AS cost FROM c"
_DAY = "strftime(ts, '%Y-%m-%d')"
SQL = {
    "a1_usage_grouping_sets": f"WITH {_C} " + " UNION ALL ".join(f"SELECT '{k}' AS key, CAST({k} AS VARCHAR) AS value, {_AGG} GROUP BY {k}" for k in ("tenant", "user_id", "event_type")) + f" UNION ALL SELECT 'all', NULL, {_AGG}",
    "a2_usage_daily": f"WITH {_C} SELECT {_DAY} AS day, count(*) AS calls, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost FROM c GROUP BY 1",
    "a3_daily_pivot": f"SELECT {_DAY} AS day, " + ", ".join(f"count(*) FILTER (event_type = '{k}') AS {k}" for k in ("view", "click", "purchase", "signup", "error")) + " FROM events GROUP BY 1",
    "a4_quota_rollup": f"WITH {_C}, l AS (SELECT *, strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d') AS day FROM c), g AS (SELECT day, 'user' AS scope, CAST(tenant AS VARCHAR) AS tenant, CAST(user_id AS VARCHAR) AS \"user\", count(*) AS calls, 10::BIGINT AS \"limit\" FROM l GROUP BY day, tenant, user_id UNION ALL SELECT day, 'tenant', CAST(tenant AS VARCHAR), NULL, count(*), 100 FROM l GROUP BY day, tenant UNION ALL SELECT day, 'global', NULL, NULL, count(*), 400 FROM l GROUP BY day) SELECT *, round(calls / \"limit\", 6) AS share FROM g",
    "a6_product_metrics": f"WITH {_C} SELECT tenant, count(*) AS calls, count(DISTINCT user_id) AS users, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END), 6) AS error_rate, round(avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0 END), 6) AS purchase_rate, round(avg(cost), 6) AS mean, round(quantile_cont(cost, 0.5), 6) AS p50, round(quantile_cont(cost, 0.95), 6) AS p95 FROM c GROUP BY 1",
    "a7_alerts": f"WITH {_C} SELECT {_DAY} AS day, tenant, count(*) AS calls, CASE WHEN count(*) < 20 THEN 'quiet' WHEN avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) >= 0.3 THEN 'critical' WHEN avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) >= 0.2 THEN 'warn' ELSE 'ok' END AS level FROM c GROUP BY 1, 2",
    "a8_counters": f"WITH {_C} SELECT 'calls_' || event_type AS name, count(*) AS value, max(tokens) AS gauge FROM c GROUP BY 1",
    "a11_threshold_sweep": "SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (value >= t AND event_type <> 'error') AS false_alarms, count(*) FILTER (value < t AND event_type = 'error') AS misses FROM events, range(5, 105, 5) g(t) GROUP BY 1",
    "w1_state_seconds": "WITH s AS (SELECT user_id, event_type, epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-01-31')) - epoch_us(ts) AS us FROM events) SELECT user_id, event_type, round(sum(us) / 1e6, 3) AS seconds FROM s GROUP BY 1, 2",
    "w2_error_islands": "WITH f AS (SELECT *, event_type = 'error' AS f FROM events), s AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER w, false) THEN 1 ELSE 0 END AS s FROM f WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM s) SELECT user_id, island, count(*) AS n, min(event_id) AS first_event FROM i WHERE f GROUP BY 1, 2",
    "w3_business_seconds": "WITH o AS (SELECT o_orderkey, o_orderdate AS s, o_orderdate + to_hours(o_orderkey % 72) AS e FROM orders), d AS (SELECT *, unnest(range(CAST(s AS DATE)::TIMESTAMP, CAST(e AS DATE)::TIMESTAMP + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS d FROM o) SELECT o_orderkey, round(sum(CASE WHEN dayofweek(d) IN (0, 6) THEN 0 ELSE greatest(epoch_us(least(e, d + INTERVAL 21 HOUR)) - epoch_us(greatest(s, d + INTERVAL 8 HOUR)), 0) END) / 1e6, 3) AS business FROM d GROUP BY 1",
    "w4_availability": f"WITH {_C}, p AS (SELECT tenant, event_type <> 'error' AS ok, coalesce((epoch_us(lead(ts) OVER w) - epoch_us(ts)) / 1e6, 0.0) AS gap, CASE WHEN event_type = 'error' AND coalesce(lag(event_type <> 'error') OVER w, true) THEN 1 ELSE 0 END AS o FROM c WINDOW w AS (PARTITION BY tenant ORDER BY ts, event_id)), s AS (SELECT tenant, round(sum(CASE WHEN ok THEN least(gap, 300.0) ELSE 0.0 END), 3) AS up, round(sum(CASE WHEN NOT ok THEN least(gap, 300.0) ELSE 0.0 END), 3) AS down, round(sum(gap - least(gap, 300.0)), 3) AS unmonitored, CAST(sum(o) AS BIGINT) AS outages FROM p GROUP BY 1) SELECT *, round(up / (up + down), 6) AS share FROM s",
    "w5_hash_chain": "WITH e AS (SELECT *, sha256(event_id || '|' || event_type) AS h FROM events), p AS (SELECT *, lag(h) OVER w AS before, CASE WHEN event_id % 97 = 0 THEN 'tampered' ELSE lag(h) OVER w END AS prev FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count(*) AS entries, count(*) FILTER (before IS DISTINCT FROM prev) AS breaks FROM p GROUP BY 1",
    "w6_threads": "SELECT user_id, count(*) AS turns, arg_min(event_type, (ts, event_id)) AS title, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS updated FROM events GROUP BY 1",
    "w7_retention": "WITH f AS (SELECT user_id, CASE WHEN ts < TIMESTAMP '2024-01-08' THEN 'delete' WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20 THEN 'keep' ELSE 'anonymize' END AS fate FROM events) SELECT user_id, fate, count(*) AS n FROM f GROUP BY 1, 2",
    "ss1_rate_limit": f"WITH {_C}, p AS (SELECT tenant, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS window_no, row_number() OVER (PARTITION BY tenant, CAST(floor(epoch(ts)) AS BIGINT) // 3600 ORDER BY ts, event_id) AS place FROM c) SELECT tenant, window_no, count(*) AS calls, count(*) FILTER (place > 3) AS refused FROM p GROUP BY 1, 2",
    "ss6_late_rows": "WITH r AS (SELECT updated_at, CAST(ingested_at AS DATE) AS day FROM semantic_challenge_v2_chunks), m AS (SELECT day, max(max(updated_at)) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 DAY AS mark FROM r GROUP BY day) SELECT strftime(day, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (updated_at < mark) AS late FROM r JOIN m USING (day) GROUP BY 1",
    "ss9_sliding": "WITH h AS (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s, event_type FROM events) SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n FROM h GROUP BY 1, 2",
    "ss9_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), s AS (SELECT user_id, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM g), n AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM n GROUP BY 1",
    "a19_deadlines": "WITH d AS (SELECT o_orderkey, list_filter([CAST(o_orderdate AS DATE) + 30, CAST(o_orderdate AS DATE) + 60, CAST(o_orderdate AS DATE) + 90], lambda x: x >= DATE '1998-01-01')[1] AS due FROM orders) SELECT o_orderkey, CAST(due AS VARCHAR) AS due, CAST(due - DATE '1998-01-01' AS BIGINT) AS days FROM d WHERE due IS NOT NULL AND due - DATE '1998-01-01' <= 30",
}
