"""Operators over append-only logs: usage, quotas, states, availability, retention, chains, threads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usage_by(calls: DataFrame, keys: list[str], outcome: str, tokens: str, cost: str) -> DataFrame:
    """Calls, failed calls, tokens and cost by each key alone and overall, in one pass over grouping sets.

    (key, value, calls, failed, tokens, cost); a null value of a key is a value of its own, shown as null.
    """
    sets = [[F.col(k)] for k in keys] + [[]]
    grouped = calls.groupingSets(sets, *[F.col(k) for k in keys]).agg(
        F.grouping_id().alias("gid"), F.count("*").alias("calls"), F.sum((F.col(outcome) == "error").cast("long")).alias("failed"), F.sum(tokens).alias("tokens"), F.round(F.sum(cost), 6).alias("cost")
    )
    full = (1 << len(keys)) - 1
    name, value = F.lit("all"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        only = F.col("gid") == (full ^ (1 << (len(keys) - 1 - i)))
        name, value = F.when(only, k).otherwise(name), F.when(only, F.col(k).cast("string")).otherwise(value)
    return grouped.select(name.alias("key"), value.alias("value"), "calls", "failed", "tokens", "cost")


def quota_use(calls: DataFrame, tenant: str, user: str, local_day: Column, limits: dict[str, int]) -> DataFrame:
    """(day, scope, tenant, user, calls, limit, share): use per user, tenant and overall by rollup, against limits by scope."""
    rolled = calls.select(local_day.alias("day"), F.col(tenant).alias("t"), F.col(user).alias("u")).groupingSets([[F.col("day"), F.col("t"), F.col("u")], [F.col("day"), F.col("t")], [F.col("day")]], F.col("day"), F.col("t"), F.col("u")).agg(F.grouping_id().alias("g"), F.count("*").alias("calls"))
    scope = F.when(F.col("g") == 0, "user").when(F.col("g") == 1, "tenant").otherwise("global")
    limit = reduce(lambda acc, kv: F.when(scope == kv[0], F.lit(kv[1])).otherwise(acc), limits.items(), F.lit(None)).cast("long")
    return rolled.select(F.col("day").cast("string").alias("day"), scope.alias("scope"), F.col("t").cast("string").alias("tenant"), F.col("u").cast("string").alias("user"), "calls", limit.alias("limit")).withColumn("share", F.round(F.col("calls") / F.col("limit"), 6))


def state_seconds(changes: DataFrame, key: str, at: str, state: str, now: str, tie: str) -> DataFrame:
    """(key, state, seconds): time spent in each state; a state lasts to the key's next change, the last one to *now*."""
    w = W.partitionBy(key).orderBy(at, tie)
    t = F.col(at).cast("timestamp")
    until = F.coalesce(F.lead(at).over(w), F.lit(now).cast("timestamp_ntz")).cast("timestamp")
    spans = changes.select(key, state, (F.unix_micros(until) - F.unix_micros(t)).alias("us"))
    return spans.groupBy(key, state).agg(F.round(F.sum("us") / 1e6, 3).alias("seconds"))


def islands(rows: DataFrame, key: str, order: list[str], flag: Column) -> DataFrame:
    """rows where the flag holds with *island*, the number of its run of neighbouring flagged rows within the key."""
    w = W.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("__f", F.coalesce(flag, F.lit(False)))
    starts = marked.withColumn("__s", (F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False))).cast("int"))
    return starts.withColumn("island", F.sum("__s").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("long")).filter("__f").drop("__f", "__s")


def business_micros(start: Column, end: Column, open_hour: int = 8, close_hour: int = 21) -> Column:
    """Microseconds of [start, end) on weekdays between the hours, in local time; null for null, 0 for an empty interval."""

    def worked(d: Column) -> Column:
        day = d.cast("timestamp_ntz")
        lo, hi = F.greatest(start, day + F.make_dt_interval(hours=F.lit(open_hour))), F.least(end, day + F.make_dt_interval(hours=F.lit(close_hour)))
        return F.when(F.dayofweek(d).isin(1, 7), F.lit(0).cast("long")).otherwise(F.greatest(F.unix_micros(hi.cast("timestamp")) - F.unix_micros(lo.cast("timestamp")), F.lit(0).cast("long")))

    days = F.sequence(F.to_date(start), F.greatest(F.to_date(start), F.to_date(end)))
    return F.aggregate(F.transform(days, worked), F.lit(0).cast("long"), lambda acc, x: acc + x)


def business_seconds(spans: DataFrame, start: str, end: str, open_hour: int = 8, close_hour: int = 21) -> DataFrame:
    """spans with *business*: seconds of [start, end) on weekdays between the hours; both columns in local time.  One pass, no shuffle."""
    return spans.withColumn("business", F.round(business_micros(F.col(start), F.col(end), open_hour, close_hour) / 1e6, 3))


def by_day(rows: DataFrame, key: str, at: str, tie: str, *carried: str) -> DataFrame:
    """rows with the last and the next row of their key: last_at, next_at and last_<c> for each carried column.

    Windows are per key and day; what lies beyond a day comes from one row per key and day, so a key with a third of all
    rows is spread over its days.
    """
    inner = W.partitionBy(key, "__day").orderBy(at, tie)
    daily = rows.withColumn("__day", F.to_date(at))
    edge = F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), *[F.col(c).alias(c) for c in carried])
    days = daily.groupBy(key, "__day").agg(F.min(F.struct(F.col(at).alias("a"), F.col(tie).alias("t"))).alias("__first"), F.max(edge).alias("__final"))
    outer = W.partitionBy(key).orderBy("__day")
    days = days.select(key, "__day", F.lag("__final").over(outer).alias("__before"), F.lead("__first").over(outer).alias("__after"))
    out = daily.withColumns({"__p": F.lag(edge).over(inner), "__n": F.lead(F.col(at)).over(inner)}).join(days, [key, "__day"], "left")
    last = F.coalesce("__p", "__before")
    return out.select(*rows.columns, last["a"].alias("last_at"), F.coalesce("__n", F.col("__after.a")).alias("next_at"), *[last[c].alias(f"last_{c}") for c in carried])


def availability(probes: DataFrame, key: str, at: str, ok: Column, tie: str, max_gap: int = 300) -> DataFrame:
    """(key, up, down, unmonitored, outages, share): a probe holds to the next one, at most max_gap seconds; the rest is unmonitored.

    share is up / (up + down), null without either; an outage is a run of failed probes.
    """
    rows = by_day(probes.select(key, at, tie, ok.alias("ok")), key, at, tie, "ok")
    gap = (F.unix_micros(F.col("next_at").cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))) / 1e6
    rows = rows.select(key, "ok", F.coalesce(gap, F.lit(0.0)).alias("gap"), (~F.col("ok") & F.coalesce("last_ok", F.lit(True))).cast("long").alias("first_down"))
    held = F.least("gap", F.lit(float(max_gap)))
    out = rows.groupBy(key).agg(
        F.round(F.sum(F.when(F.col("ok"), held).otherwise(0.0)), 3).alias("up"), F.round(F.sum(F.when(~F.col("ok"), held).otherwise(0.0)), 3).alias("down"), F.round(F.sum(F.col("gap") - held), 3).alias("unmonitored"), F.sum("first_down").alias("outages")
    )
    return out.withColumn("share", F.round(F.col("up") / (F.col("up") + F.col("down")), 6))


def held_intervals(probes: DataFrame, key: str, at: str, ok: Column, tie: str, max_gap: int = 300) -> DataFrame:
    """(key, start, end, ok): each probe holds until the next one of its key, at most max_gap seconds; the last one holds for nothing."""
    rows = by_day(probes.select(key, at, tie, ok.alias("ok")), key, at, tie).filter("next_at is not null")
    end = F.least("next_at", F.col(at) + F.make_dt_interval(secs=F.lit(max_gap)))
    return rows.select(key, F.col(at).alias("start"), end.alias("end"), "ok")


def chain_breaks(ledger: DataFrame, key: str, order: list[str], digest: str, previous: str) -> DataFrame:
    """(key, entries, breaks): entries whose stored previous digest is not the digest before; the first has none."""
    w = W.partitionBy(key).orderBy(*order)
    bad = ~F.col(previous).eqNullSafe(F.lag(digest).over(w))
    return ledger.select(key, bad.cast("long").alias("bad")).groupBy(key).agg(F.count("*").alias("entries"), F.sum("bad").alias("breaks"))


def threads(turns: DataFrame, thread: str, at: str, text: str, tie: str) -> DataFrame:
    """(thread, turns, title, updated): number of turns, the first text and the last time."""
    return turns.groupBy(thread).agg(F.count("*").alias("turns"), F.min_by(text, F.struct(at, tie)).alias("title"), F.max(at).alias("updated"))


def retention(rows: DataFrame, key: str, at: str, tie: str, cutoff: str, newest: int) -> DataFrame:
    """rows with *fate*: delete before the cut-off, keep the newest of each key, anonymize the others."""
    w = W.partitionBy(key).orderBy(F.desc(at), F.desc(tie))
    fate = F.when(F.col(at) < F.lit(cutoff).cast("timestamp_ntz"), "delete").when(F.row_number().over(w) <= newest, "keep").otherwise("anonymize")
    return rows.withColumn("fate", fate)


def rate_limited(calls: DataFrame, bucket: str, at: str, tie: str, limit: int, seconds: int) -> DataFrame:
    """calls with *place* in their fixed window and *allowed*; a call over the limit still counts."""
    start = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / seconds)
    w = W.partitionBy(bucket, "window_no").orderBy(at, tie)
    numbered = calls.withColumn("window_no", start).withColumn("place", F.row_number().over(w).cast("long"))
    return numbered.withColumn("allowed", F.col("place") <= limit)


def threshold_sweep(rows: DataFrame, score: str, positive: Column, grid: list[float]) -> DataFrame:
    """(threshold, false_alarms, misses): of rows at or above and below each threshold, counted in one pass."""
    aggs = []
    for i, g in enumerate(grid):
        aggs += [F.sum(((F.col(score) >= g) & ~positive).cast("long")).alias(f"a{i}"), F.sum(((F.col(score) < g) & positive).cast("long")).alias(f"m{i}")]
    wide = rows.agg(*aggs)
    each = F.array(*[F.struct(F.lit(float(g)).alias("threshold"), F.col(f"a{i}").alias("false_alarms"), F.col(f"m{i}").alias("misses")) for i, g in enumerate(grid)])
    return wide.select(F.explode(each).alias("e")).select("e.*")
