"""Statistics over the event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import stats as S
from ..sources.tables import table


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _weeks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = _events(spark, d)
    return e.filter("ts < timestamp_ntz'2024-01-08'"), e.filter("ts >= timestamp_ntz'2024-01-22' and ts < timestamp_ntz'2024-01-29'")


def _rates(spark: SparkSession, d: str) -> DataFrame:
    """Per user and kind of event, a p-value-like number from the share of the user's rows."""
    per = _events(spark, d).groupBy("event_type", "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return per.select("event_type", "user_id", F.least(F.lit(1.0), F.col("v") / 500 / F.col("n")).alias("p"))


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", (F.col("l_discount") * 9).alias("score"), (F.round(F.col("l_tax") * 100).cast("int") % 3 == 0).alias("hit"), "l_tax")


def a10_latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.latency_summary(_events(spark, d), "event_type", "value")


def st2_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    per = _events(spark, d).groupBy("user_id").agg(F.sum((F.col("event_type") == "purchase").cast("long")).alias("v"), F.count("*").alias("w"))
    return S.poisson_bootstrap(per, "user_id", "v", "w")


def st3_mcnemar(spark: SparkSession, d: str) -> DataFrame:
    """Per day: users with errors but no purchases against the reverse."""
    per = _events(spark, d).groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.max((F.col("event_type") == "error").cast("int")).alias("x"), F.max((F.col("event_type") == "purchase").cast("int")).alias("y"))
    days = per.groupBy("day").agg(F.sum(((F.col("x") == 1) & (F.col("y") == 0)).cast("long")).alias("b"), F.sum(((F.col("x") == 0) & (F.col("y") == 1)).cast("long")).alias("c"))
    return days.select(F.col("day").cast("string").alias("day"), "b", "c", F.round(F.round(S.mcnemar_p("b", "c"), 12), 6).alias("p"))


def st5_holm(spark: SparkSession, d: str) -> DataFrame:
    return S.holm(_rates(spark, d), "event_type", "user_id", "p")


def st5_benjamini_hochberg(spark: SparkSession, d: str) -> DataFrame:
    return S.benjamini_hochberg(_rates(spark, d), "event_type", "user_id", "p")


def st8_psi(spark: SparkSession, d: str) -> DataFrame:
    return S.psi(*_weeks(spark, d), "value")


def st9_ks(spark: SparkSession, d: str) -> DataFrame:
    return S.ks(*_weeks(spark, d), "value")


def st10_pareto(spark: SparkSession, d: str) -> DataFrame:
    return S.pareto_front(table(spark, d, "part"), "p_partkey", "p_size", "p_retailprice")


def st11_upper_bound(spark: SparkSession, d: str) -> DataFrame:
    per = _events(spark, d).groupBy("user_id").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("k"), F.count("*").alias("n"))
    return per.select("user_id", "k", "n", F.round(S.binomial_upper("k", "n"), 6).alias("upper"))


def st12_two_proportions(spark: SparkSession, d: str) -> DataFrame:
    a, b = (w.groupBy("event_type").agg(F.count("*").alias("k")) for w in _weeks(spark, d))
    na, nb = (w.agg(F.count("*").alias("n")).select("n").scalar() for w in _weeks(spark, d))
    both = a.select("event_type", F.col("k").alias("ka")).join(b.select("event_type", F.col("k").alias("kb")), "event_type")
    pool = (F.col("ka") + F.col("kb")) / (na + nb)
    z = (F.col("kb") / nb - F.col("ka") / na) / F.sqrt(pool * (1 - pool) * (1 / na.cast("double") + 1 / nb.cast("double")))
    return both.select("event_type", "ka", "kb", F.round(z, 6).alias("z")).select("*", F.round(S.normal_two_sided("z"), 6).alias("p"))


def st13_ece(spark: SparkSession, d: str) -> DataFrame:
    return S.calibration_error(_scored(spark, d), "score", "hit")


def st13_aurc(spark: SparkSession, d: str) -> DataFrame:
    return S.risk_coverage(_scored(spark, d), "score", "hit")


def st13_conformal(spark: SparkSession, d: str) -> DataFrame:
    return S.conformal_threshold(_events(spark, d), "value")


def st13_isotonic(spark: SparkSession, d: str) -> DataFrame:
    return S.isotonic(_scored(spark, d).withColumn("x", F.round("score", 6)), "l_returnflag", "x", "hit")


def st1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of prices per flag, by places in range partitions."""
    out = S.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.95])
    return out.select("l_returnflag", "n", *[F.round(F.col("p")[i], 4).alias(c) for i, c in enumerate(("p01", "p50", "p95"))])


def _halves(spark: SparkSession, d: str) -> DataFrame:
    """Per user: the share of errors in the second half of the month less that in the first."""
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    bad = (F.col("event_type") == "error").cast("double")
    per = _events(spark, d).groupBy("user_id").agg(F.avg(F.when(late, bad)).alias("b"), F.avg(F.when(~late, bad)).alias("a"))
    return per.select("user_id", F.round(F.col("b") - F.col("a"), 6).alias("x")).filter("x is not null")


def st4_sign_flip(spark: SparkSession, d: str) -> DataFrame:
    return S.sign_flip(_halves(spark, d), "user_id", "x")


def st6_non_inferior(spark: SparkSession, d: str) -> DataFrame:
    """The mean change of the users' shares of errors, turned so that more is better, with its interval and the verdict."""
    one = S.poisson_bootstrap(_halves(spark, d).select("user_id", (-F.col("x")).alias("v"), F.lit(1).alias("w")), "user_id", "v", "w")
    return one.select("*", S.non_inferior(F.col("low"), 0.05).alias("non_inferior"))


def st7_sample_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Per kind of event: rows for an interval of two points, its present half width, and pairs to see a change of a tenth."""
    per = _events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"))
    all_rows = _events(spark, d).agg(F.count("*").alias("t")).select("t").scalar()
    p = F.round(F.col("n") / all_rows, 6)
    return per.select("event_type", p.alias("p")).select("event_type", "p", S.needed_for_width(F.col("p"), 0.02).alias("for_width"), F.round(S.half_width(F.col("p"), all_rows), 6).alias("half_width"), S.needed_for_difference(F.round(F.col("p") / 10, 6), F.col("p")).alias("for_change"))


QUERIES = {f.__name__: f for f in (st1_percentiles, st4_sign_flip, st6_non_inferior, st7_sample_sizes, a10_latency_summary, st2_bootstrap, st3_mcnemar, st5_holm, st5_benjamini_hochberg, st8_psi, st9_ks, st10_pareto, st11_upper_bound, st12_two_proportions, st13_ece, st13_aurc, st13_conformal, st13_isotonic)}

_W1, _W4 = "ts < TIMESTAMP '2024-01-08'", "ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29'"
_R = "r AS (SELECT event_type, user_id, least(1.0, avg(value) / 500 / count(*)) AS p FROM events GROUP BY 1, 2)"
_CUTS = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183]
_DRAW = " + ".join(f"(CASE WHEN u >= {c!r} THEN 1 ELSE 0 END)" for c in _CUTS)
_SC = "s AS (SELECT l_discount * 9 AS score, CAST(round(l_tax * 100) AS INTEGER) % 3 = 0 AS hit FROM lineitem)"
_HALVES = "h AS (SELECT user_id, round(avg(CASE WHEN ts >= TIMESTAMP '2024-01-16' THEN CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END END) - avg(CASE WHEN ts < TIMESTAMP '2024-01-16' THEN CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END END), 6)::DOUBLE AS x FROM events GROUP BY 1 HAVING x IS NOT NULL)"
_U = lambda seed: f"CAST(CAST('0x' || substr(md5('{seed}:' || (rep // 4) || ':' || user_id), CAST(8 * (rep % 4) + 1 AS INTEGER), 8) AS BIGINT) AS DOUBLE) / 4294967296.0"
_Z, _ZP = S.normal_quantile(0.975), S.normal_quantile(0.975) + S.normal_quantile(0.8)


def upper_sql(rows: str, keys: str) -> str:
    """The exact upper bound of k of n by bisection, sixty steps of a recursive query over *rows* (keys, k, n)."""
    tail = "list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))))"
    return f"""WITH RECURSIVE r AS ({rows}), b AS (SELECT *, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS step FROM r UNION ALL
SELECT {keys}, k, n, CASE WHEN tail > 0.05 THEN p ELSE lo END, CASE WHEN tail > 0.05 THEN hi ELSE p END, step + 1 FROM (SELECT *, {tail} AS tail FROM (SELECT *, (lo + hi) / 2 AS p FROM b WHERE step < 60)))
SELECT {keys}, k, n, CASE WHEN n = 0 OR k >= n THEN 1.0 ELSE round((lo + hi) / 2, 6) END::DOUBLE AS upper FROM b WHERE step = 60"""


SQL = {
    "st11_upper_bound": upper_sql("SELECT user_id, count(*) FILTER (event_type = 'error') AS k, count(*) AS n FROM events GROUP BY 1", "user_id"),
    "st1_percentiles": "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.01), 4) AS p01, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95 FROM lineitem GROUP BY 1",
    "st4_sign_flip": f"WITH {_HALVES}, r AS (SELECT *, unnest(range(400)) AS rep FROM h), s AS (SELECT rep, abs(sum(CASE WHEN {_U('s')} < 0.5 THEN x ELSE -x END)) AS s FROM r GROUP BY 1), o AS (SELECT abs(sum(x)) AS o, avg(x) AS m FROM h) SELECT round(m, 6) AS mean, round(((SELECT count(*) FROM s, o WHERE s >= o - 1e-9) + 1) / 401.0, 6)::DOUBLE AS p FROM o",
    "st6_non_inferior": f"WITH {_HALVES}, r AS (SELECT *, unnest(range(200)) AS rep FROM h), u AS (SELECT *, {_U('b')} AS u FROM r), s AS (SELECT rep, sum(-x * ({_DRAW})) AS v, sum({_DRAW}) AS w FROM u GROUP BY 1), o AS (SELECT (SELECT round(avg(-x), 6) FROM h) AS estimate, round(quantile_cont(v / w, 0.025), 6) AS low, round(quantile_cont(v / w, 0.975), 6) AS high FROM s) SELECT *, low > -0.05 AS non_inferior FROM o",
    "st7_sample_sizes": f"WITH p AS (SELECT event_type, round(count(*) / (SELECT count(*) FROM events), 6)::DOUBLE AS p FROM events GROUP BY 1) SELECT event_type, p, CAST(ceil({_Z!r} * {_Z!r} * p * (1 - p) / 0.0004) AS BIGINT) AS for_width, round({_Z!r} * sqrt(p * (1 - p) / (SELECT count(*) FROM events)), 6) AS half_width, CAST(ceil({_ZP!r} * {_ZP!r} * p / (round(p / 10, 6) * round(p / 10, 6))) AS BIGINT) AS for_change FROM p",
    "st13_isotonic": f"WITH {_SC}, g AS (SELECT l_returnflag, round(score, 6) AS x, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS m, count(*) AS n FROM (SELECT l_returnflag, l_discount * 9 AS score, CAST(round(l_tax * 100) AS INTEGER) % 3 = 0 AS hit FROM lineitem) GROUP BY 1, 2), seg AS (SELECT a.l_returnflag, a.x AS lo, b.x AS hi, sum(c.m * c.n) / sum(c.n) AS v FROM g a JOIN g b ON a.l_returnflag = b.l_returnflag AND b.x >= a.x JOIN g c ON c.l_returnflag = a.l_returnflag AND c.x BETWEEN a.x AND b.x GROUP BY 1, 2, 3), inner_min AS (SELECT p.l_returnflag, p.x, s.lo, min(s.v) AS v FROM g p JOIN seg s ON s.l_returnflag = p.l_returnflag AND s.lo <= p.x AND s.hi >= p.x GROUP BY 1, 2, 3) SELECT l_returnflag, x, round(max(v), 6) AS fitted FROM inner_min GROUP BY 1, 2",
    "a10_latency_summary": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, quantile_disc(value, 0.95) AS p95_nearest FROM events GROUP BY 1",
    "st2_bootstrap": f"""WITH c AS (SELECT user_id, count(*) FILTER (event_type = 'purchase') AS v, count(*) AS w FROM events GROUP BY 1), r AS (SELECT *, unnest(range(200)) AS rep FROM c),
u AS (SELECT *, CAST(CAST('0x' || substr(md5('b:' || (rep // 4) || ':' || user_id), CAST(8 * (rep % 4) + 1 AS INTEGER), 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u FROM r), s AS (SELECT rep, sum(v * ({_DRAW})) AS v, sum(w * ({_DRAW})) AS w FROM u GROUP BY 1)
SELECT (SELECT round(sum(v) / sum(w), 6) FROM c) AS estimate, round(quantile_cont(v / w, 0.025), 6) AS low, round(quantile_cont(v / w, 0.975), 6) AS high FROM s""",
    "st3_mcnemar": """WITH u AS (SELECT CAST(ts AS DATE) AS day, user_id, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS x, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS y FROM events GROUP BY 1, 2),
d AS (SELECT day, count(*) FILTER (x = 1 AND y = 0) AS b, count(*) FILTER (x = 0 AND y = 1) AS c FROM u GROUP BY 1),
t AS (SELECT day, b, c, unnest(range(0, least(b, c) + 1)) AS i FROM d)
SELECT CAST(day AS VARCHAR) AS day, b, c, round(round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2)))) END, 12), 6) AS p FROM t GROUP BY 1, 2, 3""",
    "st5_holm": f"WITH {_R}, x AS (SELECT event_type, user_id, p, least(1.0, (count(*) OVER (PARTITION BY event_type) - row_number() OVER w + 1) * p) AS x FROM r WINDOW w AS (PARTITION BY event_type ORDER BY p, user_id)) SELECT event_type, user_id, round(max(x) OVER (PARTITION BY event_type ORDER BY p, user_id ROWS UNBOUNDED PRECEDING), 6) AS adjusted FROM x",
    "st5_benjamini_hochberg": f"WITH {_R}, x AS (SELECT event_type, user_id, p, least(1.0, p * count(*) OVER (PARTITION BY event_type) / row_number() OVER w) AS x FROM r WINDOW w AS (PARTITION BY event_type ORDER BY p, user_id)) SELECT event_type, user_id, round(min(x) OVER (PARTITION BY event_type ORDER BY p, user_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS adjusted FROM x",
    "st8_psi": f"""WITH e AS (SELECT quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM events WHERE {_W1}),
b AS (SELECT len(list_filter(e, lambda x: value > x)) AS bin, count(*) FILTER ({_W1}) AS a, count(*) FILTER ({_W4}) AS b FROM events, e GROUP BY 1),
s AS (SELECT greatest(a / (SELECT sum(a) FROM b), 1e-6) AS a, greatest(b / (SELECT sum(b) FROM b), 1e-6) AS b FROM b WHERE a + b > 0) SELECT round(sum((b - a) * ln(b / a)), 6) AS psi FROM s""",
    "st9_ks": f"""WITH v AS (SELECT value AS x, CASE WHEN {_W1} THEN 1 ELSE 0 END AS a FROM events WHERE ({_W1}) OR ({_W4})), c AS (SELECT sum(a) OVER w AS ca, sum(1 - a) OVER w AS cb FROM v WINDOW w AS (ORDER BY x RANGE UNBOUNDED PRECEDING))
SELECT round(max(abs(ca / (SELECT sum(a) FROM v) - cb / (SELECT sum(1 - a) FROM v))), 6) AS d, CAST(max(ca) AS BIGINT) AS n_a, CAST(max(cb) AS BIGINT) AS n_b FROM c""",
    "st10_pareto": "SELECT p_partkey, p_size, p_retailprice FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_size >= a.p_size AND b.p_retailprice <= a.p_retailprice AND (b.p_size > a.p_size OR b.p_retailprice < a.p_retailprice))",
    "st13_ece": f"WITH {_SC}, b AS (SELECT least(floor(score * 10), 9) AS b, count(*) AS n, avg(score) AS s, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS h FROM s GROUP BY 1) SELECT round(sum(n * abs(s - h)) / sum(n), 6) AS ece FROM b",
    "st13_aurc": f"WITH {_SC}, p AS (SELECT score, count(*) AS n, count(*) FILTER (NOT hit) AS w FROM s GROUP BY 1), c AS (SELECT n, sum(n) OVER o AS cn, sum(w) OVER o AS cw FROM p WINDOW o AS (ORDER BY score DESC)) SELECT round(sum(n * (cw / cn)) / sum(n), 6) AS aurc FROM c",
    "st13_conformal": "WITH r AS (SELECT value, row_number() OVER (ORDER BY value) AS i FROM events) SELECT value AS threshold FROM r WHERE i = (SELECT CAST(ceil((count(*) + 1) * 0.9) AS BIGINT) FROM events)",
}
