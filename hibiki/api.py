"""The engine in a few calls, all lazy: search, answer, evaluate, compare and the reports."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from .operators import logs, metrics, reconcile, retrieval, stats
from .sources import store
from .sources.tables import materialize


@dataclass(frozen=True)
class Options:
    """Knobs of a search with their usual values."""

    top_k: int = 10
    lane_k: int = 20
    k1: float = 1.5
    b: float = 0.75
    rrf_k: int = 60
    fusion: str = "rrf"  # rrf, dbsf, keyword_only or dense_only
    weights: dict[str, float] = field(default_factory=lambda: {"dense": 1.0, "keyword": 1.0, "exact": 1.0})
    routed: bool = False
    per_page: int | None = None
    context_chars: int | None = None
    tenant: str | None = None
    where: dict | None = None

    def __post_init__(self) -> None:
        if self.fusion not in ("rrf", "dbsf", "keyword_only", "dense_only"):
            raise ValueError(f"unknown fusion {self.fusion}")
        if min(self.top_k, self.lane_k) < 1 or self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("top_k and lane_k must be at least 1, k1 at least 0 and b between 0 and 1")


def search(queries: DataFrame, corpus: DataFrame, options: Options = Options()) -> DataFrame:
    """(q, doc, rank, fused): the best chunks of each query.

    queries: q, query.  corpus: doc, text, and what the options name (tenant_id, source_doc, columns of the where
    clause).  Filters stand before scoring, so they reach the scan.  Null texts and queries match nothing.
    """
    rows = corpus.filter(store.where(options.where))
    if options.tenant is not None:
        rows = rows.filter(store.tenant_is(options.tenant))
    asked = queries.select(F.col("q").cast("long").alias("q"), X.heuristic_tokens(F.col("query")).alias("tokens"))
    docs = rows.select(F.col("doc").cast("long").alias("doc"), X.heuristic_tokens(F.col("text")).alias("tokens"))
    scored = materialize(retrieval.lanes(docs, asked, max(options.lane_k, options.top_k), options.k1, options.b), "lanes")
    named = {"dense": retrieval.dense_lane(scored, options.lane_k), "keyword": retrieval.keyword_lane(scored, options.lane_k), "exact": retrieval.exact_lane(scored, options.lane_k)}
    if options.fusion in ("keyword_only", "dense_only"):
        lane = named[options.fusion.removesuffix("_only")]
        out = lane.select("q", "doc", "rank", F.col("score").alias("fused"))
    else:
        lanes = retrieval.union_lanes(named)
        if options.fusion == "dbsf":
            fused = retrieval.dbsf(lanes, options.weights["exact"])
        else:
            weight: Column = F.lit(1.0)
            for name, w in options.weights.items():
                weight = F.when(F.col("lane") == name, w).otherwise(weight)
            if options.routed:
                kinds = queries.select(F.col("q").cast("long").alias("q"), retrieval.query_type(F.col("query")).alias("kind"))
                lanes, weight = lanes.join(kinds, "q"), weight * retrieval.routed_weight(F.col("kind"), F.col("lane"))
            fused = retrieval.rrf(lanes, weight, options.rrf_k)
        out = retrieval.hybrid_topk(lanes, fused, max(options.lane_k, options.top_k)).select("q", "doc", "rank", "fused")
    if options.per_page is not None:
        out = retrieval.diverse(out.join(rows.select(F.col("doc").cast("long").alias("doc"), "source_doc"), "doc"), "source_doc", options.per_page)
    if options.context_chars is not None:
        sized = out.join(rows.select(F.col("doc").cast("long").alias("doc"), F.length("text").alias("__chars")), "doc")
        out = retrieval.context_cut(sized, "__chars", options.context_chars)
    again = retrieval.ranked(out.withColumnRenamed("rank", "__old"), F.col("__old"), name="rank", k=options.top_k)
    return again.select("q", "doc", "rank", "fused")


def answer(queries: DataFrame, approved: DataFrame) -> DataFrame:
    """(q, qa_id, how) of the queries that an approved question or alias answers exactly."""
    return reconcile.lookup(queries, "q", "query", approved.filter("status = 'approved'"), "qa_id", "question", "approved_aliases")


def evaluate(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(queries, hit, recall, mrr, ndcg) of a run (q, doc, rank) against qrels (q, item, grade)."""
    return metrics.summary(metrics.at_k(run.select("q", F.col("doc").alias("item"), "rank"), qrels, k))


def compare(a: DataFrame, b: DataFrame, qrels: DataFrame, metric: str = "mrr", k: int = 10) -> DataFrame:
    """(improved, worsened, unchanged, p): queries that change from run a to run b, with the exact two-sided p."""
    one = lambda r: metrics.at_k(r.select("q", F.col("doc").alias("item"), "rank"), qrels, k)
    changes = metrics.paired_changes(one(a), one(b), metric)
    n = lambda s: F.coalesce(F.sum(F.when(F.col("state") == s, F.col("n"))), F.lit(0)).alias(s)
    wide = changes.agg(n("improved"), n("worsened"), n("unchanged"))
    return wide.withColumn("p", F.round(stats.mcnemar_p("improved", "worsened"), 6))


def usage_report(calls: DataFrame, keys: list[str], outcome: str = "outcome", tokens: str = "tokens", cost: str = "cost") -> DataFrame:
    return logs.usage_by(calls, keys, outcome, tokens, cost)


def availability_report(probes: DataFrame, key: str = "target", at: str = "t", ok: str = "ok", tie: str = "id", max_gap: int = 300, target: float = 0.99) -> DataFrame:
    out = logs.availability(probes, key, at, F.col(ok), tie, max_gap)
    return out.withColumn("met", F.col("share") >= target)


def drift_report(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """(psi, d, verdict) of one value between two periods."""
    psi, ks = stats.psi(reference, current, value).select("psi").scalar(), stats.ks(reference, current, value).select("d").scalar()
    one = reference.sparkSession.range(1).select(psi.alias("psi"), ks.alias("d"))
    return one.select("psi", "d", F.when((F.col("psi") >= 0.25) | (F.col("d") >= 0.2), "alert").when((F.col("psi") >= 0.1) | (F.col("d") >= 0.1), "warn").otherwise("ok").alias("verdict"))
