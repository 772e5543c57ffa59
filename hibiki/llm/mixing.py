"""Mixing sources to target shares: a multivariate-hypergeometric splitting tree over blocks.

Each source is cut into blocks of documents by hash, a random permutation.  A source's quota of tokens is met by
whole passes over its blocks, then leading blocks, then documents of one last block.  The blocks drawn are dealt to
output shards by a tree: at every node the multivariate hypergeometric distribution says how many blocks of each
source go left, so every split is exact and no block is drawn twice.  Shards are shuffled locally.

The driver sees at most sources * max_blocks * repeats block totals, whatever the number of documents.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources) block counts: *counts* dealt to shards of sizes that differ by one at most."""
    out = np.zeros((shards, len(counts)), np.int64)
    stack = [(0, shards, np.asarray(counts, np.int64))]
    while stack:
        a, b, c = stack.pop()
        if b - a == 1:
            out[a] = c
            continue
        mid = (a + b) // 2
        take = int(c.sum()) * (mid - a) // (b - a)
        left = rng.multivariate_hypergeometric(c, take, method="marginals") if c.sum() else c
        stack += [(a, mid, left), (mid, b, c - left)]
    return out


def feasible_total(tokens: dict[str, int], targets: list[tuple[str, float, int]]) -> float:
    """The largest total at which every source that has tokens can give its share within its repeats."""
    bounds = [r * tokens[s] / share for s, share, r in targets if share > 0 and r > 0 and tokens.get(s)]
    return min(bounds, default=0.0)


def mix(sizes: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None, doc_id: str = "doc_id", source: str = "source", shard_tokens: int = 4_000_000, max_shards: int = 4096, max_blocks: int = 4096, block_docs: int = 64, seed: int = 17) -> DataFrame:
    """(shard, position, source, doc_id, copy_no, n_tokens): the draw, each document at most its source's repeats.

    total: tokens wanted; by default the largest that all sources with documents can serve at their shares.  With a
    larger total a source gives all its repeats and stays below its share.  Sources that are null or no target,
    documents without tokens and targets without documents are not drawn.
    """
    if any(share < 0 or r < 0 for _, share, r in targets):
        raise ValueError("shares and repeats must not be negative")
    spark = sizes.sparkSession
    known = [s for s, _, _ in targets]
    docs = sizes.filter(F.col(source).isin(known) & (F.col("n_tokens") > 0)).select(F.col(source).alias("source"), F.col(doc_id).alias("doc_id"), "n_tokens")
    docs = docs.withColumn("h", F.xxhash64(F.lit(seed), "source", "doc_id"))
    stats = {r["source"]: (r["n"], r["t"]) for r in docs.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t")).collect()}
    n_blocks = {s: max(1, min(max_blocks, math.ceil(n / block_docs))) for s, (n, _) in stats.items()}
    tokens = {s: t for s, (_, t) in stats.items()}
    goal = feasible_total(tokens, targets) if total is None else total
    per_source = F.create_map(*[x for s, n in n_blocks.items() for x in (F.lit(s), F.lit(n))]) if n_blocks else F.create_map(F.lit(""), F.lit(1))
    docs = docs.withColumn("block", F.pmod("h", F.element_at(per_source, F.col("source"))).cast("int"))
    in_block: dict[str, np.ndarray] = {s: np.zeros(n, np.int64) for s, n in n_blocks.items()}
    for r in docs.groupBy("source", "block").agg(F.sum("n_tokens").alias("t")).collect():
        in_block[r["source"]][r["block"]] = r["t"]
    rng = np.random.default_rng(seed)
    units: list[tuple[str, int, int, int | None]] = []
    for s, share, repeats in sorted(targets):
        if s not in in_block:
            continue
        left = min(share * goal, repeats * tokens[s])
        for copy in range(repeats):
            if left <= 0:
                break
            ends = np.cumsum(in_block[s])
            whole = int(np.searchsorted(ends, left, "right"))
            units += [(s, copy, b, None) for b in range(whole)]
            if whole < len(ends):
                rest = left - (int(ends[whole - 1]) if whole else 0)
                if rest > 0:
                    units.append((s, copy, whole, round(rest)))
                break
            left -= int(ends[-1])
    schema = "source string, copy_no int, block int, take long, shard int"
    if not units:
        dealt: list = []
    else:
        names = sorted({u[0] for u in units})
        pools = {s: [u for u in units if u[0] == s] for s in names}
        shards = max(1, min(max_shards, len(units), math.ceil(goal / shard_tokens)))
        deal = split_tree(np.array([len(pools[s]) for s in names]), shards, rng)
        dealt = []
        for k, s in enumerate(names):
            order = rng.permutation(len(pools[s]))
            owner = np.repeat(np.arange(shards), deal[:, k])
            dealt += [(*pools[s][i], int(o)) for i, o in zip(order.tolist(), owner.tolist(), strict=True)]
    units_df = F.broadcast(spark.createDataFrame(dealt, schema))
    drawn = docs.join(units_df, ["source", "block"])
    whole = drawn.filter("take is null").select("shard", "source", "doc_id", "copy_no", "n_tokens", "h")
    before = F.sum("n_tokens").over(W.partitionBy("source", "copy_no", "block").orderBy("h", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    part = drawn.filter("take is not null").withColumn("before", F.coalesce(before, F.lit(0)))
    part = part.filter(F.col("before") + F.col("n_tokens") / 2 <= F.col("take")).select(whole.columns)
    mixed = whole.unionByName(part)
    order = W.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id", "copy_no"), "source", "doc_id", "copy_no")
    return mixed.select("shard", (F.row_number().over(order) - 1).cast("long").alias("position"), "source", "doc_id", "copy_no", "n_tokens")


def shares(drawn: DataFrame, sizes: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """(source, target_share, max_repeats, available_tokens, drawn_docs, drawn_tokens, actual_share, most_repeats) of every target, drawn or not."""
    got = drawn.groupBy("source").agg(F.count("*").alias("drawn_docs"), F.sum("n_tokens").alias("drawn_tokens"), (F.max("copy_no") + 1).alias("most_repeats"))
    there = sizes.groupBy(F.col(source).alias("source")).agg(F.sum("n_tokens").alias("available_tokens"))
    both = targets.select("source", "target_share", "max_repeats").join(there, "source", "left").join(got, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("available_tokens", "drawn_docs", "drawn_tokens", "most_repeats")}
    both = both.withColumns(zero)
    total = F.sum("drawn_tokens").over(W.partitionBy(F.lit(1)))  # one row per target
    return both.select("source", "target_share", "max_repeats", "available_tokens", "drawn_docs", "drawn_tokens", F.when(total > 0, F.col("drawn_tokens") / total).otherwise(0.0).alias("actual_share"), "most_repeats")
