"""Filling containers of fixed capacity: sum-of-squares online packing over an array of fill levels.

Documents larger than the capacity are cut into full containers and a rest.  Every other piece goes to the fill
level that makes the sum of the squared counts of partly filled containers smallest, a new container counting as
level 0.  Documents are spread over shards by hash; a shard takes its pieces largest first and keeps one array of counts
per capacity.  What the shards leave partly filled, below *settled* of the capacity, is dealt to as few shards as hold
*per_shard* left-overs each and packed again, the fullest first.  Rounds end when one shard is left or the left-overs no
longer fit into fewer shards, as with pieces over half the capacity, so no task ever holds more than about *per_shard*
pieces; what then stays open costs at most the unfilled part of one level array per shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import materialize


def place(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(the container of each item, the fill of each container), items taken in order; sizes in 1..capacity."""
    count = np.zeros(capacity + 1, np.int64)  # containers at each level; 0 and capacity stay 0
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    fill: list[int] = []
    where: list[int] = []
    for s in sizes:
        # taking a container from level h to h + s changes the sum by 2 * (count[h + s] - count[h]) + 2, from level 0 by 2 * count[s] + 1
        top = capacity - s
        best, level = (2 * int(count[s]) + 1 if s < capacity else 0), 0
        if top > 0:
            change = 2 * (count[s + 1 : capacity + 1] - count[1 : top + 1]) + 2
            change[-1] = -2 * count[top] + 1  # fills the container
            change[count[1 : top + 1] == 0] = np.iinfo(np.int64).max
            h = int(top - 1 - np.argmin(change[::-1]))  # of ties the fullest
            if change[h] <= best:
                best, level = int(change[h]), h + 1
        if level:
            box = waiting[level].pop()
            count[level] -= 1
        else:
            box = len(fill)
            fill.append(0)
        fill[box] += s
        where.append(box)
        if fill[box] < capacity:
            waiting[fill[box]].append(box)
            count[fill[box]] += 1
    return where, fill


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard of one round: gives every item its container, named by the shard."""
    pdf = pdf.sort_values(["ord", "item"], kind="stable")
    where, fill = place(pdf["size"].tolist(), int(pdf["capacity_tokens"].iloc[0]))
    name = f"{pdf['round'].iloc[0]}-{pdf['shard'].iloc[0]}-"
    return pd.DataFrame({"pack_id": pdf["pack_id"], "capacity_tokens": pdf["capacity_tokens"], "item": pdf["item"], "size": pdf["size"], "container": [name + str(w) for w in where], "fill": [fill[w] for w in where]})


_PACKED = "pack_id int, capacity_tokens int, item string, size long, container string, fill long"


def pack(sizes: DataFrame, targets: list[tuple[int, int]], doc_id: str = "doc_id", per_shard: int = 50_000, settled: float = 0.98) -> DataFrame:
    """(pack_id, capacity_tokens, container_id, fill_tokens, n_members, members) for each target (pack_id, capacity).

    members are structs (doc_id, part, tokens), part 0 for a whole document, else 1, 2, ... of a document larger
    than the container.  Documents of no tokens and null sizes need no room and are in no container; a repeated
    doc_id is packed as often as it occurs.
    """
    if not targets or any(c is None or c < 1 for _, c in targets):
        raise ValueError("targets need capacities of at least 1")
    goals = F.array(*[F.struct(F.lit(int(p)).alias("pack_id"), F.lit(int(c)).alias("capacity_tokens")) for p, c in targets])
    docs = sizes.filter("n_tokens > 0").groupBy(F.col(doc_id).alias("doc"), "n_tokens").agg(F.count("*").alias("copies"))
    docs = docs.select("doc", "n_tokens", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))  # repeated rows get names of their own
    items = docs.select("doc", "n_tokens", "copy", F.explode(goals).alias("g")).select("doc", "n_tokens", "copy", "g.*")
    items = items.withColumn("full", (F.col("n_tokens") / F.col("capacity_tokens")).cast("long")).withColumn("rest", F.col("n_tokens") - F.col("full") * F.col("capacity_tokens"))
    whole = items.filter("full > 0").withColumn("part", F.explode(F.sequence(F.lit(1).cast("long"), F.col("full"))))
    split = F.col("n_tokens") > F.col("capacity_tokens")
    whole = whole.select("pack_id", "capacity_tokens", "doc", "n_tokens", "copy", F.when(split, F.col("part").cast("int")).otherwise(0).alias("part"), F.col("capacity_tokens").cast("long").alias("size"))
    rest = items.filter("rest > 0").select("pack_id", "capacity_tokens", "doc", "n_tokens", "copy", F.when(split, (F.col("full") + 1).cast("int")).otherwise(0).alias("part"), F.col("rest").alias("size"))
    shards = max(1, -(-rest.count() // (per_shard * len(targets))))
    rest = rest.withColumn("item", F.concat_ws("/", "doc", "n_tokens", "part", "copy"))
    rest = materialize(rest.withColumn("ord", -F.col("size")).withColumn("shard", F.pmod(F.xxhash64(F.lit(3), "item"), F.lit(shards)).cast("int")), "pack-items")
    packed = rest.select("pack_id", "capacity_tokens", "shard", "ord", "item", "size", F.lit(0).alias("round"))
    links: list[DataFrame] = []
    done: DataFrame | None = None
    step = 0
    while True:
        out = materialize(packed.groupBy("pack_id", "shard").applyInPandas(_pack, _PACKED), "packed")
        links.append(out.select("pack_id", "item", "container", "fill"))
        if step and shards == 1:
            break
        open_boxes = out.groupBy("pack_id", "capacity_tokens", "container").agg(F.max("fill").alias("size")).filter(F.col("size") < settled * F.col("capacity_tokens"))
        most = open_boxes.groupBy("pack_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        fewer = max(1, -(-most // per_shard))
        if fewer >= shards and not (step == 0 and shards == 1):
            break
        shards, step = fewer, step + 1
        packed = open_boxes.select("pack_id", "capacity_tokens", (F.pmod(F.xxhash64("container"), F.lit(shards))).cast("int").alias("shard"), (-F.col("size")).alias("ord"), F.col("container").alias("item"), "size", F.lit(step).alias("round"))
    place_of = links[0]
    for nxt in links[1:]:
        moved = nxt.select("pack_id", F.col("item").alias("container"), F.col("container").alias("next"), F.col("fill").alias("next_fill"))
        place_of = place_of.join(moved, ["pack_id", "container"], "left").select("pack_id", "item", F.coalesce("next", "container").alias("container"), F.coalesce("next_fill", "fill").alias("fill"))
    filled = rest.join(place_of, ["pack_id", "item"]).select("pack_id", "capacity_tokens", "container", "doc", "part", "size")
    member = lambda: F.struct(F.col("doc").alias("doc_id"), "part", F.col("size").alias("tokens"))
    boxes = filled.groupBy("pack_id", "capacity_tokens", F.col("container").alias("container_id")).agg(F.sum("size").alias("fill_tokens"), F.count("*").alias("n_members"), F.array_sort(F.collect_list(member())).alias("members"))
    full = whole.select("pack_id", "capacity_tokens", F.concat_ws("-", F.lit("full"), "doc", "n_tokens", "part", "copy").alias("container_id"), F.col("size").alias("fill_tokens"), F.lit(1).cast("long").alias("n_members"), F.array(member()).alias("members"))
    return boxes.unionByName(full)
