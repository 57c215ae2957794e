"""Connected components of an edge table, by alternating star contraction on DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, alone: int = 0) -> DataFrame:
    """node, component (smallest node reachable) for every node of an edge.

    Each round hangs all larger neighbours of a node on its smallest neighbour and then all smaller-or-equal ones; the
    minimum of a node's neighbours is a partial aggregate, so a hub is one row per task before the exchange.  Rounds
    needed grow with the logarithm of the longest chain.  Null ends and loops are left out.  Up to ``alone`` distinct edges
    are joined in one task, which takes one job instead of several a round.
    """
    current = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    current = core.checkpointed(current.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if current.isEmpty():
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    if alone and current.count() <= alone:
        return core.checkpointed(current.repartition(1).mapInArrow(_joined, "node long, component long"))
    mark = None
    for _ in range(max_rounds):
        # large star: every neighbour above a node goes to the smallest node around it
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, current = current, core.checkpointed(small)
        core.discard(last)
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            root[max(x, y)] = min(x, y)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, type=pa.int64()), pa.array([find(x) for x in nodes], type=pa.int64())], ["node", "component"])
