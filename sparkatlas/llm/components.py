"""Connected components by alternating large-star and small-star rounds, which stay distributed; few edges are one task's work."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkatlas.llm import storage

#: So many edges at most are looked at in one task (a few MB); more go through the rounds. Both give the same.
FEW = 1 << 18


def components(edges: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) for every node of edges (a, b); a written table.

    A node with a large part of all edges is a hot key of the joins: where the minima of all nodes are few enough by
    their count they are broadcast, else written, so that the join's skewed partitions can be split.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    edges = storage.written(edges, "stars")
    if edges.count() <= FEW:
        out = storage.written(edges.coalesce(1).mapInArrow(found, "node long, component long"), "components")
        storage.dropped(edges)
        return out
    first, edges = edges, storage.written(edges.distinct(), "stars")
    storage.dropped(first)
    mark = signature(edges)
    while True:
        few = 2 * mark[0] * (16 + storage.ROW_BYTES) <= storage.BROADCAST_BYTES  # two nodes an edge at most
        minima = lambda df: (F.broadcast(df) if few else storage.written(df, "stars"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = minima(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least_of_large = minima(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least_of_large, "u").select("v", "m").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = storage.written(small.unionByName(least_of_large.select("u", F.col("m").alias("v"))).distinct(), "stars")
        old, edges = edges, new
        before, mark = mark, signature(new)
        storage.dropped(old, *([] if few else [least, least_of_large]))
        if before == mark:
            break
    stars = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    out = storage.written(stars.unionByName(roots), "components")
    storage.dropped(edges)
    return out


def found(batches):
    """node and component of all edges (u, v) of a partition."""
    root: dict[int, int] = {}

    def of(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(y, y)
            x = y
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = of(u), of(v)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([of(x) for x in nodes], np.int64))], ["node", "component"])


def signature(edges: DataFrame) -> tuple:
    """Changes when the edges do; the first is their number."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).collect()[0])
