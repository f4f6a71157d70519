"""Connected components of a table of links: union-find inside partitions, then alternating stars over all of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import hold

#: Links that one task joins by union-find at a time.
BLOCK = 500_000


def _local_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a partition as stars: each node but its set's least one, linked to that one."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def stars() -> pa.RecordBatch:
        found = [(x, r) for x in parent if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([r for _, r in found], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) > BLOCK:
            yield stars()
            parent.clear()
    yield stars()


def connected(links: DataFrame, rounds: int = 60, in_one: int = BLOCK // 2) -> DataFrame:
    """node and root (the least id of its component) for every node of the links (a, b) that is not itself a root.

    An empty table gives an empty one. Self links are ignored. Up to `in_one` links, a bound well within a task's memory,
    are joined at once; beyond it, each round replaces the links by ones to lesser nodes (large star, then small star) and is written out, until a round changes nothing.
    """
    edges = hold(links.select("a", "b").mapInArrow(_local_forest, "u long, v long"), "stars")
    if edges.count() <= in_one:  # few enough for one union-find, whose result is the whole answer
        edges = hold(edges.coalesce(1).mapInArrow(_local_forest, "u long, v long"), "forest")
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = hold(small.distinct(), "round")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
