"""Mixing sources to target weights by the cube method: balanced sampling of whole documents.

Each source has a target in words. Its documents are all taken floor(target / size) times, and the rest of the ratio is
every document's probability of one more time. The flight moves three probabilities at once along the null space of the
two constraints (document total, word total) until one of them is 0 or 1, so both totals stay exact. It runs in blocks of
bounded size in parallel; each block leaves two open documents at most, these meet in blocks again, and at the end two
open documents of a source are rounded to the side that is nearest in words.

Defined results: null and empty texts have size 0 and add nothing. Sources rank by code point, null last. A source of
size 0 has target 0. An empty table gives an empty one. Each row is a unit of its own, also where ids or whole rows repeat.
The order of units comes from a keyed hash of id, content and the number of the copy, so reruns agree, however the rows lie.
"""

from __future__ import annotations

import random
from itertools import product

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import hold, sized, word_count

WEIGHTS = (3, 1, 2)
#: Units in a block of the flight, in the mean.
BLOCK = 4000
_SNAP = 1e-9


def fly(pi: list[float], sizes: list[float], rng: random.Random) -> list[float]:
    """Moves `pi` to 0 or 1 but for two at most; sum(pi) and sum(pi * size) keep their values, and each pi its expectation."""
    pi = list(pi)
    waiting = iter([k for k, p in enumerate(pi) if _SNAP < p < 1 - _SNAP])
    held: list[int] = []
    while True:
        while len(held) < 3 and (k := next(waiting, None)) is not None:
            held.append(k)
        if len(held) == 3:
            a, b, c = (sizes[k] for k in held)
            u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        elif len(held) == 2 and sizes[held[0]] == sizes[held[1]]:
            u = (1.0, -1.0)
        else:
            break
        ahead = back = float("inf")
        for k, v in zip(held, u, strict=True):
            if v > 0:
                ahead, back = min(ahead, (1 - pi[k]) / v), min(back, pi[k] / v)
            elif v < 0:
                ahead, back = min(ahead, pi[k] / -v), min(back, (1 - pi[k]) / -v)
        step = ahead if rng.random() * (ahead + back) < back else -back
        still = []
        for k, v in zip(held, u, strict=True):
            p = pi[k] + step * v
            pi[k] = 0.0 if p <= _SNAP else 1.0 if p >= 1 - _SNAP else p
            if 0 < pi[k] < 1:
                still.append(k)
        held = still
    return [0.0 if p <= _SNAP else 1.0 if p >= 1 - _SNAP else p for p in pi]


def land(pi: list[float], sizes: list[float]) -> list[float]:
    """Rounds the open probabilities, two at most, to the word total nearest to theirs (then the document total)."""
    open_ = [k for k, p in enumerate(pi) if 0 < p < 1]
    words, docs = sum(pi[k] * sizes[k] for k in open_), sum(pi[k] for k in open_)
    best = min(product((0.0, 1.0), repeat=len(open_)), key=lambda s: (abs(sum(x * sizes[k] for x, k in zip(s, open_, strict=True)) - words), abs(sum(s) - docs), s))
    out = list(pi)
    for k, x in zip(open_, best, strict=True):
        out[k] = x
    return out


def targets(units: DataFrame, percent: int = 150, weights: tuple[int, ...] = WEIGHTS, most: int = 2) -> DataFrame:
    """source, source_size, docs, target: `percent` of all sizes shared by weight, no target above `most` times its source.

    With sources in order of cap / weight, the share of a unit of weight that fills the budget is the greatest of
    (budget - caps before) / (weights from here on). One row for each source goes through these windows.
    """
    by = units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))
    by = by.withColumn("w", F.get(F.array(*map(F.lit, weights)), (rank - 1) % len(weights)).cast("double")).withColumn("cap", (most * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    all_ = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    by = by.withColumn("level", (F.sum("source_size").over(all_) * percent / 100 - before) / after)
    return by.select("source", "source_size", "docs", F.least("cap", F.col("w") * F.max("level").over(all_)).alias("target"))


def _flight(key: int, last: bool):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        # The largest come first, so those left open are among the smallest.
        group = group.sort_values(["size", "order", "doc_id"], ascending=[False, True, True], kind="stable", ignore_index=True)
        rng = random.Random(f"{key}/{group['source'].iloc[0]!r}/{group['block'].iloc[0]}/{len(group)}")
        sizes = group["size"].astype(float).tolist()
        pi = fly(group["pi"].tolist(), sizes, rng)
        group["pi"] = land(pi, sizes) if last else pi
        return group

    return run


def _units(docs: DataFrame, content: Column) -> DataFrame:
    """doc_id, source, size, content, nth: rows that are alike in these are counted, and numbered from 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), content.alias("content"))
    alike = rows.groupBy("doc_id", "source", "size", "content").agg(F.count(F.lit(1)).alias("n"))
    blocks = alike.withColumn("from", F.explode(F.sequence(F.lit(1), "n", F.lit(BLOCK).cast("long"))))
    return blocks.select("doc_id", "source", "size", "content", F.explode(F.sequence("from", F.least("n", F.col("from") + BLOCK - 1))).alias("nth"))


def decide(docs: DataFrame, key: int = 20240501, percent: int = 150, content: Column | None = None) -> DataFrame:
    """doc_id, source, size, content, source_size, target, copies (times that the document is taken) for each row of `docs`.

    `content` is a hash that tells rows of one id apart, by default that of the text.
    """
    units = hold(_units(docs, F.xxhash64("text") if content is None else content), "sizes")
    aims = sized(hold(targets(units, percent), "targets").withColumnRenamed("source", "of"), 100_000)
    ratio = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size"), 12)).otherwise(F.lit(0.0))
    dealt = units.join(aims, F.col("source").eqNullSafe(F.col("of"))).withColumn("base", F.floor(ratio).cast("int")).withColumn("pi", ratio - F.col("base"))
    dealt = dealt.withColumn("order", F.xxhash64("doc_id", "content", "nth", F.lit(key)))
    columns = "doc_id long, source string, size long, content long, source_size long, target double, base int, pi double, order long, docs long, block long"
    blocks = F.ceil(F.col("docs") / BLOCK)
    first = dealt.withColumn("block", F.pmod(F.xxhash64("order"), blocks)).select(*(c.split()[0] for c in columns.split(", ")))
    settled = []
    state = hold(first.groupBy("source", "block").applyInPandas(_flight(key, False), columns), "flight")
    while True:
        settled.append(state.filter("pi = 0 or pi = 1"))
        rest = state.filter("pi > 0 and pi < 1")
        left = rest.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        most = left.agg(F.max("n")).first()[0]
        if not most:
            break
        # A source whose open documents fit one block lands now.
        counted = rest.drop("block").join(sized(hold(left.withColumnRenamed("source", "of"), "open"), 100_000), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        again = counted.withColumn("block", F.pmod(F.xxhash64("order"), F.ceil(F.col("n") / BLOCK))).drop("n").select(*(c.split()[0] for c in columns.split(", ")))
        state = hold(again.groupBy("source", "block").applyInPandas(_flight(key, most <= BLOCK), columns), "flight")
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "content", "source_size", "target", (F.col("base") + F.col("pi").cast("int")).alias("copies"))


def mix(docs: DataFrame, key: int = 20240501, percent: int = 150) -> DataFrame:
    """The rows of `docs`, with its columns, as many times as the mix takes them. Of rows alike in all columns, one stands for all."""
    content = F.xxhash64(*docs.columns)
    rows = docs.select(content.alias("h"), F.struct("*").alias("row"))
    taken = decide(docs, key, percent, content).groupBy("content").agg(F.sum("copies").alias("copies"), (F.count(F.lit(1)) > 1).alias("again")).filter("copies > 0")
    chosen = rows.join(sized(hold(taken, "taken")), F.col("h") == F.col("content")).select("h", "row", "copies", "again")
    once = chosen.filter("not again").unionByName(chosen.filter("again").dropDuplicates(["h"]))
    return once.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def op4_cube_mix(documents: DataFrame) -> DataFrame:
    return decide(documents).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")
