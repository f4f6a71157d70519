"""Fusion, rerank windows and cuts, the difference of index snapshots, interval and as-of joins; scores are in `scoring`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scoring import ranked

#: Constant of reciprocal rank fusion. The store that fuses leaves it open, so it is a parameter everywhere.
RRF = 60
CUT, RETRIEVE = 12, 40
def fuse(channels: Sequence[DataFrame], k: int, constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of ranked channels."""
    each = channels[0].select("query", "item", "rank")
    for c in channels[1:]:
        each = each.unionByName(c.select("query", "item", "rank"))
    scored = each.groupBy("query", "item").agg(F.round(F.sum(1 / (F.lit(float(constant)) + F.col("rank"))), 9).alias("score"))
    return ranked(scored, k)


def rerank_cut(candidates: DataFrame, score: str = "score", fused: str = "rank", cut: int = CUT, threshold: float | None = None) -> DataFrame:
    """The `cut` best by score, ties in fused order; `passes` marks those from the threshold on."""
    w = Window.partitionBy("query").orderBy(F.col(score).desc(), F.col(fused))
    out = candidates.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= cut)
    return out if threshold is None else out.withColumn("passes", F.col(score) >= threshold)


def window_bounds(tokens: Column, budget: int) -> Column:
    """[start, end) spans of at most `budget` tokens without gaps; the last one ends with the passage and is full."""
    if budget <= 0:
        raise ValueError("the window budget must be positive")
    whole = F.array(F.struct(F.lit(0).alias("start"), tokens.cast("int").alias("end")))
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(tokens / budget).cast("int") - 2, F.lit(0)))
    head = F.transform(starts, lambda i: F.struct((i * budget).cast("int").alias("start"), ((i + 1) * budget).cast("int").alias("end")))
    tail = F.array(F.struct((tokens - budget).cast("int").alias("start"), tokens.cast("int").alias("end")))
    return F.when(tokens <= budget, whole).otherwise(F.concat(head, tail))


def snapshot_diff(stored: DataFrame, incoming: DataFrame, key: str = "id", content: str = "hash", payload: str = "payload") -> DataFrame:
    """key and action: insert, embed (content changed), refresh (payload changed only), keep, delete."""
    a = stored.select(key, F.col(content).alias("__h0"), F.col(payload).alias("__p0"), F.lit(True).alias("__old"))
    b = incoming.select(key, F.col(content).alias("__h1"), F.col(payload).alias("__p1"), F.lit(True).alias("__new"))
    action = (
        F.when(F.col("__new").isNull(), "delete")
        .when(F.col("__old").isNull(), "insert")
        .when(~F.col("__h0").eqNullSafe(F.col("__h1")), "embed")
        .when(~F.col("__p0").eqNullSafe(F.col("__p1")), "refresh")
        .otherwise("keep")
    )
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The keys that two sets which should be disjoint have in common, each once."""
    return a.select(key).join(b.select(key), key, "left_semi").distinct()


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def overlapping_spans(sentences: DataFrame, citations: DataFrame, width: int = 512) -> DataFrame:
    """answer, sentence, document: sentences and citations whose spans overlap, each document once, by first arrival.

    `sentences` has answer, sentence, s_start, s_end; `citations` answer, seq, document, c_start, c_end. Spans are dealt into
    bins of `width`, so the join is an equality on answer and bin; a pair is kept in the first bin that both touch.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    s = sentences.filter("s_end > s_start").withColumn("bin", bins("s_start", "s_end"))
    c = citations.filter("c_end > c_start").withColumn("bin", bins("c_start", "c_end"))
    both = s.join(c, ["answer", "bin"]).filter("s_start < c_end and s_end > c_start and bin = floor(greatest(s_start, c_start) / " + str(width) + ")")
    return both.groupBy("answer", "sentence", "document").agg(F.min("seq").alias("seq"))


def asof_sentence(points: DataFrame, starts: DataFrame, by: str = "answer", at: str = "at", start: str = "start", index: str = "index") -> DataFrame:
    """For each point, the last sentence that starts at or before it (null before the first): one sort over the union, no range join."""
    a = points.select(by, F.col(at).alias("__x"), F.lit(1).alias("__kind"), F.struct(*points.columns).alias("__row"), F.lit(None).cast(starts.schema[index].dataType).alias("__i"))
    b = starts.select(by, F.col(start).alias("__x"), F.lit(0).alias("__kind"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), F.col(index).alias("__i"))
    w = Window.partitionBy(by).orderBy("__x", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    filled = a.unionByName(b).withColumn("__i", F.last("__i", ignorenulls=True).over(w)).filter("__kind = 1")
    return filled.select("__row.*", F.col("__i").alias(index))
