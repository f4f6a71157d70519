"""Metrics by groups of gold against those of the pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tideline import queries
from tideline.operators import evaluation as E

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


@pytest.mark.parametrize("several", [False, True])
def test_groups_give_what_their_pairs_give(spark, several):
    rng = random.Random(8)
    groups = lambda: rng.sample(["a", "b", "c", "d"], rng.choice([1, 2, 3]) if several else 1)
    gold = spark.createDataFrame([(i, g) for i in range(60) for g in groups()] + [(3, None), (None, "a"), (7, "z")], "item int, group string")
    asked = spark.createDataFrame([(q, g) for q in range(25) for g in groups()] + [(30, "none"), (31, None), (32, "z"), (32, "z")], "query int, group string")
    ranked = spark.createDataFrame([(q, i, n) for q in [*range(0, 25, 2), 32] for n, i in enumerate(rng.sample(range(80), 9), 1)] + [(30, 1, 1)], "query int, item int, rank int")
    pairs = gold.dropna().join(asked.dropna(), "group").select("query", "item")
    want = rows_of(E.retrieval_metrics(ranked, pairs, 4))
    assert rows_of(E.retrieval_metrics(ranked, gold, 4, asked)) == want and len(want) == 26
    scores = ranked.select(F.explode(F.array(F.lit("m"), F.lit("n"))).alias("model"), "query", "item", (F.col("item") * 37 % 11).cast("double").alias("score"))
    assert rows_of(E.rerank_benchmark(ranked, scores, gold, 6, 4, asked)) == rows_of(E.rerank_benchmark(ranked, scores, pairs, 6, 4))


def test_reranker_searches_once(spark):
    plan = queries.reranker_benchmark(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan  # the candidates are held, not found anew for each model
