"""What the fused search keeps and passes on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tideline import queries
from tideline.operators import scoring as K

SF = "/root/testdata/sf0.001"


def test_fusion_reads_texts_once_and_shuffles_no_terms(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_TERMS", 1000)  # several blocks
    plan = queries.rrf_fusion(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "documents.parquet" not in plan


def test_dense_passes_on_only_what_may_be_best(spark, monkeypatch):
    n, k = 400, 3
    angle = np.linspace(0, 1.5, n)
    items = spark.createDataFrame([(i, [float(np.cos(a)), float(np.sin(a))]) for i, a in enumerate(angle)], "item long, vector array<double>").coalesce(1)
    queries_ = items.filter("item = 0").select(F.col("item").alias("query"), "vector")
    passed = []
    monkeypatch.setattr(K, "ranked", lambda scored, k: passed.append(scored.count()) or scored)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)  # 20 batches, the best first
    try:
        K.dense_topk(items, queries_, k)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert passed == [k]
