"""Block scoring against all pairs in plain Python, with hot terms, ties, awkward rows and several blocks."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import scoring as K


def top(pairs, k):
    """The k best of (query, item, score), ties to the lesser item."""
    by = {}
    for q, i, s in pairs:
        by.setdefault(q, []).append((-round(s, 6), i))
    return sorted((q, i, -s, n) for q, found in by.items() for n, (s, i) in enumerate(sorted(found)[:k], 1))


def rows_of(df):
    return sorted((r.query, r.item, round(r.score, 6) + 0.0, r.rank) for r in df.collect())


@pytest.mark.parametrize("terms", [K.BLOCK_TERMS, 300])
def test_sparse_matches_all_pairs(spark, monkeypatch, terms):
    monkeypatch.setattr(K, "BLOCK_TERMS", terms)
    rng = random.Random(2)
    # Three terms stand in every row, with the largest weights; the rest are rare.
    docs = {f"d{k:03}": {**{t: rng.randint(1, 9) for t in ("the", "of", "a")}, **{f"t{rng.randrange(150)}": rng.randint(1, 3) for _ in range(rng.randint(0, 12))}} for k in range(300)}
    asked = {k: docs[f"d{k * 7:03}"] | {"nowhere": 5} for k in range(40)} | {99: {"unknown": 1}}
    items = spark.createDataFrame([(d, t, float(w)) for d, own in docs.items() for t, w in own.items()] + [(None, "the", 1.0), ("d000", None, 1.0), ("x", "the", None)], "item string, term string, weight double")
    queries = spark.createDataFrame([(q, t, float(w)) for q, own in asked.items() for t, w in own.items()] + [(None, "the", 1.0)], "query long, term string, weight double")
    want = top(((q, d, sum(w * own.get(t, 0) for t, w in a.items())) for q, a in asked.items() for d, own in docs.items() if a.keys() & own.keys()), 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # several batches, so that floors cut
    try:
        assert rows_of(K.sparse_topk(items.repartition(3), queries, 5)) == want and len(want) == 200
        signed = items.withColumn("weight", F.when(F.col("term") == "of", -F.col("weight")).otherwise(F.col("weight")))
        flip = lambda own: {t: -w if t == "of" else w for t, w in own.items()}
        want = top(((q, d, sum(w * flip(own).get(t, 0) for t, w in a.items())) for q, a in asked.items() for d, own in docs.items() if a.keys() & own.keys()), 5)
        assert rows_of(K.sparse_topk(signed, queries, 5)) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert K.sparse_topk(items, queries.limit(0), 5).count() == K.sparse_topk(items.limit(0), queries, 5).count() == 0


def test_late_terms_lose_no_row():
    rng = np.random.default_rng(3)
    for _ in range(30):
        n, terms = 200, 40
        has = rng.random((n, terms)) < np.linspace(0.02, 1, terms)
        weights = rng.integers(1, 6, (n, terms)) * has
        rows, cols = np.nonzero(weights)
        index = K.Index(rows, cols, weights[rows, cols].astype(float), n, terms)
        own = np.sort(rng.choice(terms, 12, replace=False))
        by = rng.integers(1, 5, 12).astype(float)
        true = weights[:, own] @ by
        floor = float(np.sort(true)[-5])
        met, score = index.scores(own, by, floor)
        assert (score == true[met]).all() and set(np.flatnonzero(true >= floor)) <= set(met)
        assert set(index.scores(own, by, 0.0)[0]) == set(np.flatnonzero(true > 0))


@pytest.mark.parametrize("size", [K.BLOCK_BYTES, 400])
def test_dense_matches_all_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(K, "BLOCK_BYTES", size)
    monkeypatch.setattr(K, "AT_ONCE", 64)
    rng = random.Random(4)
    v = {k: [rng.randint(-2, 2) for _ in range(3)] for k in range(60)}
    awkward = [(100, None), (101, [0.0, 0.0, 0.0]), (102, [float("nan"), 1.0, 1.0]), (103, [1.0, None, 1.0]), (104, [])]
    items = spark.createDataFrame([(k, list(map(float, x))) for k, x in v.items()] + awkward, "item long, vector array<double>")
    queries = items.filter("item % 4 = 0").select(F.col("item").alias("query"), "vector")
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
    pairs = [(q, i, cosine(v[q], v[i])) for q in v if q % 4 == 0 and any(v[q]) for i in v if any(v[i])]
    assert rows_of(K.dense_topk(items.repartition(4), queries, 4)) == top(pairs, 4)
    assert rows_of(K.dense_topk(items, queries, 4, F.col("item") % 3 == 0)) == top([p for p in pairs if p[1] % 3 == 0], 4)
    assert K.dense_topk(items.limit(0), queries, 4).count() == K.dense_topk(items, queries.limit(0), 4).count() == 0


@pytest.mark.parametrize("size", [K.BLOCK_BYTES, 200])
def test_cache_matches_the_first_of_the_best(spark, monkeypatch, size):
    monkeypatch.setattr(K, "BLOCK_BYTES", size)
    rng = random.Random(5)
    vector = lambda: [float(rng.randint(-2, 2)) for _ in range(3)]
    entries = [(k, vector(), rng.randrange(20), 1 + (k % 9 == 0), None if k == 5 else "hot" if k % 4 else f"p{k % 3}") for k in range(80)] + [(900, None, 0, 1, "hot")]
    asked = [(k, vector(), 1, rng.choice(["hot", "hot", "p0", "p1", "nobody", None])) for k in range(40)]
    cosine = lambda a, b: round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b)), 6)
    want = {}
    for q, a, version, profile in asked:
        hits = [(cosine(a, b), -r, e) for e, b, r, w, p in entries if b and any(a) and any(b) and version == w and profile is not None and profile == p and cosine(a, b) >= 0.5]
        if hits:
            want[q] = (max(hits)[2], max(hits)[0])
    df = spark.createDataFrame(entries, "entry long, entry_vector array<double>, recency long, version int, profile string").repartition(3)
    got = K.cache_match(df, spark.createDataFrame(asked, "question long, vector array<double>, version int, profile string"), 0.5)
    assert {r.question: (r.entry, round(r.cosine, 6)) for r in got.collect()} == want and len(want) > 10


@pytest.mark.parametrize("terms", [K.BLOCK_TERMS, 20])
def test_nearest_entries_are_never_none(spark, monkeypatch, terms):
    monkeypatch.setattr(K, "BLOCK_TERMS", terms)
    catalogue = {"b": "Sea level, global", "a": "global temperature", "d": "CO2 level", "c": "", "e": "sea ice extent", "f": None}
    asked = {1: "Global sea level!", 2: "nothing here", 3: None, 4: "ICE ice extent of co2"}
    token = lambda t: set(__import__("re").findall("[a-z0-9]+", (t or "").lower()))
    want = sorted((q, i, n, place) for q, t in asked.items() for place, (n, i) in enumerate(sorted(((len(token(t) & token(x)), i) for i, x in catalogue.items()), key=lambda x: (-x[0], x[1]))[:3], 1))
    got = K.nearest_by_tokens(spark.createDataFrame(list(catalogue.items()), "id string, text string"), spark.createDataFrame(list(asked.items()), "request long, text string"))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("terms", [K.BLOCK_TERMS, 60])
def test_sparse_blocks_shuffle_no_terms(spark, monkeypatch, terms):
    monkeypatch.setattr(K, "BLOCK_TERMS", terms)
    monkeypatch.setattr(K, "ROWS", 16, raising=False)
    monkeypatch.setattr(K, "CELLS", 64, raising=False)
    monkeypatch.setattr(K, "COMMON", 3, raising=False)
    rng = random.Random(6)
    # Norms differ by far, copies tie, a term repeats in a row, and some queries share terms with few rows or none.
    docs = {k: [(f"{'ab'[k % 2]}{rng.randrange(12)}", float(rng.randint(1, 2 + k // 20))) for _ in range(rng.randint(1, 14))] for k in range(240)}
    docs |= {300 + k: docs[239] for k in range(20)} | {400: [("alone", 2.0)], 401: [("a0", 0.0)], 402: [("rare", 1.0), ("a1", 1.0)]}
    asked = {k: own for k, own in docs.items() if k % 5 == 0 or k > 399}
    total = lambda own: {t: sum(w for x, w in own if x == t) for t, _ in own}
    sums = {k: total(own) for k, own in docs.items()}
    want = top(((q, d, sum(w * own.get(t, 0) for t, w in sums[q].items())) for q in asked for d, own in sums.items() if sums[q].keys() & own.keys()), 4)
    long = lambda rows, key: spark.createDataFrame([(k, t, w) for k, own in rows.items() for t, w in own], f"{key} long, term string, weight double")
    found = K.sparse_topk(long(docs, "item").repartition(3), long(asked, "query"), 4)
    assert rows_of(found) == want
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("Exchange") == 1 and "Aggregate" not in plan  # the best of each query, however many blocks
