"""Each stage of the pipeline, and the whole run, against plain Python on awkward documents."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tideline.llm import quality_rules, training_order

from . import edge

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
STAGES = dict(pipeline.STAGES)


def rows():
    rng = random.Random(9)
    item = edge.prose(rng, 40)
    out = edge.rows() + [(1, edge.rows()[0][1], "en", "a", 1), (700, f"{edge.prose(rng, 80)} {item} {edge.prose(rng, 80)}", "en", "b", 2), (None, edge.prose(rng, 70), None, None, None), (None, f"{edge.prose(rng, 90)} {item} {edge.prose(rng, 30)}", "en", "a", 4), (702, edge.prose(rng, 75), "en", "a", 5), (702, f"{edge.prose(rng, 85)} {item}", "en", "a", 5), (None, edge.prose(rng, 70), "en", "a", 3)]
    return out, item


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    documents, item = rows()
    spark.createDataFrame(documents, edge.DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def counted(df):
    return Counter(map(tuple, df.select(*COLUMNS).collect()))


def plain_quality(documents):
    stop = {*quality_rules.STOP_WORDS, *(w.capitalize() for w in quality_rules.STOP_WORDS)}

    def good(t):
        n, chars, symbols, dup, repeat = edge.quality_counts(t)
        w, lines = edge.words(t, lower=False), [x for x in (t or "").split("\n") if edge.WORD.search(x)]
        return (
            n >= 20 and 100 * repeat <= 30 * n and 2 <= chars / n <= 15 and symbols / n <= 0.2 and dup / max(len(lines), 1) <= 0.45
            and not (n >= 80 and sum(x in stop for x in w) / n < 0.01) and t.count("!") / n <= 0.3 and sum(x.endswith(("...", "…")) for x in lines) / max(len(lines), 1) <= 0.3
        )

    return [r for r in documents if good(r[1])]


def plain_near(documents):
    pairs = [(r[0], r[1]) for r in documents]
    kept, seen = [], set()
    for r, group, least in zip(documents, edge.groups(pairs, 5, 80), edge.components(pairs, 5, 80), strict=True):
        if not edge.words(r[1]):
            kept.append(r)
        elif r[0] == least and group not in seen:
            seen.add(group)
            kept.append(r)
    return kept


def plain_clean(documents, item):
    token = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    own = shingles(token(item))
    return [r for r in documents if 100 * len(own & shingles(token(r[1]))) < 80 * len(own)]


def test_stages_match_plain_python(spark, tables):
    documents, item = rows()
    df = spark.read.parquet(f"{tables}/documents.parquet")
    for name, want in (("quality_rules", plain_quality(documents)), ("near_duplicates", plain_near(documents)), ("decontamination", plain_clean(documents, item))):
        out = STAGES[name](spark, df, tables)
        assert out.columns == COLUMNS and counted(out) == Counter(want), name
        assert 0 < len(want) < len(documents)
    mixed = STAGES["mixing"](spark, df, tables)
    assert mixed.columns == COLUMNS and set(counted(mixed)) <= set(documents) and max(n / documents.count(r) for r, n in counted(mixed).items()) <= 2


def test_run_is_its_stages_and_agrees_with_itself(spark, tables):
    documents, item = rows()
    out = sorted(pipeline.run(spark, tables).collect(), key=lambda r: r.slot)
    kept = plain_clean(plain_near(plain_quality(documents)), item)
    assert {i for r in out for i in r.doc_ids} <= {r[0] for r in kept} and [r.slot for r in out] == list(range(len(out)))
    with open(training_order.tokenizer_path(), "rb") as f:
        decode = training_order._encoder(f.read()).decode
    number = training_order.permute(np.arange(len(out)), len(out), 7)
    ids = np.concatenate([np.frombuffer(out[int(s)].tokens, "<u2")[: out[int(s)].n_tokens] for s in number])
    texts = Counter(decode(part.tolist()) for part in np.split(ids, np.flatnonzero(ids == 50256) + 1)[:-1] for part in [part[:-1]])
    assert set(texts) <= {r[1] for r in kept} and max(texts.values()) <= 2
    size = Counter()
    for r in kept:
        size[r[3]] += len(edge.words(r[1]))
    taken = Counter()
    for t, n in texts.items():
        taken[next(r[3] for r in kept if r[1] == t)] += n * len(edge.words(t))
    assert all(taken[s] <= 2 * size[s] for s in size) and 0 < sum(taken.values()) <= 1.5 * sum(size.values()) + max(len(edge.words(r[1])) for r in kept)
    again = sorted(pipeline.run(spark, tables).collect(), key=lambda r: r.slot)
    assert [(r.slot, r.tokens) for r in again] == [(r.slot, r.tokens) for r in out]


def test_stages_take_empty_tables_and_more_columns(spark, tables):
    df = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in pipeline.STAGES:
        assert stage(spark, df.limit(0), tables).count() == 0, name
    odd = df.limit(5).withColumn("h", F.lit("x")).withColumn("row", F.lit(1)).withColumn("kept", F.lit(True)).withColumn("item_id", F.lit(0))
    for name, stage in pipeline.STAGES[:-1]:
        assert stage(spark, odd, tables).columns == odd.columns, name
