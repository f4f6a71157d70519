"""The filter audit: every order really run, one document at a time, on awkward rows."""

from __future__ import annotations

from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tideline.llm import filter_audit

from . import edge


def awkward():
    text = edge.rows()[0][1]
    mixed = [("ABC dE " * 90, "en", "a", 1), ("x $ y " * 70, None, None, 1), ("Same words here", "en", "", 1), (text, "en", None, 1)]
    rows = edge.rows() + [(200 + k, *r) for k, r in enumerate(mixed * 2)] + [(None, *mixed[0]), (None, *mixed[0]), (1, text, "en", "a", 1), (0, "other", "en", "a", 1)]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (200, None, 1), (201, 1, 1), (204, 1, 1), (None, 1, 1), (9999, 1, 1), (13, 0, 0)]
    return rows, labels


def plain(rows, labels):
    least, good, toxic = {}, Counter(), Counter()
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good[i] |= q == 1
            toxic[i] |= x == 1

    def fails(i, t):
        w = edge.words(t, lower=False)
        found = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        return {k for k, bad in found.items() if bad}

    out, shapley = {}, Counter()
    for part in {r[3] or "" for r in rows}:
        own = [(i, fails(i, t or "")) for i, t, _, s, _ in rows if (s or "") == part]
        for order in permutations("ABCDE"):
            left = own
            for n, f in enumerate(order, 1):
                gone, left = [r for r in left if f in r[1]], [r for r in left if f not in r[1]]
                shapley[part, f] += len(gone)
                every = sum(f in x for _, x in own)
                out[part, "".join(order), n] = (len(left), len(gone), every - len(gone), sum(x == {f} for _, x in own), sum(good[i] for i, _ in gone), sum(toxic[i] for i, _ in gone))
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def tables(spark):
    rows, labels = awkward()
    docs = spark.createDataFrame(rows, edge.DOCUMENTS).withColumn("mask", F.lit(99)).withColumn("part", F.lit("mine")).withColumn("w", F.lit(0))
    return docs.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("of", F.lit(7)).withColumn("good", F.lit("x"))


def counted(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


def test_every_order_matches_filters_run_one_by_one(tables):
    got = filter_audit.op13_filter_audit(*tables)
    want = plain(*awkward())
    assert counted(got) == want and got.count() == len(want) and {k[0] for k in want} == {"", "a", "b", "c"}
    assert all(sum(v) for v in zip(*want.values(), strict=True))


def test_empty_tables_and_other_filters(spark, tables):
    docs, labels = tables
    assert filter_audit.op13_filter_audit(docs.limit(0), labels).count() == 0
    bare = filter_audit.op13_filter_audit(docs, labels.limit(0)).collect()
    assert len(bare) == 4 * 600 and not any(r.good_lost or r.toxic_lost for r in bare)
    two = counted(filter_audit.audit_filters(docs, labels, {"A": filter_audit.FAILS["A"]}))
    assert set(two) == {(p, o, n) for p in ("", "a", "b", "c") for o in ("AE", "EA") for n in (1, 2)}
    assert all(two[p, "AE", 2][0] == two[p, "EA", 2][0] for p in ("a", "b", "c"))
