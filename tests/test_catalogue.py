"""Manifest checks and membership rules."""

from __future__ import annotations

import pytest

from tideline.operators import catalogue as M


def test_violations(spark):
    rows = [("a", "open", "2024-01-02", "0" * 64), ("b", "odd", "2024-02-31", "x"), ("c", None, "2024-01-01", "1" * 64), ("c", "open", "2024-01-01", "1" * 64)]
    df = spark.createDataFrame(rows, "id string, permitted_context string, retrieved_at string, sha256 string")
    checks = [M.matches("id", M.ID), M.one_of("permitted_context", ["open", "excerpt"]), M.is_date("retrieved_at"), M.matches("sha256", M.SHA), M.required("permitted_context")]
    got = sorted((r.id, len(r.violations)) for r in M.violations(df, checks).collect())
    assert got == [("a", 0), ("b", 3), ("c", 1), ("c", 3)]
    with pytest.raises(ValueError, match="id: repeated"):
        M.refuse(M.violations(df, checks))
    assert M.refuse(M.violations(df.filter("id = 'a'"), checks)).count() == 1


def test_membership(spark):
    data = spark.createDataFrame([("a", True, "open"), ("b", True, "link"), ("c", None, "open"), ("d", True, "open")], "id string, in_chart_pack boolean, permitted_context string")
    pairs = spark.createDataFrame([("p", "a", "d"), ("q", "a", "c"), ("r", "x", "c"), ("s", "a", "b")], "pair string, first string, second string")
    assert {r.pair: r.reason for r in M.blocked_pairs(pairs, M.pack_members(data)).collect()} == {"q": "not in the pack: c", "r": "not in the pack: c; not in the pack: x"}
    own, both = M.offered(data, pairs)
    assert {r.id for r in own.collect()} == {"a", "d"} and [r.pair for r in both.collect()] == ["p"]
    files = spark.createDataFrame([("f1",), ("f2",)], "path string")
    docs = spark.createDataFrame([("f1", "open", True), ("f2", "link", True)], "path string, permitted_context string, redistributable boolean")
    assert [r.path for r in M.unshipped(files, docs).collect()] == ["f2"]
