"""Each registered query of the engine against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

from tideline import queries

from . import oracle

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, con, name):
    assert oracle.difference(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["series", "x", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
