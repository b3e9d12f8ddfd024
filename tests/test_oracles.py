"""Every registered query equals its independent DuckDB SQL at sf0.01
(row count, column names, order-insensitive rounded values)."""

from __future__ import annotations

import pytest

import __spark_entry__ as E
from tests.conftest import SF001, SF01
from tools.check_oracles import duck, rows_of

ORACLES = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def test_registry_consistent():
    assert set(ORACLES) <= set(QUERIES)
    assert len(ORACLES) >= 60


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2
    assert df.columns == ["cluster", "positive", "neutral_a", "neutral_b"]
    assert sum(r["positive"] + r["neutral_a"] + r["neutral_b"] for r in rows) == 200


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    sp = QUERIES[name](spark, SF01).toPandas()
    dk = con.execute(ORACLES[name]).df()
    sc, sr = rows_of(sp)
    dc, dr = rows_of(dk)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF001)
    assert df.count() > 0
