"""Every registered query against its SQL on the smallest data set."""

from __future__ import annotations

import pytest
from oracle import connect, difference

from clipmetrics.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES = catalogue.queries()
ORACLES = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert difference(df, duck, ORACLES[name]) is None
    else:
        assert len(df.columns) == len(set(df.columns))
        df.collect()


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert 0 < len(rows) <= 30
    assert set(entry.oracle_sql()) <= set(entry.queries())
