"""Every registered query runs; where an oracle exists, DuckDB gives the same rows."""

from __future__ import annotations

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from check_oracles import rows_of  # noqa: E402
from qualis.sources import TABLES  # noqa: E402

QUERIES = E.queries()
ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    yield c
    c.close()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert len(df.columns) > 0 and df.count() >= 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    srows = [tuple(r) for r in df.collect()]
    spark.catalog.clearCache()  # per-query statistics caches are not shared between queries
    if name not in ORACLES:
        assert srows is not None
        return
    res = con.execute(ORACLES[name])
    dcols = [d[0] for d in res.description]
    sc, sr = rows_of(df.columns, srows)
    dc, dr = rows_of(dcols, res.fetchall())
    assert sc == dc
    assert sr == dr
