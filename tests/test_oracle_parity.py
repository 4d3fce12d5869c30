"""Every registered query against its DuckDB oracle on the smallest driver tables."""

import decimal
import datetime
import math

import duckdb
import pytest

import __spark_entry__ as E
from tidewater.sources.tables import DRIVER_TABLES

SMALL = "/root/testdata/sf0.001"
QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in DRIVER_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def test_every_query_is_registered_with_entry(spark):
    assert len(QUERIES) >= 100
    df = E.entry(spark)
    assert df.columns == ["carrier_name", "carrier_type", "total_shipments", "ontime_pct", "avg_cost"]
    assert df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted((tuple(_norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = con.execute(ORACLE[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    idx = {c: i for i, c in enumerate(dcols)}
    want = sorted((tuple(_norm(r[idx[c]]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_oracle_runs(spark, name):
    assert QUERIES[name](spark, SMALL).count() >= 0
