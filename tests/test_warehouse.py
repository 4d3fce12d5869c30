"""Stored tables (production shape) answer exactly like the generated views."""

from pyspark.sql import functions as F

from tidewater.operators import relational as R
from tidewater.sources import catalog as C
from tidewater.sources.tables import Warehouse

SMALL = "/root/testdata/sf0.001"


def _rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_materialized_matches_views(spark):
    views = Warehouse(spark, SMALL)
    views._register()
    expected = {f.__name__: _rows(f(views)) for f in
                (R.carrier_performance, R.d9_cost_per_kg, R.e1_latest_event, R.c8_extracted_vs_actual)}
    stored = Warehouse(spark, SMALL)
    stored._register()
    stored.materialize()
    for f in (R.carrier_performance, R.d9_cost_per_kg, R.e1_latest_event, R.c8_extracted_vs_actual):
        assert _rows(f(stored)) == expected[f.__name__]
    Warehouse.of(spark, SMALL)  # restore the shared views for other tests


def test_profiles_are_counted_while_tables_are_written(spark):
    """Row and null counts of stored tables equal the data's, without a scan."""
    wh = Warehouse(spark, SMALL)
    wh._register()
    counted = {t: (wh.table(t).count(), {c: wh.table(t).where(F.col(c).isNull()).count() for c in wh.table(t).columns[-3:]}) for t in ("shipments", "invoices", "carriers")}
    path = wh.materialize()
    rows, nulls = C.row_counts(wh), C.null_counts(wh, "shipments")
    for df in (rows, nulls):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "FileScan" not in plan, plan
    got = {r.table_name: r.row_count for r in rows.collect()}
    for t, (n, missing) in counted.items():
        assert got[t] == n and {c: wh.profiles[t][1][c] for c in missing} == missing
    assert {r.column_name: r.null_count for r in nulls.collect()}["delay_reason"] > 0
    kept = spark.read.json(f"{path}/shipments/_profile").first()
    assert kept.row_count == got["shipments"] and wh.table("shipments").count() == got["shipments"]
    Warehouse.of(spark, SMALL)  # restore the shared views for other tests
