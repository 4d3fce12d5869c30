"""Data-quality jobs: declared rules checked at scale.

Spark does not enforce keys, so each declared constraint becomes an
aggregate or anti-join whose output is one small row per check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.sources.catalog import FOREIGN_KEYS, row_counts


def _n(df: DataFrame, alias: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias(alias))


def l1_row_count_expectations(wh) -> DataFrame:
    """Logistics tables against counts implied by the driver tables (scalar subqueries)."""
    suppliers = wh.supplier.select(F.count(F.lit(1))).scalar()
    customers = wh.customer.select(F.count(F.lit(1))).scalar()
    orders = wh.orders.select(F.count(F.lit(1))).scalar()
    t, n = F.col("table_name"), F.col("row_count")
    passed = (F.when(t == "carriers", n == suppliers)
              .when(t == "customers", n == customers)
              .when(t == "shipments", n == orders)
              .when(t == "invoices", (n <= orders) & (n > 0))
              .when(t.isin("shipment_charges", "tracking_events"), n > orders)
              .otherwise(n > 0))
    return row_counts(wh).select("table_name", "row_count", passed.alias("passed"))


def l2_orphan_keys(wh) -> DataFrame:
    """Orphan foreign keys for every declared relation in one anti-join.

    Each child table is scanned once with its keys exploded into
    (relation, parent, key) rows and pre-aggregated, so a hot key is one row;
    the parents' keys are unioned once, all as text; a single anti-join finds the orphans.
    """
    by_child: dict[str, list[tuple[str, str, str, str]]] = {}
    for src, col, dst, key in FOREIGN_KEYS:
        by_child.setdefault(src, []).append((src, col, dst, key))
    child_keys = []
    for src, rels in by_child.items():
        arr = F.array(*[F.struct(F.lit(f"{s}.{c} -> {d}.{k}").alias("relation"), F.lit(f"{d}.{k}").alias("parent"),
                                 F.col(c).cast("string").alias("k")) for s, c, d, k in rels])
        child_keys.append(wh.table(src).select(F.explode(arr).alias("x")).select("x.*"))
    refs = (reduce(DataFrame.unionByName, child_keys).filter(F.col("k").isNotNull())
            .groupBy("relation", "parent", "k").agg(F.count(F.lit(1)).alias("n")))
    parents = reduce(DataFrame.unionByName, [
        wh.table(d).select(F.lit(f"{d}.{k}").alias("parent"), F.col(k).cast("string").alias("k"))
        for d, k in sorted({(d, k) for _, _, d, k in FOREIGN_KEYS})])
    orphans = refs.join(parents, ["parent", "k"], "left_anti").groupBy("relation").agg(F.sum("n").alias("orphans"))
    declared = wh.spark.createDataFrame([(f"{s}.{c} -> {d}.{k}",) for s, c, d, k in FOREIGN_KEYS], "relation string")
    return declared.join(orphans, "relation", "left").select(
        "relation", F.coalesce("orphans", F.lit(0)).cast("bigint").alias("orphans"))


def l3_coverage(wh) -> DataFrame:
    s = wh.shipments.select("id")
    no_charge = s.join(wh.shipment_charges.select(F.col("shipment_id").alias("id")), "id", "left_anti")
    no_invoice = s.join(wh.invoices.select(F.col("shipment_id").alias("id")), "id", "left_anti")
    return (_n(no_charge, "missing").select(F.lit("shipments_without_charges").alias("check_name"), "missing")
            .unionByName(_n(no_invoice, "missing").select(F.lit("shipments_without_invoice").alias("check_name"),
                                                          "missing")))


def l4_unique_keys(wh) -> DataFrame:
    keys = [("shipments", "shipment_id"), ("invoices", "invoice_number"), ("customers", "customer_code"),
            ("carriers", "carrier_code"), ("extracted_documents", "document_id")]
    parts = [wh.table(t).agg(F.count(c).alias("n"), F.countDistinct(c).alias("d"))
             .select(F.lit(f"{t}.{c}").alias("key_name"), (F.col("n") - F.col("d")).alias("duplicates"))
             for t, c in keys]
    return reduce(DataFrame.unionByName, parts)


def l5_conditional_not_null(wh) -> DataFrame:
    s = wh.shipments
    return s.agg(
        F.count_if((F.col("status") == "delayed") & F.col("delay_reason").isNull()).alias("delayed_without_reason"),
        F.count_if((F.col("status") == "delayed") & ~F.col("delay_days").between(1, 30)).alias("delayed_bad_days"),
        F.count_if((F.col("status") == "delivered") & F.col("actual_arrival").isNull()).alias("delivered_without_arrival"))


def l6_distribution_order(wh) -> DataFrame:
    modes = wh.shipments.groupBy("mode").count()
    piv = modes.groupBy().pivot("mode", ["ocean", "air", "road", "rail"]).agg(F.first("count"))
    top = (wh.shipments.groupBy("status").count()
           .select(F.max_by("status", F.struct("count", "status"))).scalar())
    return piv.select(
        ((F.col("ocean") > F.col("air")) & (F.col("air") > F.col("road")) & (F.col("road") > F.col("rail")))
        .alias("mode_order_ok"),
        (top == "delivered").alias("delivered_most_common"),
        "ocean", "air", "road", "rail")


def l7_invoice_reconciliation(wh, tolerance: float = 0.01) -> DataFrame:
    ch = wh.shipment_charges.groupBy("shipment_id").agg(F.sum("amount_usd").alias("charges"))
    j = wh.invoices.select("shipment_id", "subtotal_usd", "tax_usd", "total_usd").join(ch, "shipment_id")
    return j.agg(
        F.count("*").alias("invoices_checked"),
        F.count_if(F.abs(F.col("subtotal_usd") - F.col("charges")) > tolerance).alias("subtotal_mismatches"),
        F.count_if(F.abs(F.col("subtotal_usd") + F.col("tax_usd") - F.col("total_usd")) > tolerance)
        .alias("total_mismatches"))
