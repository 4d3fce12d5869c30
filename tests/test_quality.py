"""Orphan-key detection with planted orphans (the driver data has none)."""

from types import SimpleNamespace

from tidewater.operators import quality as Q


def test_orphans_counted_per_relation(spark):
    t = {
        "customers": spark.createDataFrame([(1,), (2,)], "id long"),
        "carriers": spark.createDataFrame([(10,)], "id long"),
        "shipments": spark.createDataFrame([(100, "S100", 1, 10), (101, "S101", 3, 10), (102, "S102", 3, 11), (103, "S103", None, 10)],
                                           "id long, shipment_id string, customer_id long, carrier_id long"),
        "extracted_documents": spark.createDataFrame([("S100",), ("S999",), (None,), ("100",)], "linked_shipment_id string"),
        "shipment_charges": spark.createDataFrame([(100,), (999,)], "shipment_id long"),
        "tracking_events": spark.createDataFrame([(101,)], "shipment_id long"),
        "invoices": spark.createDataFrame([(100, 1, 10), (555, 7, 10)], "shipment_id long, customer_id long, carrier_id long"),
    }
    wh = SimpleNamespace(spark=spark, table=lambda name: t[name])
    out = {r["relation"]: r["orphans"] for r in Q.l2_orphan_keys(wh).collect()}
    assert out == {
        "shipments.customer_id -> customers.id": 2,   # customer 3 twice; NULL is not an orphan
        "shipments.carrier_id -> carriers.id": 1,
        "shipment_charges.shipment_id -> shipments.id": 1,
        "tracking_events.shipment_id -> shipments.id": 0,
        "invoices.shipment_id -> shipments.id": 1,
        "invoices.customer_id -> customers.id": 1,
        "invoices.carrier_id -> carriers.id": 0,
        "extracted_documents.linked_shipment_id -> shipments.shipment_id": 2,
    }
