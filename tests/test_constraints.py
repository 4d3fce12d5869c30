"""Declared constraints (A4, A7, L5): metadata, defaults on write, quarantine."""

import uuid

from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidewater.session import shared_path
from tidewater.sources import catalog as C

PLAIN = StructType([StructField("shipment_id", LongType()), StructField("charge_type", StringType()),
                    StructField("amount_usd", LongType()), StructField("currency", StringType())])


def test_declarations_travel_with_the_schema(spark):
    schema = C.declared("shipment_charges", PLAIN)
    assert [(f.name, f.metadata["notnull"], f.metadata.get("default")) for f in schema.fields] == [
        ("shipment_id", True, None), ("charge_type", True, None), ("amount_usd", True, None), ("currency", False, "'USD'")]
    path = shared_path(spark, "test_constraints", uuid.uuid4().hex)
    good, _ = C.checked(spark.createDataFrame([(1, "freight", 5, None)], PLAIN), schema)
    good.write.parquet(path)
    assert spark.read.parquet(path).schema["currency"].metadata["default"] == "'USD'"  # kept in the files
    assert C.declared("customers", StructType([StructField("id", LongType())]))["id"].metadata == {"notnull": True, "pk": True}


def test_defaults_are_filled_and_violations_go_to_quarantine(spark):
    schema = C.declared("shipment_charges", PLAIN)
    folder = shared_path(spark, "test_constraints", uuid.uuid4().hex)
    rows = spark.createDataFrame([("freight", 1, 10), (None, 2, 20), ("handling", None, None), ("freight", 3, 30)], "charge_type string, shipment_id long, amount_usd int")
    for _ in range(2):  # a second append adds to both
        C.write_checked(rows, schema, f"{folder}/stored", f"{folder}/quarantine")
    stored, bad = spark.read.parquet(f"{folder}/stored"), spark.read.parquet(f"{folder}/quarantine")
    assert stored.columns == [f.name for f in schema.fields] and stored.schema["amount_usd"].dataType == LongType()
    assert sorted(map(tuple, stored.collect())) == [(1, "freight", 10, "USD")] * 2 + [(3, "freight", 30, "USD")] * 2
    assert sorted(",".join(r.violations) for r in bad.collect()) == ["charge_type"] * 2 + ["shipment_id,amount_usd"] * 2
    empty = rows.where("false")
    good, none = C.checked(empty, schema)
    assert good.count() == none.count() == 0
