"""Catalogue and profiles as DataFrames.

Metadata (names, types, declared keys) is tiny and bounded by the schema;
row counts and value profiles are Spark aggregations over the data.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewater.config import KNOWN_TABLES

# --- declared keys of the logistics model (Spark does not enforce them) ---
PRIMARY_KEYS = {
    "customers": "id", "carriers": "id", "shipments": "id", "invoices": "id",
    "tracking_events": "id", "extracted_documents": "id",
}
FOREIGN_KEYS = [
    ("shipments", "customer_id", "customers", "id"),
    ("shipments", "carrier_id", "carriers", "id"),
    ("shipment_charges", "shipment_id", "shipments", "id"),
    ("tracking_events", "shipment_id", "shipments", "id"),
    ("invoices", "shipment_id", "shipments", "id"),
    ("invoices", "customer_id", "customers", "id"),
    ("invoices", "carrier_id", "carriers", "id"),
    ("extracted_documents", "linked_shipment_id", "shipments", "shipment_id"),
]
# --- fixed values: declared NOT NULL columns and defaults (SQL text) of the logistics model ---
NOT_NULL = {
    "customers": ["customer_code", "company_name", "industry", "country", "city", "tier"],
    "carriers": ["carrier_code", "carrier_name", "carrier_type"],
    "shipments": ["shipment_id", "customer_id", "carrier_id", "origin_port", "origin_country", "destination_port",
                  "destination_country", "mode", "status", "booking_date", "weight_kg", "commodity"],
    "shipment_charges": ["shipment_id", "charge_type", "amount_usd"],
    "tracking_events": ["shipment_id", "event_type", "event_timestamp", "location"],
    "invoices": ["invoice_number", "shipment_id", "customer_id", "carrier_id", "invoice_date", "due_date", "subtotal_usd", "total_usd"],
    "extracted_documents": ["document_id", "document_type", "file_name", "extracted_fields", "confidence_scores"],
}
DEFAULTS = {
    "shipments": {"container_count": "1", "delay_days": "0", "priority": "'standard'"},
    "shipment_charges": {"currency": "'USD'"},
    "tracking_events": {"created_by": "'system'", "is_milestone": "0"},
    "invoices": {"tax_usd": "0", "currency": "'USD'", "payment_status": "'pending'"},
    "extracted_documents": {"upload_timestamp": "CURRENT_TIMESTAMP", "review_status": "'pending'"},
}
ENUM_COLUMNS = {
    "shipments": ["mode", "status", "priority"],
    "customers": ["tier", "industry"],
    "invoices": ["payment_status"],
    "carriers": ["carrier_type"],
}


def table_names(spark: SparkSession) -> list[str]:
    """A3: logistics tables registered in the session, sorted, no internals."""
    names = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    return sorted(n for n in names if n in KNOWN_TABLES)


def declared(table: str, schema: StructType) -> StructType:
    """``schema`` with the declared constraints as metadata of its fields:
    ``notnull``, ``pk`` and, where there is one, ``default`` as SQL text. Spark
    keeps metadata through selects and in Parquet files."""
    fields = []
    for f in schema.fields:
        key = PRIMARY_KEYS.get(table) == f.name
        given = {"notnull": key or f.name in NOT_NULL.get(table, ()), "pk": key}
        if f.name in DEFAULTS.get(table, ()):
            given["default"] = DEFAULTS[table][f.name]
        fields.append(StructField(f.name, f.dataType, True, {**f.metadata, **given}))
    return StructType(fields)


def column_metadata(spark: SparkSession, wh) -> DataFrame:
    """A4: (table, column, type, notnull, default_value, is_pk) as declared."""
    rows = [(t, f.name, f.dataType.simpleString(), f.metadata["notnull"], f.metadata.get("default"), f.metadata["pk"])
            for t in KNOWN_TABLES for f in declared(t, wh.table(t).schema).fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, notnull boolean, default_value string, is_pk boolean")


def checked(df: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows as a table with the declared ``schema`` takes them: columns in its
    order and types, missing ones and nulls filled by their defaults. Returns
    (rows without a violation, violating rows with ``violations``: the columns
    that are null and must not be)."""
    def value(f: StructField) -> Column:
        own = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        return F.coalesce(own, F.expr(f.metadata["default"]).cast(f.dataType)) if "default" in f.metadata else own

    filled = df.select(*[value(f).alias(f.name, metadata=f.metadata) for f in schema.fields])
    required = [f.name for f in schema.fields if f.metadata.get("notnull")]
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required])) if required else F.array().cast("array<string>")
    judged = filled.withColumn("violations", missing)
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def write_checked(df: DataFrame, schema: StructType, path: str, quarantine: str) -> None:
    """Append to the table at ``path`` what its declarations allow, and the
    other rows, with their violations, to the table at ``quarantine``."""
    good, bad = checked(df, schema)
    bad.write.mode("append").parquet(quarantine)
    good.write.mode("append").parquet(path)


def _profile(wh, table: str) -> tuple[int, dict[str, int]] | None:
    """What was counted while the table was written, if it was."""
    return getattr(wh, "profiles", {}).get(table)


def null_counts(wh, table: str) -> DataFrame:
    """A4 over the data: (table, column, position, null_count): kept from the
    write, else one pass over the table."""
    columns = wh.table(table).columns
    kept = _profile(wh, table)
    if kept:
        rows = [(table, c, i, kept[1][c]) for i, c in enumerate(columns)]
        return wh.spark.createDataFrame(rows, "table_name string, column_name string, position int, null_count bigint")
    counted = wh.table(table).agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                                                     F.count_if(F.col(c).isNull()).alias("null_count"))
                                            for i, c in enumerate(columns)]).alias("c"))
    return counted.select(F.lit(table).alias("table_name"), F.inline("c"))


def foreign_keys(spark: SparkSession) -> DataFrame:
    """A5: declared foreign keys."""
    return spark.createDataFrame(FOREIGN_KEYS, "from_table string, from_column string, to_table string, to_column string")


def row_counts(wh, tables: list[str] | None = None) -> DataFrame:
    """One row per known table: the count kept from the write, else a
    distributed aggregate."""
    def counted(t: str) -> DataFrame:
        kept = _profile(wh, t)
        if kept:
            return wh.spark.createDataFrame([(t, kept[0])], "table_name string, row_count bigint")
        return wh.table(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")

    return reduce(DataFrame.unionByName, [counted(t) for t in tables or KNOWN_TABLES])


def row_count(wh, table: str) -> int:
    """A6 point form: known tables only, else an error."""
    if table not in KNOWN_TABLES:
        raise ValueError(f"Unknown table: {table}")
    return wh.table(table).count()


def table_profile(spark: SparkSession, wh) -> DataFrame:
    """Per table, row count plus column and key descriptions as text."""
    cols = column_metadata(spark, wh).groupBy("table_name").agg(
        F.count("*").alias("column_count"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("column_name", "data_type"))),
                                 lambda c: F.concat(c["column_name"], F.lit(" "), c["data_type"])), ", ")
        .alias("columns"))
    fks = foreign_keys(spark).groupBy(F.col("from_table").alias("table_name")).agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("from_column", F.lit(" -> "), "to_table",
                                                            F.lit("."), "to_column"))), "; ").alias("foreign_keys"))
    return row_counts(wh).join(cols, "table_name").join(fks, "table_name", "left")


def schema_text(wh) -> DataFrame:
    """A7 as one text per table: its rows, columns with declared constraints, and keys."""
    places = [(t, c, i) for t in KNOWN_TABLES for i, c in enumerate(wh.table(t).columns)]
    place = wh.spark.createDataFrame(places, "table_name string, column_name string, position int")
    meta = column_metadata(wh.spark, wh).join(place, ["table_name", "column_name"])
    rule = F.when(F.col("is_pk"), " PRIMARY KEY").when(F.col("notnull"), " NOT NULL").otherwise("")
    default = F.coalesce(F.concat(F.lit(" DEFAULT "), "default_value"), F.lit(""))
    line = F.concat(F.lit("    "), "column_name", F.lit(" "), "data_type", rule, default)
    columns = meta.groupBy("table_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))),
                                 lambda c: c["line"]), "\n").alias("body"))
    key = F.concat(F.lit("\n    FOREIGN KEY ("), "from_column", F.lit(") REFERENCES "), "to_table", F.lit("("), "to_column", F.lit(")"))
    keys = foreign_keys(wh.spark).groupBy(F.col("from_table").alias("table_name")).agg(
        F.array_join(F.array_sort(F.collect_list(key)), "").alias("tail"))
    head = F.concat(F.lit("TABLE: "), "table_name", F.lit(" ("), F.format_number("row_count", 0), F.lit(" rows)\n"))
    return (row_counts(wh).join(columns, "table_name").join(keys, "table_name", "left")
            .select("table_name", F.concat(head, "body", F.coalesce("tail", F.lit(""))).alias("description")))


def value_profile(wh) -> DataFrame:
    """Per enum column, values with their share, e.g. ``ocean(55%)``, most common first."""
    parts = []
    for t, cols in ENUM_COLUMNS.items():
        df = wh.table(t).select([F.col(c).cast("string") for c in cols])
        long = df.unpivot([], cols, "column_name", "value")
        parts.append(long.groupBy("column_name", "value").agg(F.count("*").alias("n"))
                     .withColumn("table_name", F.lit(t)))
    counts = reduce(DataFrame.unionByName, parts)
    w = W.partitionBy("table_name", "column_name")  # one partition per enum column: bounded
    pct = F.floor((F.col("n") * 200 + F.sum("n").over(w)) / (F.sum("n").over(w) * 2)).cast("int")
    labelled = counts.withColumn("pct", pct)
    return labelled.groupBy("table_name", "column_name").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "value", "pct"))),
                                 lambda x: F.concat(F.coalesce(x["value"], F.lit("NULL")), F.lit("("),
                                                    x["pct"].cast("string"), F.lit("%)"))), ", ").alias("profile"))
