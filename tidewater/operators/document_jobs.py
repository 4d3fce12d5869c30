"""Document jobs bound to the warehouse.

The raw responses and the review / link logs are derived from the logistics
views by key arithmetic, so every job's work grows with the driver tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import documents as D


def parsed(wh) -> DataFrame:
    """I1 + I2 stage, written once per warehouse."""
    return wh.memo("parsed_responses", lambda: D.parse_responses(wh.raw_responses))


def scored(wh) -> DataFrame:
    """I4-I17 stage over parsed responses, written once per warehouse."""
    return wh.memo("scored_documents", lambda: D.score_documents(parsed(wh)).withColumn(
        "mean_confidence", F.aggregate(F.transform("fields", lambda f: f["confidence"]), F.lit(0.0),
                                       lambda a, x: a + x) / F.size("fields")))


def i1_i2_parse_status(wh) -> DataFrame:
    return parsed(wh).select("document_id", "parse_error")


def i3_lenient_check(wh) -> DataFrame:
    checked = D.lenient_check(wh.raw_responses)
    values = F.coalesce(F.map_values("clamped_scores"), F.array().cast("array<double>"))
    total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
    return checked.select("document_id", "passed", "reason", F.when(F.col("passed"), F.size(values)).alias("n_scores"),
                          F.when(F.col("passed"), F.round(total, 6)).alias("score_sum"))


def i4_long_fields(wh) -> DataFrame:
    lf = D.long_fields(scored(wh))
    return lf.select("document_id", "pos", "field", "value", F.round("confidence", 4).alias("confidence"),
                     "needs_review")


def i6_overall_confidence(wh) -> DataFrame:
    s = scored(wh)
    # the unrounded mean: round() ties differ between engines (see README)
    return s.select("document_id", F.size("fields").alias("n_fields"), "mean_confidence",
                    F.col("prior_notes").startswith("WARNING").alias("unrecognizable"))


def i9_review_summary(wh) -> DataFrame:
    """I8 + I9 + I25: fields needing review, total fields, very-low list."""
    s = scored(wh)
    return s.select("document_id",
                    F.size(F.filter("fields", lambda f: f["needs_review"])).alias("fields_needing_review"),
                    F.size("fields").alias("total_fields"), "very_low_fields")


def i10_rule_warnings(wh) -> DataFrame:
    s = scored(wh)
    return (s.filter(F.size("warnings") > 0)
            .select("document_id", "document_type", F.array_join("warnings", " | ").alias("warnings")))


def i15_completeness(wh) -> DataFrame:
    s = scored(wh)
    return s.select("document_id", F.array_join("missing_fields", ", ").alias("missing_fields"))


def i16_auto_link(wh) -> DataFrame:
    linked = D.auto_link(scored(wh), wh.shipments, wh.invoices)
    return linked.select("document_id", "linked_shipment_id", "link_priority")


def i17_notes(wh) -> DataFrame:
    return scored(wh).select("document_id", "notes")


def review_log(wh) -> DataFrame:
    """Review actions derived from the stored documents (plus some unknown ids)."""
    e = wh.extracted_documents.select(
        "document_id", "upload_timestamp", F.substring("document_id", 5, 20).cast("bigint").alias("n"))
    def action(doc, status, corrected, at, keep):
        return F.struct(doc.alias("document_id"), F.lit(status).alias("review_status"),
                        corrected.cast("string").alias("corrected_fields"), at.alias("reviewed_at"),
                        keep.alias("keep"))

    ts, n, doc = F.col("upload_timestamp"), F.col("n"), F.col("document_id")
    ev = F.array(
        action(doc, "approved", F.lit(None), ts + F.expr("INTERVAL 2 HOURS"), n % 5 == 0),
        action(doc, "rejected", F.lit(None), ts + F.expr("INTERVAL 3 HOURS"), n % 5 == 1),
        action(doc, "corrected", F.concat(F.lit('{"corrected_by": "reviewer '), (n % 7).cast("string"), F.lit('"}')),
               ts + F.expr("INTERVAL 5 HOURS"), n % 10 == 1),
        action(doc, "approved", F.lit(None), ts + F.expr("INTERVAL 8 HOURS"), n % 20 == 1),  # after the correction
        action(doc, "rejected", F.lit(None), ts + F.expr("INTERVAL 2 HOURS"), n % 15 == 0),  # at the time of an approval
        action(F.concat(F.lit("DOC-X"), n.cast("string")), "approved", F.lit(None), ts, n % 9 == 0))
    return (e.select(F.explode(ev).alias("r")).filter("r.keep")
            .select("r.document_id", "r.review_status", "r.corrected_fields", "r.reviewed_at"))


def i18_review_merge(wh) -> DataFrame:
    merged, _ = D.latest_review(wh.extracted_documents, review_log(wh))
    return merged.select("document_id", "review_status", "extracted_fields")


def i18_unknown_reviews(wh) -> DataFrame:
    _, unknown = D.latest_review(wh.extracted_documents, review_log(wh))
    return unknown


def link_log(wh) -> DataFrame:
    """Manual links: documents whose key is a multiple of 6 are re-pointed."""
    e = (wh.extracted_documents.select("document_id", F.substring("document_id", 5, 20).cast("bigint").alias("n"))
         .filter(F.col("n") % 6 == 0))
    s = wh.shipments.select("id", "shipment_id", "booking_date")
    first = (e.join(s, F.col("id") == F.col("n") + 1)
             .select("document_id", "shipment_id", F.col("booking_date").cast("timestamp_ntz").alias("linked_at")))
    second = (e.filter(F.col("n") % 12 == 0).join(s, F.col("id") == F.col("n") + 2)
              .select("document_id", "shipment_id",
                      (F.col("booking_date").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY")).alias("linked_at")))
    stray = (wh.extracted_documents.select(F.substring("document_id", 5, 20).cast("bigint").alias("n"), "upload_timestamp")
             .filter(F.col("n") % 14 == 0)  # ids that no document has
             .select(F.concat(F.lit("DOC-Y"), F.col("n").cast("string")).alias("document_id"), F.lit("SHP-0").alias("shipment_id"),
                     F.col("upload_timestamp").cast("timestamp_ntz").alias("linked_at")))
    return first.unionByName(second).unionByName(stray)


def i19_manual_link(wh) -> DataFrame:
    merged, _ = D.manual_links(wh.extracted_documents, link_log(wh))
    return merged.select("document_id", "linked_shipment_id")


def i19_unknown_links(wh) -> DataFrame:
    _, unknown = D.manual_links(wh.extracted_documents, link_log(wh))
    return unknown


def i20_field_registry(wh) -> DataFrame:
    return D.field_registry(wh.extracted_documents)


def i21_confidence_bands(wh) -> DataFrame:
    e = wh.extracted_documents
    return (e.groupBy("document_type", D.confidence_band(F.col("overall_confidence")).alias("band"))
            .agg(F.count("*").alias("documents")))


def i22_type_rollup(wh) -> DataFrame:
    e = wh.extracted_documents
    return e.groupBy("document_type").agg(F.count("*").alias("count"),
                                          F.round(F.avg("overall_confidence"), 2).alias("avg_confidence"))


def _j(path: str) -> F.Column:
    return F.get_json_object("extracted_fields", f"$.{path}")


def i23_bol_fields(wh) -> DataFrame:
    e = wh.extracted_documents.filter(F.col("document_type") == "bill_of_lading")
    return e.select("document_id", _j("bl_number").alias("bl_number"), _j("vessel_name").alias("vessel_name"),
                    _j("port_of_loading").alias("loading_port"), _j("port_of_discharge").alias("discharge_port"),
                    _j("shipper_name").alias("shipper"))


def i23_packing_fields(wh) -> DataFrame:
    e = wh.extracted_documents.filter(F.col("document_type") == "packing_list")
    return e.select("document_id", _j("packing_list_number").alias("pl_number"),
                    _j("total_gross_weight").alias("gross_weight"), _j("total_net_weight").alias("net_weight"),
                    _j("total_packages").alias("packages"))


def i23_customs_fields(wh) -> DataFrame:
    e = wh.extracted_documents.filter(F.col("document_type") == "customs_declaration")
    return e.select("document_id", _j("declaration_number").alias("declaration"),
                    _j("declared_value").alias("declared_value"), _j("country_of_origin").alias("origin"),
                    _j("hs_code").alias("hs_code"))


def i23_invoice_fields(wh) -> DataFrame:
    e = wh.extracted_documents.filter(F.col("document_type") == "invoice")
    return e.select("document_id", _j("invoice_number").alias("invoice_number"),
                    _j("total_amount").alias("total_amount"), _j("vendor_name").alias("vendor_name"))


def i23_parties(wh) -> DataFrame:
    e = wh.extracted_documents
    return e.select("document_id", "document_type", _j("shipper_name").alias("shipper"),
                    _j("consignee_name").alias("consignee"), _j("vendor_name").alias("vendor"),
                    _j("buyer_name").alias("buyer"))


def i24_high_confidence_invoices(wh, threshold: float = 0.9) -> DataFrame:
    e = wh.extracted_documents.filter((F.col("document_type") == "invoice")
                                      & (F.col("overall_confidence") > threshold))
    return e.agg(F.count("*").alias("invoices_above_threshold"))


def _ingested(wh) -> tuple[DataFrame, DataFrame]:
    """Documents and field names after streaming every response, once per warehouse."""
    from tidewater.streaming.ingest import ingest_from_warehouse

    if "__ingested" not in wh._frames:
        wh._frames["__ingested"] = tuple(wh.spark.read.parquet(p) for p in ingest_from_warehouse(wh))
    return wh._frames["__ingested"]


def m1_stream_ingest(wh) -> DataFrame:
    """M1: the raw responses streamed in: what is stored of each document."""
    return _ingested(wh)[0].select("document_id", "document_type", "linked_shipment_id", "notes")


def m1_field_registry(wh) -> DataFrame:
    """M1 + I20: the field names that the streams registered."""
    return _ingested(wh)[1].select("field_name")
