"""Catalogue and document-store jobs bound to the warehouse."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.config import KNOWN_TABLES
from tidewater.operators import document_jobs as DJ
from tidewater.operators import documents as D
from tidewater.operators import evaluation as E
from tidewater.operators import evaluation_jobs as EJ
from tidewater.session import shared_path
from tidewater.sources import catalog as C
from tidewater.sources import documents as SD
from tidewater.sources.store import DocumentStore


def a3_table_names(wh) -> DataFrame:
    """The tables that hold rows, sorted."""
    return C.row_counts(wh, C.table_names(wh.spark)).filter("row_count > 0").select("table_name").orderBy("table_name")


def a4_column_metadata(wh) -> DataFrame:
    """Columns with type, declared NOT NULL, default and key, and the nulls that the data holds."""
    profiled = reduce(DataFrame.unionByName, [C.null_counts(wh, t) for t in KNOWN_TABLES])
    return profiled.join(C.column_metadata(wh.spark, wh), ["table_name", "column_name"])


def l5_quarantine(wh) -> DataFrame:
    """Declared constraints on write: shipments whose status, country or delay is
    lost for some ids pass through the checked writer; what was stored, what went
    to quarantine and for which columns."""
    schema = C.declared("shipments", wh.shipments.schema)
    lost = {"status": F.when(F.col("id") % 5 != 0, F.col("status")), "origin_country": F.when(F.col("id") % 7 != 0, F.col("origin_country")),
            "delay_days": F.when(F.col("id") % 3 != 0, F.col("delay_days"))}
    folder = shared_path(wh.spark, "checked", uuid.uuid4().hex)
    C.write_checked(wh.shipments.withColumns(lost).drop("priority"), schema, f"{folder}/stored", f"{folder}/quarantine")
    good, bad = wh.spark.read.parquet(f"{folder}/stored"), wh.spark.read.parquet(f"{folder}/quarantine")
    shape = [F.count("*").alias("shipments"), F.sum("delay_days").alias("delay_days"), F.count_if(F.col("priority") == "standard").alias("standard")]
    return good.withColumn("violations", F.lit("")).groupBy("violations").agg(*shape).unionByName(
        bad.withColumn("violations", F.array_join("violations", ",")).groupBy("violations").agg(*shape))


def a5_foreign_keys(wh) -> DataFrame:
    """Declared keys with the child rows that carry one."""
    def carried(child: str, column: str) -> DataFrame:
        return wh.table(child).agg(F.count(column).alias("rows_with_key")).select(
            F.lit(child).alias("from_table"), F.lit(column).alias("from_column"), "rows_with_key")

    counts = reduce(DataFrame.unionByName, [carried(k[0], k[1]) for k in C.FOREIGN_KEYS])
    return C.foreign_keys(wh.spark).join(counts, ["from_table", "from_column"])


def a7_schema_text(wh) -> DataFrame:
    return C.schema_text(wh)


def a10_append(wh) -> DataFrame:
    """Two appends to a new store, the second with ids that are stored and ids
    twice in itself: per type, rows stored and duplicates reported."""
    path = shared_path(wh.spark, "store", uuid.uuid4().hex)
    docs = wh.extracted_documents.select("id", "document_id", "document_type", "file_name", "extracted_fields")
    first = SD.append_documents(wh.spark, docs.filter("id % 3 <> 0"), path)
    later = docs.filter("id % 3 <> 1")
    second = SD.append_documents(wh.spark, later.unionByName(later.filter("id % 3 = 0")), path)
    stored = DocumentStore(wh.spark, path).read().select("document_id", "review_status", "document_type")
    twice = first.unionByName(second).groupBy("document_id").agg(F.count("*").alias("n"))
    return (stored.join(twice, "document_id", "left").groupBy("document_type", "review_status")
            .agg(F.count("*").alias("stored"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicates")))


def a11_list_documents(wh) -> DataFrame:
    listed = SD.list_documents(wh.extracted_documents)
    return listed.select("document_id", "document_type", F.size("fields_map").alias("n_fields"),
                         F.array_join(F.array_sort(F.map_keys("scores_map")), ",").alias("scored_fields"))


def a12_get_document(wh) -> DataFrame:
    """A point lookup in the document store: the document uploaded last."""
    path = shared_path(wh.spark, "store", uuid.uuid4().hex)
    store = DocumentStore(wh.spark, path)
    store.append(wh.extracted_documents)
    last = wh.extracted_documents.agg(F.max_by("document_id", F.struct("upload_timestamp", "document_id"))).scalar()
    wanted = wh.spark.range(1).select(last).first()[0]
    return store.get(wanted).select("document_id", "document_type", "review_status")


def a13_upload_screening(wh) -> DataFrame:
    """Screening of a manifest: the documents' files and the pages by name and size."""
    files = wh.raw_responses.select("file_name", F.octet_length("response_text").cast("bigint").alias("length"))
    # pages stand for large uploads: their sizes are counted in kilobytes
    path = F.element_at(F.split(F.element_at(F.split("url", "[?]"), 1), "/"), -1)
    pages = wh.pages.select(F.concat(path, F.element_at(F.array(*[F.lit(e) for e in (".PDF", ".png", ".exe", "")]),
                                                         (F.col("page_id") % 4 + 1).cast("int"))).alias("file_name"),
                            (F.octet_length("html").cast("bigint") * 4096).alias("length"))
    return SD.screen_manifest(files.unionByName(pages))


def a15_result_sink(wh) -> DataFrame:
    """Evaluation results and their summary as JSON lines, read back: counts of
    the results beside what the summary says of each model."""
    path = shared_path(wh.spark, "results", uuid.uuid4().hex)
    results = EJ.costed(wh)
    models = E.model_summary(results)
    SD.write_results(results, path, {"models": models, "categories": E.category_matrix(results),
                                     "winners": E.winners(models, EJ.prices(wh)), "failed_cases": E.failed_cases(results)})
    read = wh.spark.read
    back = read.schema("test_id bigint, model string, correct_behavior int, output_tokens bigint").json(f"{path}/results")
    said = read.schema("model string, test_count bigint, composite_score double").json(f"{path}/summary/models")
    failed = read.schema("test_id bigint, model string").json(f"{path}/summary/failed_cases").groupBy("model").agg(F.count("*").alias("failed"))
    won = read.schema("overall_winner string").json(f"{path}/summary/winners")
    counts = back.groupBy("model").agg(F.count("*").alias("results"), F.sum("correct_behavior").alias("correct"), F.sum("output_tokens").alias("output_tokens"))
    joined = counts.join(said, "model").join(failed, "model", "left").join(won.select(F.col("overall_winner").alias("model"), F.lit(True).alias("is_winner")), "model", "left")
    return joined.select("model", "results", "correct", "output_tokens", F.col("test_count").alias("summary_count"), "composite_score",
                         F.coalesce("failed", F.lit(0)).alias("failed"), F.coalesce("is_winner", F.lit(False)).alias("is_winner"))


def _merged(wh, log: DataFrame, apply) -> tuple[DocumentStore, DataFrame]:
    store = DocumentStore(wh.spark, shared_path(wh.spark, "store", uuid.uuid4().hex))
    store.append(wh.extracted_documents)
    return store, store.merge(log, apply)


def i18_stored_reviews(wh) -> DataFrame:
    """The review log merged into the document store: status and corrected
    documents of the stored table, per type."""
    store, _ = _merged(wh, DJ.review_log(wh), D.latest_review)
    return store.read().groupBy("document_type", "review_status").agg(
        F.count("*").alias("documents"), F.count_if(F.col("extracted_fields").contains("corrected_by")).alias("corrected"))


def i19_stored_links(wh) -> DataFrame:
    """The manual links merged into the document store, and the ids it doesn't hold."""
    store, unknown = _merged(wh, DJ.link_log(wh), D.manual_links)
    linked = store.read().select("document_id", "linked_shipment_id", F.lit(True).alias("known"))
    return linked.unionByName(unknown.select("document_id", F.lit(None).cast("string").alias("linked_shipment_id"), F.lit(False).alias("known")))
