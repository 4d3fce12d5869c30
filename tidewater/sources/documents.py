"""Document store and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.config import SETTINGS
from tidewater.sources.store import DocumentStore, path_exists


def stored_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty if nothing was ever written there; any
    other failure to read it is raised."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_documents(spark: SparkSession, new_docs: DataFrame, path: str) -> DataFrame:
    """A10: append with status ``pending``; ids already stored are returned, not written.

    Only the buckets that the new ids fall into are read. A replayed append
    writes nothing; duplicates are reported back to the caller as the reference
    reports them as errors.
    """
    return DocumentStore(spark, path).append(new_docs.withColumn("review_status", F.lit("pending")))


def list_documents(docs: DataFrame) -> DataFrame:
    """Newest first with the JSON maps parsed; malformed JSON stays as text."""
    fields = F.from_json("extracted_fields", "map<string,string>")
    scores = F.from_json("confidence_scores", "map<string,double>")
    return docs.select("*", fields.alias("fields_map"), scores.alias("scores_map")).orderBy(
        F.desc("upload_timestamp"), F.asc("document_id"))


def get_document(docs: DataFrame, document_id: str) -> DataFrame:
    """Point lookup; an empty DataFrame when absent."""
    return docs.filter(F.col("document_id") == document_id)


def screen_uploads(spark: SparkSession, pattern: str) -> DataFrame:
    """File type and size screening over a folder, reading metadata only.

    ``binaryFile`` prunes the content column, so only paths and lengths are
    listed; no file body crosses to the driver.
    """
    files = spark.read.format("binaryFile").load(pattern).select("path", "length")
    return screen_manifest(files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "length"))


def screen_manifest(files: DataFrame) -> DataFrame:
    """A13 over a table of (file_name, length)."""
    name = F.col("file_name")
    ext = F.lower(F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)))
    max_bytes = SETTINGS.max_file_size_mb * 1024 * 1024
    allowed = F.array(*[F.lit(e) for e in SETTINGS.supported_file_types])
    reason = (F.when(ext.isNull() | ~F.array_contains(allowed, ext),
                     F.concat(F.lit("Unsupported file type: ."), F.coalesce(ext, F.lit(""))))
              .when(F.col("length") > max_bytes, F.lit(f"File too large (max {SETTINGS.max_file_size_mb} MB)")))
    return files.select("file_name", "length", reason.isNull().alias("accepted"), reason.alias("reason"))


def write_results(results: DataFrame, path: str, summary: dict[str, DataFrame] | None = None) -> None:
    """Evaluation results as JSON lines in ``results``, and each part of
    their summary in ``summary/<part>``. The summary is written last: a folder
    with all its parts is complete."""
    results.write.mode("overwrite").json(f"{path}/results")
    for part, rows in (summary or {}).items():
        rows.write.mode("overwrite").json(f"{path}/summary/{part}")
