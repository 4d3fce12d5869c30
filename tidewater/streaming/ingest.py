"""M1: incremental document ingest with Structured Streaming and keyed state.

Raw extraction responses land as Parquet files. A stateful stream over the
identifiers alone keeps, per document_id and for ever, when it first arrived
and where (file and row number), in RocksDB on the executors' disks. Only
identifiers that arrive for the first time pass on; their rows are read from
the batch's files, validated with the same row-local expressions as the batch
pipeline, linked to shipments against a key-unique reference index, and written
as the epoch's own folder. A replayed epoch has the same identifiers and
overwrites its folder, so nothing is written twice and nothing stored is read.

Field names (I20) are a second stream, over the documents so written, with the
same kind of state per name.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.operators import documents as D
from tidewater.session import shared_path
from tidewater.sources.documents import path_exists

RAW_SCHEMA = "document_id string, file_name string, document_type string, model string, response_text string"
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: Files of a micro-batch, unless the caller names another number.
FILES_PER_TRIGGER = 1000
#: Rows of a landed file, about.
LANDED_ROWS = 20_000


def _state_session(spark: SparkSession) -> SparkSession:
    """A session for the streams: their state store setting must not leak into the caller's."""
    session = spark.newSession()
    for key, value in {**STATE_STORE, "spark.sql.shuffle.partitions": spark.conf.get("spark.sql.shuffle.partitions")}.items():
        session.conf.set(key, value)
    return session


def first_arrivals(rows: DataFrame, key: str, *locator: Column) -> DataFrame:
    """(key, first) for the keys of a stream that arrive for the first time:
    ``first`` is the smallest of ``locator`` in that micro-batch. The state of a
    key is its first and last batch time; a batch keeps its time when it is
    replayed. Rows are reduced to one per key and task before they are shuffled."""
    seen = rows.select(key, F.struct(F.current_timestamp().alias("at"), *locator).alias("seen"))
    state = seen.groupBy(key).agg(F.min("seen").alias("first"), F.max("seen.at").alias("last"))
    return state.where(F.col("first.at") == F.col("last")).drop("last")


class EpochTable:
    """A folder with one sub-folder per writer (a checkpoint) and epoch."""

    def __init__(self, spark: SparkSession, path: str, checkpoint: str):
        self.spark, self.path = spark, path
        self.writer = "w" + hashlib.md5(checkpoint.encode()).hexdigest()[:12]

    def epoch(self, number: int) -> str:
        return f"{self.path}/writer={self.writer}/epoch={number}"

    def other_writers(self, schema: str) -> DataFrame | None:
        """What other checkpoints wrote, if any did: their state isn't ours.
        Null in the usual case of one checkpoint a table."""
        if not path_exists(self.spark, self.path):
            return None
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        listed = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = [f.getPath().getName() for f in listed]
        others = [f"{self.path}/{n}" for n in names if n.startswith("writer=") and n != f"writer={self.writer}"]
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*others) if others else None


def document_writer(index: DataFrame, table: EpochTable) -> Callable[[DataFrame, int], None]:
    def write_epoch(arrived: DataFrame, epoch_id: int) -> None:
        session = arrived.sparkSession
        arrived = arrived.select("document_id", "first.file", "first.row").persist()
        parsed = ready = None
        try:
            # The files of this micro-batch that hold new documents: the trigger bounds their number.
            files = [unquote(r.file) for r in arrived.select("file").distinct().collect()]
            if not files:
                return
            others = table.other_writers("document_id string")
            new = arrived if others is None else arrived.join(others, "document_id", "left_anti")
            raw = session.read.schema(RAW_SCHEMA).parquet(*files).withColumns({"file": F.col("_metadata.file_path"), "row": F.col("_metadata.row_index")})
            batch = raw.join(new.select("file", "row"), ["file", "row"], "left_semi").drop("file", "row")
            # Parsing costs far more than reading: a few small files are spread over all cores. The ids are unique here.
            parts = max(int(session.conf.get("spark.sql.shuffle.partitions")), session.sparkContext.defaultParallelism)
            batch = batch.repartition(parts, "document_id")
            parsed = D.parse_responses(batch).persist()  # batch-local; keeps later filters from re-parsing
            # Scored once: what is stored and what is looked up are both read from here.
            ready = D.to_stored(D.score_documents(parsed).withColumn("candidates", D.candidates(F.col("fmap"))), "candidates").persist()
            hits = D.link_candidates(ready, F.col("candidates")).join(index, ["kind", "ref"])
            best = hits.groupBy("document_id").agg(
                F.min_by("shipment_id", F.struct("priority", "sid")).alias("linked_shipment_id"))
            columns = [c if c != "candidates" else "linked_shipment_id" for c in ready.columns]
            stored = ready.join(best, "document_id", "left").select(*columns)
            stored.write.mode("overwrite").partitionBy("document_type").parquet(table.epoch(epoch_id))
        finally:
            for kept in (arrived, parsed, ready):
                if kept is not None:
                    kept.unpersist()

    return write_epoch


def name_writer(table: EpochTable) -> Callable[[DataFrame, int], None]:
    def write_epoch(arrived: DataFrame, epoch_id: int) -> None:
        others = table.other_writers("field_name string")
        names = arrived.select("field_name")
        new = names if others is None else names.join(others, "field_name", "left_anti")
        new.write.mode("overwrite").parquet(table.epoch(epoch_id))

    return write_epoch


def _run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (stream.writeStream.outputMode("update").foreachBatch(write)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def run_ingest(spark: SparkSession, landing_dir: str, out_dir: str, shipments: DataFrame, invoices: DataFrame,
               checkpoint_dir: str | None = None, files_per_trigger: int | None = None) -> tuple[str, str]:
    """Process every file now in ``landing_dir`` (availableNow) and return table paths.

    Of rows with one document_id the first stays: that of the earliest
    micro-batch, in it the first by file and row number. ``files_per_trigger``
    only bounds a micro-batch; all files are processed. The reference index is
    written once a run, not rebuilt for each micro-batch. State belongs to a
    checkpoint; if another checkpoint wrote to the same tables, what it wrote
    is read once a micro-batch instead.
    """
    docs_path = os.path.join(out_dir, "documents")
    registry_path = os.path.join(out_dir, "field_registry")
    ckpt = checkpoint_dir or os.path.join(out_dir, "_checkpoint")
    index_path = shared_path(spark, "m1_index", uuid.uuid4().hex)
    built = D.reference_index(shipments, invoices)
    built.write.parquet(index_path)
    index = spark.read.schema(built.schema).parquet(index_path)

    session = _state_session(spark)
    reader = session.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_trigger or FILES_PER_TRIGGER)
    landed = reader.parquet(landing_dir)
    ids = first_arrivals(landed, "document_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    _run(ids, document_writer(index, EpochTable(spark, docs_path, ckpt)), os.path.join(ckpt, "documents"))

    if path_exists(spark, docs_path):
        written = (session.readStream.schema("extracted_fields string").option("recursiveFileLookup", "true")
                   .option("maxFilesPerTrigger", FILES_PER_TRIGGER).parquet(docs_path))
        names = first_arrivals(written.select(F.explode(F.json_object_keys("extracted_fields")).alias("field_name")), "field_name")
        _run(names, name_writer(EpochTable(spark, registry_path, ckpt)), os.path.join(ckpt, "names"))
    return docs_path, registry_path


def ingest_from_warehouse(wh) -> tuple[str, str]:
    """Land the warehouse's raw responses as four arrivals and a replayed one,
    and stream them in; the paths of the two tables."""
    spark = wh.spark
    run = shared_path(spark, "m1_ingest", uuid.uuid4().hex)
    landing, out = os.path.join(run, "landing"), os.path.join(run, "out")
    raw = wh.raw_responses.select(*[c.split()[0] for c in RAW_SCHEMA.split(", ")])
    # As many files an arrival as a micro-batch takes: an arrival is one micro-batch, up to the usual bound.
    files = min(FILES_PER_TRIGGER, 1 + raw.count() // (4 * LANDED_ROWS))
    for i in range(4):  # every document lands, whatever its type
        (raw.filter(F.pmod(F.crc32(F.coalesce("document_id", F.lit("")).cast("binary")), F.lit(4)) == i).repartition(files)
         .write.mode("overwrite").parquet(os.path.join(landing, f"arrival={i}")))
    # a replayed arrival must not duplicate documents
    raw.filter(F.col("document_type") == "invoice").repartition(files).write.mode("overwrite").parquet(os.path.join(landing, "arrival=9"))
    return run_ingest(spark, os.path.join(landing, "*"), out, wh.shipments, wh.invoices, files_per_trigger=files)
