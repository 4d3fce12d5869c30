"""Exact deduplication as a stateful stream without expiry.

Documents land as digest rows (digest, stable identifier, content locator). A
streaming aggregation keyed by the digest holds one state row per digest for
ever, in RocksDB on the executors' disks, checkpointed to the shared folder:
how many rows arrived and which row stays. Later arrivals resume from the same
checkpoint. Digests that were hit more than once have their full normalised
bytes checked; texts that differ under one digest are grouped by their bytes.

Everything is DataFrame operations: the digest, the state and the check.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import SPACE, stage, text_of
from tidewater.session import shared_path

#: State on disk. Each partition's store is small, so it takes no space ahead, and
#: a commit uploads the changes instead of whole files.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


#: Bits of the bitmap of hit digests: 4 MB, whatever the input.
FILTER_BITS = 1 << 25
HOT_SHARE = 1000


def normalised(text: Column) -> Column:
    """The text without any character of SPACE."""
    return F.regexp_replace(text, f"{SPACE}+", "")


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm, 256)


def smaller_first(doc_id) -> Column:
    """An order in which smaller identifiers are larger, and its own inverse: all
    bits turned, since the smallest number has no negative."""
    return F.bitwise_not(doc_id)


class DedupState:
    """Keyed deduplication state in ``home``, a folder that all executors share.

    ``ingest`` may be called again with further documents; the state carries on
    from its checkpoint. A digest row that was written but not yet processed is
    processed by the next ``ingest``, and a replayed micro-batch overwrites its
    own update files, so a restart neither loses nor counts twice.
    """

    def __init__(self, spark: SparkSession, home: str | None = None, digest=sha256_hex):
        self.home = home or shared_path(spark, "llm", f"dedup-{uuid.uuid4().hex}")
        self.digest = digest
        self.spark = spark
        # The stream has a session of its own: its state store setting must not leak into the caller's.
        self.session = spark.newSession()
        for key, value in STATE_STORE.items():
            self.session.conf.set(key, value)
        self.session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))

    def ingest(self, docs: DataFrame) -> None:
        landed = self._digest_rows(docs)
        landed.write.mode("append").parquet(f"{self.home}/landed")
        stream = self.session.readStream.schema(landed.schema).parquet(f"{self.home}/landed")
        # Longest text first, then the smallest identifier; a null one loses to any other.
        rank = F.struct("n_chars", smaller_first("doc_id").alias("minus_id"), "locator")
        state = stream.groupBy("digest").agg(F.count("*").alias("n"), F.max(rank).alias("best"))
        updates = f"{self.home}/updates"

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{updates}/batch={batch_id}")

        query = (state.writeStream.outputMode("update").foreachBatch(keep).trigger(availableNow=True)
                 .option("checkpointLocation", f"{self.home}/checkpoint").start())
        query.awaitTermination()

    def _digest_rows(self, docs: DataFrame) -> DataFrame:
        text = text_of(docs)
        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"),
                           F.unhex(self.digest(normalised(text))).alias("digest"), F.input_file_name().alias("locator"))
        return rows

    def landed(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.home}/landed")

    def groups(self) -> DataFrame:
        """(digest, n, keep_id, locator): both state values only grow, so the
        last update of a digest is the largest."""
        updates = self.spark.read.parquet(f"{self.home}/updates")
        last = updates.groupBy("digest").agg(F.max("n").alias("n"), F.max("best").alias("best"))
        return last.select("digest", "n", smaller_first("best.minus_id").alias("keep_id"), F.col("best.locator").alias("locator"))


def _bit(digest: Column) -> Column:
    """A digest's place among FILTER_BITS bits, counted from 1."""
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BITS)) + 1


def only_hits(texts: DataFrame, hits: DataFrame) -> DataFrame:
    """``texts`` (digest, ...) without most of those whose digest no hit has: a
    bitmap of fixed size, broadcast, tells in the scan. A few others stay."""
    bits = hits.select(_bit(F.col("digest")).alias("bit"))
    bitmap = bits.groupBy(F.bitmap_bucket_number("bit").alias("__page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    place = F.bitmap_bit_position(_bit(F.col("digest")))
    paged = texts.join(F.broadcast(bitmap), F.bitmap_bucket_number(_bit(F.col("digest"))) == F.col("__page"))
    byte = F.conv(F.hex(F.substring(F.col("__bits"), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return paged.where(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0).drop("__page", "__bits")


def _differing(state: DedupState, docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Digests under which full normalised bytes differ. Rows that a fixed-size
    bitmap of the hit digests denies are left out in the scan; the others are
    reduced to their least and greatest bytes a digest and task before the
    shuffle, so a group with a third of all rows meets as a few rows."""
    norm = normalised(text_of(docs))
    texts = docs.select(F.unhex(state.digest(norm)).alias("digest"), norm.alias("norm"))
    spans = only_hits(texts, groups.where("n > 1")).groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return spans.where("low <> high").select("digest")


def _with_group(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the size and keeper of their digest. Groups with a
    HOT_SHARE-th of all rows or more are at most HOT_SHARE: they are broadcast,
    and no task gets a large share of the rows by their digest."""
    total = groups.agg(F.sum("n")).first()[0] or 0
    keyed = groups.select("digest", "n", "keep_id")
    hot = F.broadcast(keyed.where(F.col("n") * HOT_SHARE >= total))
    cold = rows.join(hot.select("digest"), "digest", "left_anti").join(keyed.where(F.col("n") * HOT_SHARE < total), "digest")
    return rows.join(hot, "digest").unionByName(cold)


def exact_groups(docs: DataFrame, digest=sha256_hex) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Null text is empty text. keep_id is the row with the most code points in
    its original text, then the smallest doc_id (null last). Rows repeated
    under one doc_id count in group_size and share their verdict. An empty table
    gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    state = DedupState(spark, digest=digest)
    state.ingest(docs)
    groups = stage(state.groups(), "groups")
    rows = _with_group(state.landed().select("doc_id", "digest"), groups)
    result = _verdicts(rows.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256")))
    clash = stage(_differing(state, docs, groups), "differing")
    if clash.isEmpty():
        return result
    # Equal digests of different bytes: group those rows by digest and bytes.
    text = text_of(docs)
    norm = normalised(text)
    full = (docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.length(text).cast("long").alias("n_chars"), norm.alias("norm"),
                        F.unhex(digest(norm)).alias("digest")).join(clash, "digest", "left_semi"))
    best = full.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), F.max(F.struct("n_chars", smaller_first("doc_id").alias("minus_id"))).alias("best"))
    apart = full.join(best, ["digest", "norm"]).select("doc_id", smaller_first("best.minus_id").alias("keep_id"), "group_size", F.lower(F.hex("digest")).alias("text_sha256"))
    same = rows.join(clash, "digest", "left_anti").select("doc_id", "keep_id", F.col("n").alias("group_size"), F.lower(F.hex("digest")).alias("text_sha256"))
    return _verdicts(same.union(apart))


def _verdicts(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one per group of equal texts; rows
    repeated under one doc_id with one text are one."""
    groups = stage(exact_groups(docs).where("kept").select(F.col("doc_id").alias("__kept"), F.col("text_sha256").alias("__sha")), "kept")
    own_id = docs["doc_id"].cast("long")
    ids = docs.groupBy(own_id.alias("id")).count().where("count > 1")
    if ids.isEmpty():
        return docs.join(groups, own_id.eqNullSafe(groups["__kept"]), "left_semi")
    # Identifiers repeat: a row is known by identifier and digest.
    sha = sha256_hex(normalised(text_of(docs)))
    same = own_id.eqNullSafe(groups["__kept"]) & (sha == groups["__sha"])
    first = docs.join(groups.distinct(), same, "left_semi")
    return first.withColumn("__id", F.col("doc_id")).withColumn("__sha", sha256_hex(normalised(text_of(first)))).dropDuplicates(["__id", "__sha"]).drop("__id", "__sha")
