"""A stored document table with an index.

Documents are dealt to hash buckets of document_id, sorted inside a bucket,
and each file carries a Parquet Bloom filter of its ids. A point lookup opens
one bucket and skips the row groups whose filter denies the id; an append reads
the ids of only those buckets that its documents fall into; a merge rewrites
only the buckets that its log touches, all other files stay as they are.

Every write is a folder of its own, ``write=n/bucket=b``. It counts once its
entry in ``_writes`` is there (which buckets it wrote, and which of them
replace everything older), so a write that was lost half-way is not seen and
is written over by the next one. One writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewater.session import shared_path

KEY = "document_id"
ENTRY = "write int, written array<int>, replaced array<int>"


def indexed_writer(df: DataFrame, column: str, distinct: int = 1_000_000):
    """A Parquet writer whose row groups have a Bloom filter of ``column``;
    ``distinct``: values expected in a row group."""
    return (df.write.option(f"parquet.bloom.filter.enabled#{column}", "true")
            .option(f"parquet.bloom.filter.expected.ndv#{column}", str(distinct)))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the folder is there, by Spark's own file systems."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class DocumentStore:
    """The table at ``path``. ``buckets`` counts when the table is first
    written; later instances take it from there."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 32):
        self.spark, self.path, self.buckets = spark, path, buckets
        if path_exists(spark, f"{path}/_buckets"):
            self.buckets = spark.read.schema("buckets int").json(f"{path}/_buckets").first()[0]

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _entries(self) -> list:
        """All counted writes in order: a short row each."""
        if not path_exists(self.spark, f"{self.path}/_writes"):
            return []
        return sorted(self.spark.read.schema(ENTRY).json(f"{self.path}/_writes/*").collect())

    def _folders(self, buckets: list[int] | None = None) -> list[str]:
        """The folders that hold the table's rows, of some buckets or all."""
        live: dict[int, list[str]] = {}
        for e in self._entries():
            for b in e.replaced:
                live.pop(b, None)
            for b in e.written:
                live.setdefault(b, []).append(f"{self.path}/write={e.write}/bucket={b}")
        return [f for b, folders in sorted(live.items()) if buckets is None or b in buckets for f in folders]

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The documents, of some buckets or all; None if there are none."""
        folders = self._folders(buckets)
        if not folders:
            return None
        return self.spark.read.option("basePath", self.path).parquet(*folders).drop("write")

    def get(self, document_id: str) -> DataFrame | None:
        """The row of one id, if any, out of one bucket."""
        found = self.read()
        at = self.bucket_of(F.lit(document_id))  # folded to a constant: the partition filter
        return None if found is None else found.where((F.col("bucket") == at) & (F.col(KEY) == document_id)).drop("bucket")

    def _touched(self, rows: DataFrame) -> list[int]:
        """The buckets of some rows: at most ``buckets`` numbers."""
        return sorted(r[0] for r in rows.select(self.bucket_of(F.col(KEY))).distinct().collect())

    def _write(self, rows: DataFrame, replace: bool) -> None:
        entries = self._entries()
        if not entries:
            self.spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.mode("overwrite").json(f"{self.path}/_buckets")
        number = entries[-1].write + 1 if entries else 0
        dealt = rows.withColumn("bucket", self.bucket_of(F.col(KEY))).repartition("bucket").sortWithinPartitions("bucket", KEY)
        indexed_writer(dealt, KEY).mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/write={number}")
        written = self._written(number)
        entry = self.spark.createDataFrame([(number, written, written if replace else [])], ENTRY)
        entry.coalesce(1).write.mode("overwrite").json(f"{self.path}/_writes/{number}")

    def _written(self, number: int) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/write={number}")
        listed = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(folder)
        names = [f.getPath().getName() for f in listed]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))

    def append(self, new_docs: DataFrame) -> DataFrame:
        """A10: store the documents whose ids are new; the ids of the others, one
        row per refused document. Of rows with one id inside one append the first
        by its JSON text stays."""
        order = W.partitionBy(KEY).orderBy(F.to_json(F.struct(*new_docs.columns)))
        ranked = new_docs.withColumn("__n", F.row_number().over(order))
        stored = self.read(self._touched(new_docs))
        first, again = ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").select(KEY)
        fresh, known = first, None
        if stored is not None:
            fresh = first.join(stored.select(KEY), KEY, "left_anti")
            known = first.join(stored.select(KEY), KEY, "left_semi").select(KEY)
        refused = again if known is None else again.unionByName(known)
        # written before the append changes what is stored
        reported = shared_path(self.spark, "store-duplicates", uuid.uuid4().hex)
        refused.write.parquet(reported)
        self._write(fresh.select(*new_docs.columns), replace=False)
        return self.spark.read.schema(refused.schema).parquet(reported)

    def merge(self, log: DataFrame, apply: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
        """Rewrite the buckets that ``log`` (document_id, ...) touches
        by ``apply(documents, log)``, which returns the changed documents and
        the ids that are unknown; these are returned. A merge repeated after a
        failure gives the same rows."""
        touched = self._touched(log)
        current = self.read(touched)
        if current is None:
            return log.select(KEY).distinct()
        merged, unknown = apply(current.drop("bucket"), log)
        self._write(merged, replace=True)
        return unknown
