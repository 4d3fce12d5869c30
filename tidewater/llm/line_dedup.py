"""Line deduplication over levelled sorted runs of line hashes.

Documents land as one row of line hashes each and are read back as a stream of
batches. A batch is counted by line; it is merge-anti-joined with the runs'
settled lines (those that one run already finds in enough documents need no
more counting) and adds what is left as a run of its own: a table bucketed and
sorted by hash. Every ``fanout`` runs of one level are merged into one run of
the next, so after m batches about log m runs are live, and which ones follows
from m alone. Runs meet each other and new batches without being shuffled.

A line is known by two independent 64-bit hashes of its key. Only expressions,
joins and aggregations; ``foreachBatch`` runs on the driver and moves no rows.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import let, text_of
from tidewater.session import shared_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"
SEED = 0x5EED
KEY = ["h1", "h2"]
LANDED = "doc_id long, digest long, lines array<struct<h1:long,h2:long,at:array<int>>>"
#: Lines with this share of a batch's postings or more are resolved by a
#: broadcast of at most HOT_SHARE rows; all others by a join.
HOT_SHARE = 1000


def line_keys(lines: Column) -> Column:
    """Each line without blanks at its ends, A to Z lower-cased."""
    ascii_lower = lambda s: F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))
    return F.transform(F.transform(lines, lambda s: F.btrim(s, F.lit(BLANKS))), ascii_lower)


def hashed_lines(text: Column) -> Column:
    """One (h1, h2, at) per different key of a text, at: its line numbers from
    0 in order. Lines without a key are left out. Linear for texts without
    repeated lines, n log n for others."""
    numbered = F.filter(F.transform(line_keys(F.split(text, "\n", -1)), lambda k, i: F.when(
        k != "", F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(SEED), k).alias("h2"), i.alias("at")))), lambda x: x.isNotNull())

    def same(x: Column, y: Column) -> Column:
        return (x["h1"] == y["h1"]) & (x["h2"] == y["h2"])

    def grouped(order: Column) -> Column:
        ends = F.filter(F.transform(order, lambda x, i: F.when(~F.coalesce(same(x, F.get(order, i + 1)), F.lit(False)), i)), lambda i: i.isNotNull())
        return let(ends, lambda e: F.transform(e, lambda end, j: let(F.coalesce(F.get(e, j - 1) + 1, F.lit(0)), lambda start: F.struct(
            F.get(order, end)["h1"].alias("h1"), F.get(order, end)["h2"].alias("h2"),
            F.transform(F.slice(order, start + 1, end - start + 1), lambda x: x["at"]).alias("at")))))

    single = lambda v: F.transform(v, lambda x: F.struct(x["h1"].alias("h1"), x["h2"].alias("h2"), F.array(x["at"]).alias("at")))
    return let(numbered, lambda v: F.when(F.size(F.array_distinct(v["h1"])) == F.size(v), single(v)).otherwise(let(F.sort_array(v), grouped)))


def live_runs(batches: int, fanout: int) -> list[tuple[int, int]]:
    """(level, number) of the runs that hold the first ``batches`` batches: run
    k of level l holds batches k * fanout^l and on."""
    level = 0
    while fanout ** (level + 1) <= batches:
        level += 1
    found, done = [], 0
    for at in range(level, -1, -1):
        size = fanout ** at
        while batches - done >= size:
            found.append((at, done // size))
            done += size
    return found


class LineRuns:
    """The runs in ``home``, a folder that all executors share.

    ``ingest`` may be called again with further documents. A batch replayed
    after a failure overwrites its own run, and a replayed merge its own
    result, so nothing is counted twice; a folder opened again goes on from its
    checkpoint (``fanout`` and ``buckets`` must be those of its first use).
    """

    def __init__(self, spark: SparkSession, home: str | None = None, min_docs: int = 10, fanout: int = 2, buckets: int | None = None):
        self.spark = spark
        self.home = home or shared_path(spark, "llm", f"lines-{uuid.uuid4().hex}")
        self.min_docs, self.fanout = min_docs, fanout
        # Settings for buckets as join partitions, in a session of its own: they must not leak into the caller's.
        self.session = spark.newSession()
        for key, value in {"spark.sql.shuffle.partitions": buckets or spark.conf.get("spark.sql.shuffle.partitions"),
                           "spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}.items():
            self.session.conf.set(key, str(value))
        self.buckets = int(self.session.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"line_runs_{uuid.uuid4().hex}"
        self.tables: set[str] = set()

    def ingest(self, docs: DataFrame, batches: int = 4) -> None:
        """Add ``docs`` in about so many batches, each some of its scan tasks."""
        before = self._files()
        text = text_of(docs)
        landed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("digest"), hashed_lines(text).alias("lines"))
        landed.where(F.size("lines") > 0).write.mode("append").parquet(f"{self.home}/landed")
        per_batch = max(1, -(-(self._files() - before) // batches))
        stream = self.session.readStream.schema(LANDED).option("maxFilesPerTrigger", per_batch).parquet(f"{self.home}/landed")
        query = (stream.writeStream.foreachBatch(self._add).trigger(availableNow=True)
                 .option("checkpointLocation", f"{self.home}/checkpoint").start())
        query.awaitTermination()

    def _files(self) -> int:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/landed")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(path)) if fs.exists(path) else 0

    def _add(self, batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        posted = batch.select(F.explode("lines").alias("l")).select("l.h1", "l.h2")
        counts = posted.groupBy(*KEY).agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # All lines of this batch's largest share, before the settled ones leave it.
            total = counts.agg(F.sum("n")).first()[0] or 0
            counts.where(F.col("n") * HOT_SHARE >= total).write.mode("overwrite").parquet(f"{self.home}/hot/batch={number}")
            self._write(self.unsettled(session, counts, number), 0, number)
        finally:
            counts.unpersist()
        level, done = 0, number + 1
        while done % self.fanout == 0:
            done //= self.fanout
            parts = [(level, done * self.fanout - k) for k in range(self.fanout, 0, -1)]
            level += 1
            self._write(self.merged([self.run(session, *p) for p in parts]), level, done - 1)

    def unsettled(self, session: SparkSession, counts: DataFrame, number: int) -> DataFrame:
        """The lines of batch ``number`` that no run before it has settled."""
        for run in live_runs(number, self.fanout):
            settled = self.run(session, *run).where(F.col("n") >= self.min_docs).hint("merge")
            counts = counts.join(settled, KEY, "left_anti")
        return counts

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs as one, counts added. A merge join of two runs moves no rows; a
        union would lose the buckets."""
        def both(x: DataFrame, y: DataFrame) -> DataFrame:
            n = F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))
            return x.join(y.withColumnRenamed("n", "m").hint("merge"), KEY, "full_outer").select(*KEY, n.alias("n"))

        return reduce(both, runs)

    def _path(self, name: str) -> str:
        return f"{self.home}/runs/{name}"

    def _write(self, lines: DataFrame, level: int, number: int) -> None:
        name = f"{level}_{number}"
        self.tables.add(f"{self.prefix}_{name}")
        (lines.write.mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet")
         .option("path", self._path(name)).saveAsTable(f"{self.prefix}_{name}"))

    def run(self, session: SparkSession, level: int, number: int) -> DataFrame:
        """(h1, h2, n) of one run, bucketed and sorted."""
        name = f"{level}_{number}"
        self.tables.add(f"{self.prefix}_{name}")
        session.sql(f"CREATE TABLE IF NOT EXISTS {self.prefix}_{name} (h1 BIGINT, h2 BIGINT, n BIGINT) USING parquet "
                    f"CLUSTERED BY (h1, h2) SORTED BY (h1, h2) INTO {self.buckets} BUCKETS LOCATION '{self._path(name)}'")
        session.catalog.refreshTable(f"{self.prefix}_{name}")  # a replay may have written it over
        return session.read.table(f"{self.prefix}_{name}")

    def batches(self) -> int:
        """How many batches were added."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.home}/hot")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return len(fs.listStatus(path)) if fs.exists(path) else 0

    def frequent(self) -> DataFrame:
        """(h1, h2, n): lines of ``min_docs`` documents or more (n: at least so
        many), merged from the live runs, bucketed and sorted."""
        runs = [self.run(self.session, *r) for r in live_runs(self.batches(), self.fanout)]
        if not runs:
            return self.session.createDataFrame([], "h1 long, h2 long, n long")
        found = self.merged(runs).where(F.col("n") >= self.min_docs)
        name = f"{self.prefix}_frequent"
        self.tables.add(name)
        (found.write.mode("overwrite").bucketBy(self.buckets, *KEY).sortBy(*KEY).format("parquet").option("path", self._path("frequent")).saveAsTable(name))
        return self.session.read.table(name)

    def hot(self) -> DataFrame:
        """At most HOT_SHARE frequent lines. A line that is none of them has
        under 2 / HOT_SHARE of all postings: what the batches noted for it sums
        to less than one share, and what they didn't note to less than another."""
        if not self.batches():
            return self.session.createDataFrame([], "h1 long, h2 long")
        noted = self.session.read.schema("h1 long, h2 long, n long").parquet(f"{self.home}/hot").groupBy(*KEY).agg(F.sum("n").alias("n"))
        total = self._landed().agg(F.sum(F.size("lines"))).first()[0]
        return noted.where((F.col("n") >= self.min_docs) & (F.col("n") * HOT_SHARE >= total)).select(*KEY)

    def _landed(self) -> DataFrame:
        return self.session.read.schema(LANDED).parquet(f"{self.home}/landed")

    def dropped_lines(self) -> DataFrame:
        """(doc_id, digest, dropped): per document with a frequent line, by its
        identifier and its text's hash, the numbers of its frequent lines."""
        frequent = self.frequent()
        posted = self._landed().select("doc_id", "digest", F.explode("lines").alias("l")).select("doc_id", "digest", "l.*")
        hot = F.broadcast(self.hot())
        cold = posted.join(hot, KEY, "left_anti").join(frequent.select(*KEY).hint("merge"), KEY, "left_semi")
        hits = posted.join(hot, KEY, "left_semi").union(cold)
        # A set: rows repeated under one identifier bring the same line numbers.
        found = hits.groupBy("doc_id", "digest").agg(F.sort_array(F.flatten(F.collect_set("at"))).alias("dropped"))
        path = f"{self.home}/dropped-{uuid.uuid4().hex}"
        found.write.parquet(path)
        return self.spark.read.schema(found.schema).parquet(path)

    def release(self) -> None:
        """Take the runs out of the catalogue; their files stay in ``home``."""
        for name in sorted(self.tables):
            self.session.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables.clear()


def kept_text(text: Column, dropped: Column) -> Column:
    """``text`` without the lines of the ascending numbers ``dropped``: the
    stretches between them, joined again. Linear in the text."""

    def stretches(lines: Column) -> Column:
        borders = F.concat(dropped, F.array(F.size(lines)))
        return let(borders, lambda b: F.flatten(F.transform(b, lambda end, j: let(
            F.coalesce(F.get(b, j - 1) + 1, F.lit(0)), lambda start: F.slice(lines, start + 1, end - start)))))

    return F.array_join(let(F.split(text, "\n", -1), stretches), "\n")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4, fanout: int = 2, home: str | None = None) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for every row of ``docs``.

    A line whose key (its text without blanks at the ends, A to Z lower-cased)
    is found in ``min_docs`` rows or more goes from every row; a key counts once
    a row, and rows repeated under one doc_id count each. Lines without a key
    stay. Null and empty texts are one empty line. A text that loses every line
    is empty. Null identifiers are allowed; an empty table gives no rows; other
    columns are ignored.
    """
    runs = LineRuns(docs.sparkSession, home, min_docs, fanout)
    try:
        runs.ingest(docs, batches)
        found = runs.dropped_lines().withColumnsRenamed({"doc_id": "__of", "digest": "__digest"})
    finally:
        runs.release()
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("digest", F.xxhash64("text"))
    both = own.join(found, own["doc_id"].eqNullSafe(F.col("__of")) & (own["digest"] == F.col("__digest")), "left")
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return both.select("doc_id", n_lines.cast("long").alias("n_lines"), F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
                       F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept_text(F.col("text"), F.col("dropped"))).alias("kept_text"))
