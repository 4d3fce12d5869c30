"""A1: scans of the driver tables and the logistics views built over them."""

from __future__ import annotations

import os
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewater.session import accept_repeated_keys, shared_path
from tidewater.sources.logistics_sql import view_sql
from tidewater.sources.store import indexed_writer

DRIVER_TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
# Views that stand for stored input tables: written once to the shared folder so their generating expressions are not
# re-planned into every job that parses them.
MATERIALISED = {"raw_responses"}

POINT_KEYS = {"shipments": "shipment_id", "extracted_documents": "document_id"}

LOGISTICS_VIEWS = [
    "customers", "carriers", "shipments", "shipment_charges", "tracking_events", "invoices",
    "extracted_documents",
]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


class Warehouse:
    """Lazily resolved DataFrames for one data folder.

    Base tables and logistics views are registered as temp views so
    ``spark.sql`` works too; each attribute is an analysed DataFrame, so later
    re-registration for another folder does not change it.
    """

    _cache: dict[tuple[str, str], "Warehouse"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._frames: dict[str, DataFrame] = {}
        self.materialized_at: str | None = None
        #: Of tables that materialize() wrote: rows, and nulls by column.
        self.profiles: dict[str, tuple[int, dict[str, int]]] = {}
        self._stages: list[str] = []
        self._seen: tuple = ()

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Warehouse":
        accept_repeated_keys(spark)
        key = (spark._jsparkSession.sessionUUID(), sf_dir.rstrip("/"))
        wh = cls._cache.setdefault(key, cls(spark, sf_dir))
        state = wh._input_state()
        if wh._seen != state:
            if wh._seen and not wh.materialized_at:
                wh.forget()
                wh._frames = {}
            wh._seen = state
        wh._register()
        return wh

    def _register(self) -> None:
        for name in DRIVER_TABLES:
            df = self._frames.get(name)
            if df is None:
                df = read_table(self.spark, self.sf_dir, name)
                self._frames[name] = df
            df.createOrReplaceTempView(name)
        for name, sql in self._views.items():
            df = self._frames.get(name)
            if df is None:
                df = self.spark.sql(sql)
                self._frames[name] = df
            df.createOrReplaceTempView(name)

    def memo(self, key: str, build) -> DataFrame:
        """A job stage written once to the shared checkpoint folder and reused.

        Used for multi-stage row pipelines whose output is a stored table in
        production; it also stops Catalyst from re-inlining expensive stage
        expressions into later filters.
        """
        df = self._frames.get(f"__memo_{key}")
        if df is None:
            df = self._written(build(), key)
            self._frames[f"__memo_{key}"] = df
        return df

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a Parquet table in the shared folder: later readers prune its
        columns, and a lost executor costs a re-read."""
        path = shared_path(self.spark, "stages", f"{name}-{uuid.uuid4().hex}")
        df.write.parquet(path)
        self._stages.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self) -> None:
        """Remove the written stages; the next query builds them anew."""
        for path in self._stages:
            target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)
        self._stages = []
        self._frames = {k: v for k, v in self._frames.items() if not k.startswith("__")}

    def _input_state(self) -> tuple:
        """Names, sizes and times of the driver tables' files: stages built from
        other files than these are stale."""
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.sf_dir)
        listed = target.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(target)
        return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))

    def materialize(self, out_dir: str | None = None) -> str:
        """Write every logistics view as a Parquet table and read them back from there.

        This is the production shape: facts are stored once, queries scan them
        with column pruning and pushed filters. Documents are partitioned by
        type; facts are range-clustered (by date for shipments and invoices,
        by shipment key for charges and events).
        """
        out = out_dir or shared_path(self.spark, "warehouse", uuid.uuid4().hex)
        # date-ranged facts are clustered by their date so row-group min/max stats
        # skip most files for period questions; the rest by their join key
        cluster = {"shipments": "booking_date", "shipment_charges": "shipment_id",
                   "tracking_events": "shipment_id", "invoices": "invoice_date", "customers": "id",
                   "carriers": "id"}
        for name in self._views:
            if name.startswith(("ship_", "doc_")):
                continue
            path = os.path.join(out, name)
            df = self._frames[name]
            if name in cluster:
                df = df.repartitionByRange(cluster[name]).sortWithinPartitions(cluster[name])
            # Counted while it is written, in the writing stage itself: the profile needs no scan of its own.
            seen = Observation(f"profile-{name}")
            df = df.observe(seen, F.count(F.lit(1)).alias("row_count"), *[F.count_if(F.col(c).isNull()).alias(f"null:{c}") for c in df.columns])
            # point lookups by a key that the table isn't sorted by skip row groups by its Bloom filter
            writer = (indexed_writer(df, POINT_KEYS[name]) if name in POINT_KEYS else df.write).mode("overwrite")
            if name == "extracted_documents":
                writer = writer.partitionBy("document_type")
            writer.parquet(path)
            self._frames[name] = self.spark.read.parquet(path)
            self._keep_profile(name, path, seen.get)
            self._frames[name].createOrReplaceTempView(name)
        self.materialized_at = out
        return out

    def _keep_profile(self, name: str, path: str, seen: dict) -> None:
        """A table's row and null counts, in memory and as one JSON row beside it."""
        nulls = {c.removeprefix("null:"): n for c, n in seen.items() if c != "row_count"}
        self.profiles[name] = (seen["row_count"], nulls)
        row = self.spark.createDataFrame([(name, seen["row_count"], nulls)], "table_name string, row_count bigint, nulls map<string,bigint>")
        row.coalesce(1).write.mode("overwrite").json(os.path.join(path, "_profile"))

    def stored(self, name: str) -> DataFrame:
        """A view materialised as a table, for inputs that are tables in production."""
        if self.materialized_at:
            return self._frames[name]
        key = f"__stored_{name}"
        df = self._frames.get(key)
        if df is None:
            df = self._written(self._frames[name], name)
            self._frames[key] = df
        return df

    @cached_property
    def _views(self) -> dict[str, str]:
        return view_sql("spark")

    def __getattr__(self, name: str) -> DataFrame:
        frames = self.__dict__.get("_frames", {})
        if name in MATERIALISED and name in frames:
            return self.stored(name)
        if name in frames:
            return frames[name]
        raise AttributeError(name)

    def table(self, name: str) -> DataFrame:
        return self._frames[name]
