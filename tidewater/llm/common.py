"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.session import shared_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
#: The white space of every word contract: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there,
    so a lost executor costs a re-read and no recomputation."""
    path = shared_path(df.sparkSession, "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def workers_import(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, if
    they can't already (a shared checkout; with --py-files it changes nothing)."""
    environment = spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join([x for x in known if x] + [ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_of(docs: DataFrame) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Maximal runs of characters outside SPACE, in order."""
    return F.array_remove(F.split(text, f"{SPACE}+", -1), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once a row: a lambda variable
    is bound, while a column reference may be inlined into every element."""
    return F.transform(F.array(value), body)[0]


def bounded_sample(rows: DataFrame, group: str, key: str, most: Column) -> DataFrame:
    """At most ``most`` rows (an expression over ``group``) of each group, the
    first by a hash of ``key``. Each group is first thinned by that hash to
    about four times as many, by its counted size, so that what meets in one
    task doesn't grow with the group."""
    unit = F.shiftrightunsigned(F.xxhash64(key), 11) / float(1 << 53)
    sizes = rows.groupBy(group).agg(F.count("*").alias("__size")).withColumnRenamed(group, "__of")
    thin = rows.withColumn("__unit", unit).join(sizes, F.col(group).eqNullSafe(F.col("__of")))
    thin = thin.where(F.col("__unit") * F.col("__size") <= 4 * most + 100)
    order = Window.partitionBy(group).orderBy("__unit", key)
    return thin.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= most).select(*rows.columns)


def record_batches(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into slices of about ``max_bytes`` of ``column``, so
    that Python memory does not follow the number of long texts in a batch."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, size in enumerate(sizes.tolist()):
            if total and total + size > max_bytes:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += size
        if start < batch.num_rows:
            yield batch.slice(start)
