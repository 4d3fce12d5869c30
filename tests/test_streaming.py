"""M1 restarts: the same checkpoint writes nothing new; a replay from scratch duplicates nothing."""

import os
import time
import uuid
from types import SimpleNamespace

import pytest

from pyspark.sql import functions as F

from tidewater.session import shared_path
from tidewater.streaming import ingest as ingest_module
from tidewater.streaming.ingest import RAW_SCHEMA, run_ingest


def test_restart_and_replay_are_idempotent(spark, wh):
    run = shared_path(spark, "test_stream", uuid.uuid4().hex)
    landing, out = os.path.join(run, "landing"), os.path.join(run, "out")
    raw = wh.raw_responses.select(*[c.split()[0] for c in RAW_SCHEMA.split(", ")])
    raw.filter(F.col("document_type") == "invoice").write.parquet(os.path.join(landing, "a=1"))
    raw.filter(F.col("document_type") != "invoice").write.parquet(os.path.join(landing, "a=2"))
    ckpt = os.path.join(run, "ckpt")

    docs_path, registry_path = run_ingest(spark, os.path.join(landing, "*"), out, wh.shipments, wh.invoices,
                                          checkpoint_dir=ckpt)
    first = spark.read.parquet(docs_path).count()
    fields = spark.read.parquet(registry_path).count()
    assert first > 0 and fields > 0

    run_ingest(spark, os.path.join(landing, "*"), out, wh.shipments, wh.invoices, checkpoint_dir=ckpt)
    assert spark.read.parquet(docs_path).count() == first          # restart: nothing new

    run_ingest(spark, os.path.join(landing, "*"), out, wh.shipments, wh.invoices,
               checkpoint_dir=os.path.join(run, "ckpt2"))
    docs = spark.read.parquet(docs_path)
    assert docs.count() == first                                      # full replay: no duplicates
    assert docs.select("document_id").distinct().count() == first
    assert spark.read.parquet(registry_path).count() == fields       # registry grows only with new names


def _raw(spark, rows):
    body = '{{"fields": {{"{0}": "x"}}, "confidence_scores": {{"{0}": 0.9}}, "document_type": "invoice"}}'
    return spark.createDataFrame([(i, f"{i}.pdf", "invoice", "m", body.format(f)) for i, f in rows], RAW_SCHEMA)


def _land(df, landing, name):
    df.coalesce(1).write.parquet(os.path.join(landing, name))
    time.sleep(0.05)  # files arrive in the order of their times


def test_first_arrival_stays_across_batches_and_names_register_once(spark, wh):
    run = shared_path(spark, "test_stream", uuid.uuid4().hex)
    landing, out = os.path.join(run, "landing dir"), os.path.join(run, "out")
    ingest = lambda: run_ingest(spark, os.path.join(landing, "*"), out, wh.shipments, wh.invoices, files_per_trigger=1)
    _land(_raw(spark, [("a", "alpha"), ("b", "beta"), ("a", "second_row"), (None, "nameless")]), landing, "n=1")
    _land(_raw(spark, [("a", "later"), ("c", "alpha"), (None, "again")]), landing, "n=2")
    docs_path, registry_path = ingest()
    read = lambda: {r.document_id: r.extracted_fields for r in spark.read.parquet(docs_path).collect()}
    assert read() == {"a": '{"alpha":"x"}', "b": '{"beta":"x"}', "c": '{"alpha":"x"}', None: '{"nameless":"x"}'}
    assert spark.read.parquet(docs_path).count() == 4
    _land(_raw(spark, [("b", "later"), ("d", "delta")]), landing, "n=3")  # a later run of the same checkpoint
    ingest()
    assert read()["b"] == '{"beta":"x"}' and set(read()) == {"a", "b", "c", "d", None}
    names = [r.field_name for r in spark.read.parquet(registry_path).collect()]
    assert sorted(names) == ["alpha", "beta", "delta", "nameless"]


def test_a_crash_after_the_write_is_replayed_into_the_same_epoch(spark, wh, monkeypatch):
    run = shared_path(spark, "test_stream", uuid.uuid4().hex)
    landing, out = os.path.join(run, "landing"), os.path.join(run, "out")
    ingest = lambda: run_ingest(spark, os.path.join(landing, "*"), out, wh.shipments, wh.invoices, files_per_trigger=1)
    for n in range(3):
        _land(_raw(spark, [(f"{n}-{i}", f"f{n}") for i in range(5)] + [("0-0", "late")]), landing, f"n={n}")
    real = ingest_module.document_writer

    def crashing(index, table):
        write = real(index, table)

        def write_epoch(batch, epoch):
            write(batch, epoch)
            if epoch == 1:
                raise RuntimeError("lost after the write")

        return write_epoch

    monkeypatch.setattr(ingest_module, "document_writer", crashing)
    with pytest.raises(Exception, match="lost after the write"):
        ingest()
    monkeypatch.setattr(ingest_module, "document_writer", real)
    docs_path, registry_path = ingest()
    docs = spark.read.parquet(docs_path)
    assert docs.count() == docs.select("document_id").distinct().count() == 15
    assert {r.epoch for r in docs.select("epoch").distinct().collect()} == {0, 1, 2}
    assert sorted(r.field_name for r in spark.read.parquet(registry_path).collect()) == ["f0", "f1", "f2"]


def test_stored_documents_are_not_read_again(spark, wh):
    """What is stored is unreadable, and a later run of the same checkpoint doesn't mind."""
    run = shared_path(spark, "test_stream", uuid.uuid4().hex)
    landing, out = os.path.join(run, "landing"), os.path.join(run, "out")
    _land(_raw(spark, [("a", "alpha")]), landing, "n=1")
    docs_path, _ = run_ingest(spark, os.path.join(landing, "*"), out, wh.shipments, wh.invoices)
    for folder, _, files in os.walk(docs_path):
        for name in files:
            if name.endswith(".parquet"):
                with open(os.path.join(folder, name), "wb") as fh:
                    fh.write(b"not parquet")
    _land(_raw(spark, [("a", "later"), ("b", "beta")]), landing, "n=2")
    run_ingest(spark, os.path.join(landing, "*"), out, wh.shipments, wh.invoices)
    assert [r.document_id for r in spark.read.parquet(os.path.join(docs_path, "writer=*", "epoch=1")).collect()] == ["b"]


def test_an_arrival_of_many_files_is_one_micro_batch(spark, wh, monkeypatch):
    """However many partitions the responses have, the four arrivals are four epochs and the replayed one adds none."""
    many = SimpleNamespace(spark=spark, raw_responses=wh.raw_responses.repartition(6), shipments=wh.shipments, invoices=wh.invoices)
    monkeypatch.setattr(ingest_module, "LANDED_ROWS", 5)  # several files an arrival
    docs = spark.read.parquet(ingest_module.ingest_from_warehouse(many)[0])
    dealt = docs.select("epoch", (F.crc32(F.col("document_id").cast("binary")) % 4).alias("arrival")).distinct().collect()
    assert sorted((r.epoch, r.arrival) for r in dealt) == [(0, 0), (1, 1), (2, 2), (3, 3)]
    assert docs.count() == docs.select("document_id").distinct().count() > 0
