"""Document store appends (A10) and upload screening."""

import os
import uuid

import pytest

from tidewater.operators import documents as D
from tidewater.session import shared_path
from tidewater.sources import documents as SD
from tidewater.sources.store import DocumentStore


def test_append_is_idempotent(spark):
    path = shared_path(spark, "test_store", uuid.uuid4().hex)
    docs = spark.createDataFrame([("D1", "invoice", "{}"), ("D2", "bill_of_lading", "{}")],
                                 "document_id string, document_type string, extracted_fields string")
    assert SD.append_documents(spark, docs, path).count() == 0
    dupes = SD.append_documents(spark, docs, path)
    assert sorted(r[0] for r in dupes.collect()) == ["D1", "D2"]
    stored = spark.read.parquet(path)
    assert stored.count() == 2 and {r["review_status"] for r in stored.collect()} == {"pending"}
    assert SD.get_document(stored, "D9").count() == 0


def test_upload_screening(spark):
    folder = shared_path(spark, "uploads", uuid.uuid4().hex)
    os.makedirs(folder)
    for name, size in [("a.pdf", 10), ("b.PNG", 10), ("c.txt", 10), ("big.jpg", 10 * 1024 * 1024 + 1)]:
        with open(os.path.join(folder, name), "wb") as fh:
            fh.write(b"x" * size)
    out = {r["file_name"]: (r["accepted"], r["reason"]) for r in SD.screen_uploads(spark, folder + "/*").collect()}
    assert out["a.pdf"] == (True, None) and out["b.PNG"] == (True, None)
    assert out["c.txt"] == (False, "Unsupported file type: .txt")
    assert out["big.jpg"] == (False, "File too large (max 10 MB)")


def scan_metrics(df):
    """(files, rows) that the scans of a plan read when it runs."""
    df.collect()
    found, todo = {"numFiles": 0, "numOutputRows": 0}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if "FileSourceScanExec" in node.getClass().getSimpleName():
            for key in found:
                found[key] += node.metrics().apply(key).value()
        children = node.children()
        todo.extend(children.apply(i) for i in range(children.size()))
        if hasattr(node, "plan") and "QueryStage" in node.getClass().getSimpleName():
            todo.append(node.plan())
    return found["numFiles"], found["numOutputRows"]


def documents(spark, ids, status="pending"):
    rows = [(i, "invoice", "{}", status, None) for i in ids]
    return spark.createDataFrame(rows, "document_id string, document_type string, extracted_fields string, review_status string, linked_shipment_id string")


def folder_files(path):
    return {os.path.join(f, n) for f, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_point_lookup_opens_one_bucket_and_skips_row_groups(spark):
    path = shared_path(spark, "test_store", uuid.uuid4().hex)
    store = DocumentStore(spark, path, buckets=8)
    store.append(documents(spark, [f"D{i:06d}" for i in range(0, 40_000, 2)]))
    assert store.get("D000400").count() == 1
    files, rows = scan_metrics(store.get("D000400"))
    assert files == 1 and 0 < rows < 20_000 / 4
    # An absent id between the stored ones: its bucket's Bloom filter denies it, no row group is read.
    assert sum(scan_metrics(store.get(f"D{i:06d}"))[1] > 0 for i in range(10_001, 10_041, 2)) <= 2
    assert DocumentStore(spark, path).buckets == 8
    assert DocumentStore(spark, shared_path(spark, "test_store", uuid.uuid4().hex)).get("x") is None


def test_append_reads_only_touched_buckets(spark):
    store = DocumentStore(spark, shared_path(spark, "test_store", uuid.uuid4().hex), buckets=8)
    store.append(documents(spark, [f"D{i}" for i in range(1000)]))
    new = documents(spark, ["D7", "D7", "new"])
    touched = store._touched(new)
    assert len(touched) <= 2
    assert scan_metrics(store.read(touched).select("document_id"))[0] == len(touched)
    assert sorted(r[0] for r in store.append(new).collect()) == ["D7", "D7"]
    assert store.read().count() == 1001 and store.append(documents(spark, [])).count() == 0


def test_merges_rewrite_touched_buckets_and_return_unknown_ids(spark):
    path = shared_path(spark, "test_store", uuid.uuid4().hex)
    store = DocumentStore(spark, path, buckets=8)
    store.append(documents(spark, [f"D{i}" for i in range(500)]))
    store.append(documents(spark, [f"E{i}" for i in range(500)]))
    before = set(store._folders())
    log = spark.createDataFrame([("D1", "approved", None, 1), ("D1", "corrected", "{1}", 2), ("X", "approved", None, 1)],
                                "document_id string, review_status string, corrected_fields string, reviewed_at int")
    unknown = store.merge(log, D.latest_review)
    assert [r[0] for r in unknown.collect()] == ["X"]
    row = store.get("D1").first()
    assert (row.review_status, row.extracted_fields) == ("corrected", "{1}")
    assert store.read().count() == store.read().select("document_id").distinct().count() == 1000
    touched = store._touched(log)
    kept = {f for f in before if int(f.rsplit("=", 1)[1]) not in touched}
    assert len(touched) <= 2 and kept == {f for f in store._folders() if "write=2" not in f} and len(kept) >= 12
    links = spark.createDataFrame([("E5", "S1", 1), ("E5", "S2", 2), ("Y", "S1", 1)], "document_id string, shipment_id string, linked_at int")
    assert [r[0] for r in store.merge(links, D.manual_links).collect()] == ["Y"]
    assert store.get("E5").first().linked_shipment_id == "S2" and store.get("D1").first().review_status == "corrected"


def test_a_write_that_was_lost_is_not_seen_and_is_written_over(spark, monkeypatch):
    store = DocumentStore(spark, shared_path(spark, "test_store", uuid.uuid4().hex), buckets=4)
    store.append(documents(spark, ["A", "B"]))
    monkeypatch.setattr(DocumentStore, "_written", lambda self, n: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        store.append(documents(spark, ["C", "D", "E", "F", "G"]))
    monkeypatch.undo()
    assert {r.document_id for r in store.read().collect()} == {"A", "B"}
    assert store.append(documents(spark, ["C", "A"])).first()[0] == "A"
    assert {r.document_id for r in store.read().collect()} == {"A", "B", "C"}
