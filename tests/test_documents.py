"""Hand-made rows for the document rules (I1-I17), expectations from the rules."""

import json
import time

import pytest
from pyspark.sql import functions as F

from tidewater.functions import clean_reference, float_text
from tidewater.operators import documents as D


def _resp(fields, scores, doc_type="invoice", notes=""):
    return json.dumps({"fields": fields, "confidence_scores": scores, "document_type": doc_type, "notes": notes})


def _run(spark, rows):
    raw = spark.createDataFrame(rows, "document_id string, file_name string, document_type string, "
                                      "model string, response_text string")
    parsed = D.parse_responses(raw).cache()
    scored = D.score_documents(parsed)
    _run.last = scored
    return {r["document_id"]: r for r in scored.collect()}, \
        {r["document_id"]: r["parse_error"] for r in parsed.collect()}


def test_unwrap_and_structure(spark):
    good = _resp({"a": "x"}, {"a": 0.9})
    rows = [
        ("plain", "f", "invoice", "m", good),
        ("fenced", "f", "invoice", "m", "```json\n" + good + "\n```"),
        ("prose", "f", "invoice", "m", "Here it is:\n" + good + "\nthanks"),
        ("broken", "f", "invoice", "m", good[:20]),
        ("array", "f", "invoice", "m", "[1, 2]"),
        ("nofields", "f", "invoice", "m", json.dumps({"confidence_scores": {}})),
        ("badfields", "f", "invoice", "m", json.dumps({"fields": [1], "confidence_scores": {}})),
        ("noconf", "f", "invoice", "m", json.dumps({"fields": {"a": 1}})),
        ("empty", "f", "invoice", "m", json.dumps({"fields": {}, "confidence_scores": {}})),
        ("blank", "f", "invoice", "m", "   "),
    ]
    _, errs = _run(spark, rows)
    assert errs["plain"] is None and errs["fenced"] is None and errs["prose"] is None
    assert errs["broken"].startswith("Invalid JSON") and errs["blank"].startswith("Invalid JSON")
    assert errs["array"] == "Expected JSON object, got list"
    assert errs["nofields"] == "Missing required key 'fields' in response JSON"
    assert errs["badfields"] == "'fields' must be a dict, got list"
    assert errs["noconf"] == "Missing required key 'confidence_scores' in response JSON"
    assert errs["empty"].startswith("'fields' is empty")


def test_confidence_coercion_and_flags(spark):
    fields = {k: "v" for k in ["f1", "f2", "f3", "f4", "f5", "f6", "f7", "f8", "f9", "f10"]}
    scores = {"f1": 1.5, "f2": [0.8, 0.6], "f3": {"value": 0.55}, "f4": "0.65", "f5": None,
              "f6": {"score": 0.33}, "f7": ["n/a", 0.9], "f8": 0.7, "f9": 0.4, "f10": -0.2}
    docs, _ = _run(spark, [("d", "f", "other", "m", _resp(fields, scores))])
    conf = {f["field"]: f["confidence"] for f in docs["d"]["fields"]}
    assert conf["f1"] == 1.0 and conf["f10"] == 0.0
    assert conf["f2"] == pytest.approx(0.7) and conf["f3"] == 0.55 and conf["f4"] == 0.65
    assert conf["f5"] == 0.5 and conf["f6"] == 0.33 and conf["f7"] == 0.5
    review = {f["field"]: f["needs_review"] for f in docs["d"]["fields"]}
    assert review["f8"] is False and review["f9"] is True  # strict < 0.7
    assert docs["d"]["very_low_fields"] == "f6, f10"  # 0.4 is not below 0.4; field order kept
    assert [f["field"] for f in docs["d"]["fields"]] == list(fields)


def test_missing_score_defaults_and_overall(spark):
    docs, _ = _run(spark, [("d", "f", "other", "m", _resp({"a": 1, "b": 2}, {"a": 0.9}))])
    assert docs["d"]["overall_confidence"] == pytest.approx(0.7)


def test_unrecognizable_note(spark):
    docs, _ = _run(spark, [("d", "f", "other", "m", _resp({"a": 1}, {"a": 0.1}, notes="blurry"))])
    assert docs["d"]["notes"].startswith("WARNING: Very low overall confidence (0.10). Document may be "
                                         "unrecognizable. blurry")


def test_invoice_rules(spark):
    inv = {"subtotal": 1000, "tax_amount": 50, "total_amount": 900}
    docs, _ = _run(spark, [("d", "f", "invoice", "m", _resp(inv, {k: 0.9 for k in inv})),
                           ("c", "f", "invoice", "m", _resp({"subtotal": 1000, "total_amount": "5,280.00"},
                                                            {"subtotal": 0.9, "total_amount": 0.9}))])
    w = docs["d"]["warnings"]
    assert w[0] == "Inconsistency: total_amount (900.0) is less than subtotal (1000.0)."
    assert w[1] == "Inconsistency: subtotal (1000.0) + tax (50.0) = 1050.0, but total_amount is 900.0."
    assert docs["c"]["warnings"] == []  # comma text skips the plain float check


def test_other_type_rules(spark):
    bol = {"port_of_loading": "Port A", "port_of_discharge": " port a "}
    pl = {"total_gross_weight": "12,500.5 kg", "total_net_weight": "13,100 kg", "total_packages": "0"}
    cd = {"declared_value": "$0", "country_of_origin": "India", "importer_name": "India Imports Ltd"}
    docs, _ = _run(spark, [
        ("b", "f", "bill_of_lading", "m", _resp(bol, {})),
        ("p", "f", "packing_list", "m", _resp(pl, {})),
        ("c", "f", "customs_declaration", "m", _resp(cd, {}))])
    assert docs["b"]["warnings"] == ["Inconsistency: port_of_loading and port_of_discharge are the same."]
    assert docs["p"]["warnings"] == ["Inconsistency: net weight (13100.0) exceeds gross weight (12500.5).",
                                     "Inconsistency: total_packages should be positive."]
    assert docs["c"]["warnings"] == ["Inconsistency: declared_value should be positive.",
                                     "Possible inconsistency: importer appears to be in the same country as origin."]


def test_completeness_and_notes(spark):
    fields = {"packing_list_number": "PL-1", "date": "", "shipper": None}
    docs, _ = _run(spark, [("p", "f", "packing_list", "m", _resp(fields, {"packing_list_number": 0.3}))])
    assert docs["p"]["missing_fields"] == ["date", "shipper", "consignee", "items", "total_packages",
                                           "total_gross_weight", "total_net_weight", "total_volume"]
    parts = docs["p"]["notes"].split(" | ")
    assert parts[0] == "Very low confidence fields (below 0.4): packing_list_number"
    assert parts[-1].startswith("Missing expected fields: date, shipper")


def test_auto_link_priority(spark):
    ships = spark.createDataFrame([(1, "SHP-1", "PO-A"), (2, "SHP-2", "PO-A"), (3, "SHP-3", "PO-B")],
                                  "id long, shipment_id string, po_number string")
    invs = spark.createDataFrame([("INV-3", 3)], "invoice_number string, shipment_id long")
    rows = [
        ("ref", "f", "invoice", "m", _resp({"shipment_ref": " SHP-2 ", "po_number": "PO-B"}, {})),
        ("po", "f", "invoice", "m", _resp({"po_number": "PO-A"}, {})),
        ("inv", "f", "invoice", "m", _resp({"invoice_number": "INV-3"}, {})),
        ("num", "f", "invoice", "m", _resp({"shipment_id": 2}, {})),
        ("miss", "f", "invoice", "m", _resp({"shipment_ref": "SHP-9", "po_number": "PO-B"}, {})),
    ]
    _run(spark, rows)
    out = {r["document_id"]: r["linked_shipment_id"]
           for r in D.auto_link(_run.last, ships, invs).collect()}
    assert out == {"ref": "SHP-2", "po": "SHP-1", "inv": "SHP-3", "num": None, "miss": "SHP-3"}


def test_lenient_check(spark):
    raw = spark.createDataFrame([
        ("a", "```json\n" + _resp({"a": 1}, {"a": 1.5}) + "\n```"),
        ("b", json.dumps({"fields": {}, "confidence_scores": {}})),
        ("c", ""),
    ], "document_id string, response_text string")
    out = {r["document_id"]: (r["passed"], r["reason"]) for r in D.lenient_check(raw).collect()}
    assert out["a"] == (True, None)
    assert out["b"] == (False, "Missing required key: 'document_type'")
    assert out["c"] == (False, "Empty response from vision model.")


def test_duplicate_keys_follow_python_dict(spark):
    text = '{"fields": {"a": "1", "b": "2", "a": "3"}, "confidence_scores": {"a": 0.9, "a": 0.2}, "document_type": "x"}'
    docs, errs = _run(spark, [("d", "f", "other", "m", text)])
    assert errs["d"] is None
    f = docs["d"]["fields"]
    assert [x["field"] for x in f] == ["a", "b"]
    assert f[0]["value"] == "3" and f[0]["confidence"] == 0.2


def test_lenient_check_clamps_scores(spark):
    text = '{"fields": {"a": 1}, "confidence_scores": {"a": 1.7, "b": -2, "c": true, "d": "x", "e": 0.25}, "document_type": "invoice"}'
    raw = spark.createDataFrame([("d1", text), ("d2", text + " done"), ("d3", None)], "document_id string, response_text string")
    out = {r["document_id"]: r for r in D.lenient_check(raw).collect()}
    assert out["d1"]["clamped_scores"] == {"a": 1.0, "b": 0.0, "c": 1.0, "e": 0.25}
    cleaned = json.loads(out["d1"]["cleaned"])
    assert cleaned["confidence_scores"] == {"a": 1.0, "b": 0.0, "c": 1.0, "d": "x", "e": 0.25} and cleaned["fields"] == {"a": 1}
    assert (out["d2"]["passed"], out["d2"]["reason"]) == (False, "Invalid JSON")
    assert out["d3"]["reason"] == "Empty response from vision model."


def test_float_text_is_plain(spark):
    values = [12500000.0, 1.25, 1e16, 0.0001, 0.00001, -3e7, 123456789.125, 0.0, 5.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x double")
    got = [r["t"] for r in df.select("i", float_text("x").alias("t")).orderBy("i").collect()]
    assert got == [str(x) for x in values]


def test_references_lose_all_white_space_at_their_ends(spark):
    rows = [("  PO-1 ",), ("\t\nPO 2\r\x0b\x0c",), ("  PO-3　",), ("\x1cPO-4\x1f",), ("   ",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(clean_reference("x")).collect()]
    assert got == [None if x is None else x.strip() or None for x, in rows]


def test_fields_of_wide_documents_keep_order_and_take_linear_time(spark):
    def doc(n):
        names = [f"f{(i * 7919) % n}" for i in range(n)]
        fields = ", ".join(f'"{k}": {i}' for i, k in enumerate(names)) + ', "f1": "last"'
        scores = ", ".join(f'"{k}": 0.{1 + i % 9}' for i, k in enumerate(reversed(names)) if i % 3) + ', "other": 1, "f2": 0.25'
        return names, "{" + fields + "}", "{" + scores + "}"

    took = {}
    for n in (1000, 10_000):
        names, fields, scores = doc(n)
        df = spark.createDataFrame([(f"d{i}", fields, scores) for i in range(4)], "document_id string, f string, c string").repartition(1).cache()
        df.count()
        out = D.with_field_array(df, "f", "c").select("document_id", F.explode("fields").alias("x")).select("document_id", "x.*")
        out.write.format("noop").mode("overwrite").save()
        start = time.monotonic()
        out.write.format("noop").mode("overwrite").save()
        took[n] = time.monotonic() - start
        want_score = json.loads(scores)
        got = out.where("document_id = 'd0'").orderBy("pos").collect()
        assert [r.field for r in got] == names and [r.pos for r in got] == list(range(1, n + 1))
        assert {r.field: r.confidence for r in got} == {k: want_score.get(k, 0.5) for k in names}
        assert {r.field: r.value for r in got}["f1"] == "last"
    assert took[10_000] < 40 * took[1000] + 0.5, took
