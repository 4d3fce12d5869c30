"""Document tables: normalise, score, validate, link, review.

Input is a table of raw extraction responses
``(document_id, file_name, document_type, model, response_text)``.

Design: every per-document step is row-local. A document stays one row and
its fields live in an ordered array of structs, so parsing, confidence
coercion, review flags, consistency rules, completeness and notes are pure
column expressions (higher-order functions over arrays) with no shuffle.
Only linking to shipments (I16) and review merges (I18/I19) shuffle, and both
join against key-unique sides so no key can fan out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from tidewater.config import EXPECTED_FIELDS, SETTINGS
from tidewater.functions import bound, clamp01, clean_reference, complete_json, float_text, parse_quantity, python_type
from tidewater.session import accept_repeated_keys

NUMERIC_PREFIXES = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")


def _is_numeric(schema: Column) -> Column:
    return schema.rlike("^(" + "|".join(NUMERIC_PREFIXES) + ")")


# ------------------------------------------------------------------ I1 / I2


def _strip(x: Column) -> Column:
    """Python ``str.strip()``: all leading/trailing whitespace, not just spaces."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def unwrap_response(df: DataFrame, text_col: str) -> DataFrame:
    """Strip code fences; parse; else the outermost ``{...}``.

    Adds ``_json`` (the JSON text that parsed) and ``_v`` (its VARIANT); both
    NULL when nothing parses. Lambda variables bind each step once, so no
    parse is repeated.
    """
    def parsed(text: Column) -> Column:
        return F.transform(F.array(text), lambda u: F.struct(u.alias("text"), complete_json(u).alias("v")))[0]

    t = _strip(F.col(text_col))
    fenced = _strip(F.regexp_replace(F.regexp_replace(t, r"^```(?:json|sql)?\s*\n?", ""), r"\n?```\s*$", ""))
    whole = parsed(F.when(t.startswith("```"), fenced).otherwise(t))
    found = F.transform(F.array(whole), lambda d: F.when(d["v"].isNotNull(), d).otherwise(
        parsed(F.regexp_extract(d["text"], r"(?s)\{.*\}", 0))))[0]
    return (df.withColumn("_found", found)
            .withColumn("_v", F.col("_found.v"))
            .withColumn("_json", F.when(F.col("_v").isNotNull(), F.col("_found.text")))
            .drop("_found"))


def structure_reason(v: Column) -> Column:
    """First failed structural rule as the reference's message, NULL when valid."""
    top = F.schema_of_variant(v)
    fields = F.schema_of_variant(F.variant_get(v, "$.fields", "variant"))
    conf = F.schema_of_variant(F.variant_get(v, "$.confidence_scores", "variant"))
    return (
        F.when(v.isNull(), F.lit("Invalid JSON: no parsable object in response"))
        .when(~top.startswith("OBJECT"), F.concat(F.lit("Expected JSON object, got "), python_type(top)))
        .when(fields.isNull(), F.lit("Missing required key 'fields' in response JSON"))
        .when(~fields.startswith("OBJECT"), F.concat(F.lit("'fields' must be a dict, got "), python_type(fields)))
        .when(conf.isNull(), F.lit("Missing required key 'confidence_scores' in response JSON"))
        .when(~conf.startswith("OBJECT"),
              F.concat(F.lit("'confidence_scores' must be a dict, got "), python_type(conf)))
        .when(fields == "OBJECT<>", F.lit("'fields' is empty — no data was extracted from the document"))
    )


def lenient_check(raw: DataFrame) -> DataFrame:
    """The standalone lenient check (fences by line, required keys).

    ``cleaned`` is the JSON of a passing response with its numeric confidence
    scores clamped to 0..1, ``clamped_scores`` those scores by name.
    """
    accept_repeated_keys(raw.sparkSession)
    t = _strip(F.coalesce(F.col("response_text"), F.lit("")))
    lines = F.split(t, "\n")
    body = F.when(t.startswith("```"), F.array_join(
        F.slice(lines, 2, F.greatest(F.size(lines) - 1 - F.when(
            F.trim(F.element_at(lines, -1)) == "```", 1).otherwise(0), F.lit(0))), "\n"))
    staged = raw.select("document_id", t.alias("_t"), complete_json(_strip(F.coalesce(body, t))).alias("_v"))
    v = F.col("_v")
    top = F.schema_of_variant(v)

    def has(key: str) -> Column:
        return F.schema_of_variant(F.variant_get(v, f"$.{key}", "variant")).isNotNull()

    reason = (F.when(F.col("_t") == "", F.lit("Empty response from vision model."))
              .when(v.isNull(), F.lit("Invalid JSON"))
              .when(~top.startswith("OBJECT"), F.lit("Expected a JSON object, got something else.")))
    for key in ("fields", "confidence_scores", "document_type"):
        reason = reason.when(~has(key), F.lit(f"Missing required key: '{key}'"))

    def clamped(x: Column) -> Column:  # a boolean counts as a number, as in Python
        number = F.when(F.schema_of_variant(x) == "BOOLEAN", x.try_cast("boolean").cast("double")).when(
            _is_numeric(F.schema_of_variant(x)), x.try_cast("double"))
        return F.when(number.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))

    scores = F.try_variant_get(v, "$.confidence_scores", "map<string,variant>")
    numbers = F.map_filter(F.transform_values(scores, lambda k, x: F.when(x.isNotNull(), clamped(x))), lambda k, x: x.isNotNull())
    kept = F.transform_values(scores, lambda k, x: F.coalesce(clamped(x).cast("variant"), x))
    whole = F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.when(
        (k == "confidence_scores") & F.col("_scores").isNotNull(), F.to_variant_object(F.col("_scores"))).otherwise(x))
    return (staged.withColumn("reason", reason).withColumn("_scores", kept)
            .select("document_id", F.col("reason").isNull().alias("passed"), "reason",
                    F.when(F.col("reason").isNull(), F.to_json(whole)).alias("cleaned"),
                    F.when(F.col("reason").isNull(), numbers).alias("clamped_scores")))


def parse_responses(raw: DataFrame) -> DataFrame:
    """I1 + I2: one row per response with parse status and the JSON parts."""
    accept_repeated_keys(raw.sparkSession)
    return (unwrap_response(raw, "response_text")
            .withColumn("parse_error", structure_reason(F.col("_v")))
            .select("document_id", "file_name", "document_type", "model", "parse_error",
                    F.get_json_object("_json", "$.fields").alias("fields_json"),
                    F.get_json_object("_json", "$.confidence_scores").alias("confidence_json"),
                    F.coalesce(F.variant_get("_v", "$.notes", "string"), F.lit("")).alias("model_notes")))


# ------------------------------------------------------------------ I4 / I5


def _scalar_conf(x: Column) -> Column:
    """float() of a scalar JSON value: numbers, numeric strings, booleans; else NULL."""
    s = F.schema_of_variant(x)
    as_text = F.variant_get(x, "$", "string")
    return (F.when(_is_numeric(s), F.try_variant_get(x, "$", "double"))
            .when(s == "STRING", F.trim(as_text).try_cast("double"))
            .when(s == "BOOLEAN", F.when(F.try_variant_get(x, "$", "boolean"), 1.0).otherwise(0.0)))


def coerce_confidence(c: Column, s: Column | None = None) -> tuple[Column, Column]:
    """Model confidence of any JSON shape -> ``(confidence in [0,1], problem)``.

    Missing or null -> 0.5; list -> mean of its numeric items; object ->
    ``value``, then ``score``, then 0.5; string -> parsed; unparsable -> 0.5.
    A list with non-numeric text gives 0.5 and a problem note instead of
    failing the document. ``s`` is the value's variant schema, if already known.
    """
    s = F.schema_of_variant(c) if s is None else s
    items = F.try_variant_get(c, "$", "array<variant>")
    scalars = F.filter(items, lambda e: _is_numeric(F.schema_of_variant(e))
                       | F.schema_of_variant(e).isin("STRING", "BOOLEAN"))
    nums = F.transform(scalars, _scalar_conf)
    bad_list = F.exists(nums, lambda x: x.isNull())
    list_mean = F.when(F.size(nums) > 0,
                       F.aggregate(nums, F.lit(0.0), lambda acc, x: acc + x) / F.size(nums)).otherwise(0.5)
    has_value = F.schema_of_variant(F.variant_get(c, "$.value", "variant")).isNotNull()
    has_score = F.schema_of_variant(F.variant_get(c, "$.score", "variant")).isNotNull()
    from_obj = (F.when(has_value, _scalar_conf(F.variant_get(c, "$.value", "variant")))
                .when(has_score, _scalar_conf(F.variant_get(c, "$.score", "variant")))
                .otherwise(0.5))
    raw = (F.when(_is_numeric(s), F.try_variant_get(c, "$", "double"))
           .when(c.isNull() | (s == "VOID"), 0.5)
           .when(s.startswith("ARRAY"), F.when(bad_list, 0.5).otherwise(list_mean))
           .when(s.startswith("OBJECT"), from_obj)
           .otherwise(_scalar_conf(c)))
    conf = clamp01(F.coalesce(raw, F.lit(0.5)))
    problem = F.when(s.startswith("ARRAY") & bad_list, F.lit("non-numeric confidence list"))
    return conf, problem


def _paired(m: Column) -> Column:
    """Fields in document order with their text, value and confidence, from a
    struct (names, texts, values, scored, scores): the names of both JSON
    objects are sorted together, so a field stands next to its score. A
    repeated field has the position of its first entry and the value of its
    last one, as in a Python dict. n log n in the fields of a document."""
    marks = F.array_sort(F.concat(
        F.transform(m["names"], lambda k, i: F.struct(k.alias("k"), F.lit(0).alias("side"), i.alias("i"))),
        F.transform(m["scored"], lambda k, i: F.struct(k.alias("k"), F.lit(1).alias("side"), i.alias("i")))))

    def placed(x: Column) -> Column:
        def same(j: Column, e: Column) -> Column:
            return F.coalesce(F.get(x, j)["k"] == e["k"], F.lit(False))

        first = F.transform(x, lambda e, j: F.when((e["side"] == 0) & ~same(j - 1, e), e["i"]))
        last = F.transform(x, lambda e, j: F.when(
            (e["side"] == 0) & ~(same(j + 1, e) & (F.get(x, j + 1)["side"] == 0)),
            F.struct(e["i"].alias("last"), F.when(same(j + 1, e), F.get(x, j + 1)["i"]).alias("score"))))
        known = lambda e: e.isNotNull()
        return F.array_sort(F.zip_with(F.filter(first, known), F.filter(last, known), lambda f, e: F.struct(
            f.alias("first"), e["last"].alias("last"), e["score"].alias("score"))))

    def entry(e: Column, place: Column) -> Column:
        value, score = F.get(m["values"], e["last"]), F.get(m["scores"], e["score"])
        return F.struct((place + 1).alias("pos"), F.get(m["names"], e["last"]).alias("field"), F.get(m["texts"], e["last"]).alias("value"),
                        F.schema_of_variant(value).alias("value_type"), score.alias("c"), F.schema_of_variant(score).alias("ctype"))

    return F.transform(bound(marks, placed), entry)


def with_field_array(df: DataFrame, fields_json: str, confidence_json: str) -> DataFrame:
    """I4 + I5 + I8: ordered ``fields`` = array<struct<pos, field, value, value_type,
    confidence, needs_review, problem>>, plus ``fmap`` (field -> struct) for lookups.

    Each JSON object is parsed once into a map, whose keys and values are
    bound as arrays; a field finds its entries by place, not by search.
    """
    texts, values = F.from_json(fields_json, "map<string,string>"), F.from_json(fields_json, "map<string,variant>")
    scores = F.try_variant_get(F.try_parse_json(confidence_json), "$", "map<string,variant>")  # a repeated key: the last
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    parts = bound(F.struct(texts.alias("t"), values.alias("v"), F.coalesce(scores, none).alias("c")), lambda p: F.struct(
        F.map_keys(p["t"]).alias("names"), F.map_values(p["t"]).alias("texts"), F.map_values(p["v"]).alias("values"),
        F.map_keys(p["c"]).alias("scored"), F.map_values(p["c"]).alias("scores")))

    def score(r: Column) -> Column:
        conf, problem = coerce_confidence(r["c"], r["ctype"])
        return F.struct(r["pos"].alias("pos"), r["field"].alias("field"), r["value"].alias("value"),
                        r["value_type"].alias("value_type"), conf.alias("confidence"),
                        problem.alias("problem"))

    return (df.withColumn("_scored", F.transform(bound(parts, _paired), score))
            .withColumn("fields", F.transform("_scored", lambda f: f.withField(
                "needs_review", f["confidence"] < SETTINGS.confidence_threshold)))
            .withColumn("fmap", F.map_from_arrays(F.transform("fields", lambda f: f["field"]), F.col("fields")))
            .drop("_scored"))


def long_fields(docs: DataFrame) -> DataFrame:
    """I4: one row per (document, field) in document order."""
    return (docs.select("document_id", F.explode("fields").alias("f"))
            .select("document_id", "f.pos", "f.field", "f.value", "f.confidence", "f.needs_review"))


# ------------------------------------------------------------------ rules


def _value(fmap: Column, name: str) -> Column:
    return F.try_element_at(fmap, F.lit(name))


def _truthy(f: Column) -> Column:
    """Python truthiness of a JSON value given as (text, type)."""
    t, v = f["value_type"], f["value"]
    return (f.isNotNull() & v.isNotNull() & (t != "VOID")
            & ~((t == "STRING") & (v == ""))
            & ~(_is_numeric(t) & (v.try_cast("double") == 0))
            & ~t.isin("OBJECT<>", "ARRAY<VOID>") & ~((t == "BOOLEAN") & (v == "false")))


def _plain_float(f: Column) -> Column:
    """float(value): numbers and numeric strings only (no comma handling)."""
    t = f["value_type"]
    return F.when(f.isNotNull() & (_is_numeric(t) | (t == "STRING")), F.trim(f["value"]).try_cast("double"))


def consistency_warnings(document_type: Column, fmap: Column) -> Column:
    """Array of rule messages in the reference's order."""
    sub, tot, tax = (_plain_float(_value(fmap, n)) for n in ("subtotal", "total_amount", "tax_amount"))
    inv_low = F.when(sub.isNotNull() & tot.isNotNull() & (tot < sub * 0.99), F.concat(
        F.lit("Inconsistency: total_amount ("), float_text(tot), F.lit(") is less than subtotal ("),
        float_text(sub), F.lit(").")))
    exp = sub + tax
    inv_gap = F.when(sub.isNotNull() & tot.isNotNull() & tax.isNotNull()
                     & (F.abs(exp - tot) > tot * 0.02 + 0.01), F.concat(
        F.lit("Inconsistency: subtotal ("), float_text(sub), F.lit(") + tax ("), float_text(tax),
        F.lit(") = "), float_text(exp), F.lit(", but total_amount is "), float_text(tot), F.lit(".")))

    pol, pod = _value(fmap, "port_of_loading"), _value(fmap, "port_of_discharge")
    bol_same = F.when(_truthy(pol) & _truthy(pod)
                      & (F.lower(F.trim(pol["value"])) == F.lower(F.trim(pod["value"]))),
                      F.lit("Inconsistency: port_of_loading and port_of_discharge are the same."))

    gross, net, pk = (_value(fmap, n) for n in ("total_gross_weight", "total_net_weight", "total_packages"))
    g, n, p = parse_quantity(gross["value"]), parse_quantity(net["value"]), parse_quantity(pk["value"])
    pl_net = F.when(g.isNotNull() & n.isNotNull() & (n > g), F.concat(
        F.lit("Inconsistency: net weight ("), float_text(n), F.lit(") exceeds gross weight ("),
        float_text(g), F.lit(").")))
    pl_pkg = F.when(p.isNotNull() & (p <= 0), F.lit("Inconsistency: total_packages should be positive."))

    dv = parse_quantity(_value(fmap, "declared_value")["value"], strip_dollar=True)
    origin, importer = _value(fmap, "country_of_origin"), _value(fmap, "importer_name")
    cd_val = F.when(dv.isNotNull() & (dv <= 0), F.lit("Inconsistency: declared_value should be positive."))
    cd_imp = F.when(_truthy(origin) & _truthy(importer)
                    & F.contains(F.lower(importer["value"]), F.lower(origin["value"])),
                    F.lit("Possible inconsistency: importer appears to be in the same country as origin."))

    per_type = (F.when(document_type == "invoice", F.array(inv_low, inv_gap))
                .when(document_type == "bill_of_lading", F.array(bol_same))
                .when(document_type == "packing_list", F.array(pl_net, pl_pkg))
                .when(document_type == "customs_declaration", F.array(cd_val, cd_imp))
                .otherwise(F.array().cast("array<string>")))
    return F.filter(per_type, lambda m: m.isNotNull())


def expected_fields(document_type: Column) -> Column:
    expr = F.when(F.lit(False), F.array().cast("array<string>"))
    for t, names in EXPECTED_FIELDS.items():
        expr = expr.when(document_type == t, F.array(*[F.lit(x) for x in names]))
    return F.coalesce(expr, F.array().cast("array<string>"))


def missing_fields(document_type: Column, fields: Column) -> Column:
    """Expected fields absent, null, or empty string — in expected order."""
    present = F.transform(F.filter(fields, lambda f: F.coalesce(f["value"], F.lit("")) != ""),
                          lambda f: f["field"])
    return F.filter(expected_fields(document_type), lambda e: ~F.array_contains(present, e))


# ------------------------------------------------------------------ pipeline


def score_documents(parsed: DataFrame) -> DataFrame:
    """I4-I9, I10-I15, I17 on parsed responses; failures are kept with their reason."""
    ok = with_field_array(parsed.filter(F.col("parse_error").isNull()), "fields_json", "confidence_json")
    confs = F.transform("fields", lambda f: f["confidence"])
    n = F.size("fields")
    mean = F.when(n > 0, F.aggregate(confs, F.lit(0.0), lambda a, x: a + x) / n).otherwise(0.0)
    low_t = SETTINGS.low_confidence_threshold
    very_low = F.transform(F.filter("fields", lambda f: f["confidence"] < low_t), lambda f: f["field"])
    out = (ok.withColumn("_mean", mean)
           .withColumn("overall_confidence", F.round("_mean", 4))
           .withColumn("prior_notes", F.when(
               (F.col("_mean") < SETTINGS.unrecognizable_threshold) & (n > 0),
               F.concat(F.lit("WARNING: Very low overall confidence ("), F.format_string("%.2f", F.col("_mean")),
                        F.lit("). Document may be unrecognizable. "), F.col("model_notes")))
               .otherwise(F.col("model_notes")))
           .withColumn("very_low_fields", F.array_join(very_low, ", "))
           .withColumn("warnings", consistency_warnings(F.col("document_type"), F.col("fmap")))
           .withColumn("missing_fields", missing_fields(F.col("document_type"), F.col("fields"))))
    parts = F.concat(
        F.when(F.col("prior_notes") != "", F.array("prior_notes")).otherwise(F.array().cast("array<string>")),
        F.when(F.size(very_low) > 0, F.array(F.concat(
            F.lit(f"Very low confidence fields (below {low_t}): "), F.col("very_low_fields"))))
        .otherwise(F.array().cast("array<string>")),
        F.col("warnings"),
        F.when(F.size("missing_fields") > 0, F.array(F.concat(
            F.lit("Missing expected fields: "), F.array_join("missing_fields", ", "))))
        .otherwise(F.array().cast("array<string>")))
    return out.withColumn("notes", F.array_join(parts, " | ")).drop("_mean")


def candidates(fmap: Column) -> Column:
    """Reference values a document offers for linking, with their priority.

    Only JSON strings count (numbers are ignored), trimmed, empty dropped.
    """
    keys = [("shipment_ref", 1, "sid"), ("shipment_reference", 2, "sid"), ("shipment_id", 3, "sid"),
            ("po_number", 4, "po"), ("invoice_number", 5, "inv")]
    return F.filter(F.array(*[
        F.struct(F.lit(p).alias("priority"), F.lit(kind).alias("kind"),
                 F.when(_value(fmap, k)["value_type"] == "STRING",
                        clean_reference(_value(fmap, k)["value"])).alias("ref"))
        for k, p, kind in keys]), lambda c: c["ref"].isNotNull())


def link_candidates(docs: DataFrame, cands: Column | None = None) -> DataFrame:
    """One row per document and candidate; ``cands`` if they are stored already."""
    return (docs.select("document_id", F.explode(candidates(F.col("fmap")) if cands is None else cands).alias("c"))
            .select("document_id", "c.priority", "c.kind", "c.ref"))


def reference_index(shipments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Key-unique lookup ``(kind, ref) -> (sid, shipment_id)``.

    Purchase orders are not unique; each is reduced to its lowest shipment id
    before any join, so a popular PO can never fan out a document.
    """
    s = shipments.select(F.col("id").alias("sid"), "shipment_id", "po_number")
    by_sid = s.select(F.lit("sid").alias("kind"), F.col("shipment_id").alias("ref"), "sid", "shipment_id")
    by_po = (s.filter(F.col("po_number").isNotNull()).groupBy(F.col("po_number").alias("ref"))
             .agg(F.min_by(F.struct("sid", "shipment_id"), "sid").alias("x"))
             .select(F.lit("po").alias("kind"), "ref", "x.sid", "x.shipment_id"))
    by_inv = (invoices.select(F.col("invoice_number").alias("ref"), F.col("shipment_id").alias("sid"))
              .join(s.select("sid", "shipment_id"), "sid")
              .select(F.lit("inv").alias("kind"), "ref", "sid", "shipment_id"))
    return by_sid.unionByName(by_po).unionByName(by_inv)


def auto_link(docs: DataFrame, shipments: DataFrame, invoices: DataFrame) -> DataFrame:
    """I16: first hit by priority wins; ties on one key go to the lowest shipment id."""
    hits = link_candidates(docs).join(reference_index(shipments, invoices), ["kind", "ref"])
    best = hits.groupBy("document_id").agg(
        F.min_by("shipment_id", F.struct("priority", "sid")).alias("linked_shipment_id"),
        F.min("priority").alias("link_priority"))
    return docs.join(best, "document_id", "left")


def process_responses(raw: DataFrame, shipments: DataFrame, invoices: DataFrame) -> DataFrame:
    """Raw responses -> validated, linked document rows (failed parses kept with a reason)."""
    parsed = parse_responses(raw)
    scored = score_documents(parsed)
    linked = auto_link(scored, shipments, invoices)
    return linked


def to_stored(docs: DataFrame, link: str = "linked_shipment_id") -> DataFrame:
    """Shape validated rows like the stored document table (A10); ``link`` is
    the column in the place of the link."""
    conf_map = F.map_from_entries(F.transform("fields", lambda f: F.struct(f["field"], f["confidence"])))
    return docs.select(
        "document_id", "document_type", "file_name", F.col("model").alias("extraction_model"),
        "overall_confidence", F.lit("pending").alias("review_status"),
        F.col("fields_json").alias("extracted_fields"), F.to_json(conf_map).alias("confidence_scores"),
        link, "notes")


# ------------------------------------------------------------------ review log


def latest_review(documents: DataFrame, review_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Review merge, last status and last correction. Returns (merged documents, unknown ids).

    ``review_log``: (document_id, review_status, corrected_fields?, reviewed_at).
    """
    known = documents.select("document_id")
    unknown = review_log.join(known, "document_id", "left_anti").select("document_id").distinct()
    at = F.col("reviewed_at")
    # the last status; the last correction, which a later approval keeps; equal times by value
    last = (review_log.join(known, "document_id", "left_semi").groupBy("document_id").agg(
        F.max_by("review_status", F.struct(at, F.col("review_status"))).alias("new_status"),
        F.max_by("corrected_fields", F.when(F.col("corrected_fields").isNotNull(), F.struct(at, F.col("corrected_fields")))).alias("new_fields"),
        F.max(at).alias("new_reviewed_at")))
    reviewed = F.coalesce("new_reviewed_at", "reviewed_at") if "reviewed_at" in documents.columns else F.col("new_reviewed_at")
    merged = (documents.join(last, "document_id", "left")
              .withColumn("review_status", F.coalesce("new_status", "review_status"))
              .withColumn("extracted_fields", F.coalesce("new_fields", "extracted_fields"))
              .withColumn("reviewed_at", reviewed)
              .drop("new_status", "new_fields", "new_reviewed_at"))
    return merged, unknown


def manual_links(documents: DataFrame, link_log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The latest manual link per document overrides the stored one.
    Returns (merged documents, unknown ids)."""
    known = documents.select("document_id")
    unknown = link_log.join(known, "document_id", "left_anti").select("document_id").distinct()
    # the last link; equal times by shipment
    last = link_log.groupBy("document_id").agg(F.max_by("shipment_id", F.struct("linked_at", "shipment_id")).alias("manual_link"))
    merged = (documents.join(last, "document_id", "left")
              .withColumn("linked_shipment_id", F.coalesce("manual_link", "linked_shipment_id"))
              .drop("manual_link"))
    return merged, unknown


def field_registry(documents: DataFrame) -> DataFrame:
    """Distinct JSON keys over all documents."""
    return (documents.select(F.explode(F.json_object_keys("extracted_fields")).alias("field_name"))
            .distinct())


def confidence_band(x: Column) -> Column:
    """I21."""
    return F.when(x >= 0.8, "high").when(x >= 0.5, "medium").otherwise("low")
