r"""DuckDB SQL for the document jobs, written from the rules, not the Spark code."""

# fixed values, stated here and not imported
EXPECTED_FIELDS = {'invoice': ['invoice_number',
             'invoice_date',
             'vendor_name',
             'buyer_name',
             'total_amount',
             'currency',
             'tax_amount',
             'subtotal',
             'line_items',
             'payment_terms',
             'due_date',
             'po_number',
             'shipment_reference'],
 'bill_of_lading': ['bl_number',
                    'shipper_name',
                    'consignee_name',
                    'notify_party',
                    'vessel_name',
                    'voyage_number',
                    'port_of_loading',
                    'port_of_discharge',
                    'container_numbers',
                    'description_of_goods',
                    'gross_weight',
                    'measurement',
                    'date_of_issue',
                    'number_of_packages'],
 'packing_list': ['packing_list_number',
                  'date',
                  'shipper',
                  'consignee',
                  'items',
                  'total_packages',
                  'total_gross_weight',
                  'total_net_weight',
                  'total_volume'],
 'customs_declaration': ['declaration_number',
                         'date',
                         'importer_name',
                         'exporter_name',
                         'country_of_origin',
                         'hs_code',
                         'description_of_goods',
                         'quantity',
                         'declared_value',
                         'currency',
                         'duty_amount']}

NUM_TYPES = "('UBIGINT', 'BIGINT', 'DOUBLE', 'INTEGER', 'UINTEGER', 'HUGEINT')"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def scalar(x: str) -> str:
    """float() of a scalar JSON value."""
    return (f"(CASE WHEN json_type({x}) IN {NUM_TYPES} THEN CAST(json_extract_string({x}, '$') AS DOUBLE) "
            f"WHEN json_type({x}) = 'VARCHAR' THEN TRY_CAST(trim(json_extract_string({x}, '$')) AS DOUBLE) "
            f"WHEN json_type({x}) = 'BOOLEAN' THEN CASE WHEN json_extract_string({x}, '$') = 'true' "
            f"THEN 1.0 ELSE 0.0 END END)")


def coerce(c: str) -> str:
    items = f"json_extract({c}, '$[*]')"
    scalars = f"list_filter({items}, lambda e: json_type(e) IN {NUM_TYPES} OR json_type(e) IN ('VARCHAR', 'BOOLEAN'))"
    nums = f"list_transform({scalars}, lambda e: {scalar('e')})"
    bad = f"(len(list_filter({nums}, lambda v: v IS NULL)) > 0)"
    mean = (f"(CASE WHEN len({nums}) > 0 THEN list_reduce(list_prepend(CAST(0.0 AS DOUBLE), {nums}), "
            f"lambda a, b: a + b) / len({nums}) ELSE 0.5 END)")
    obj = (f"(CASE WHEN json_type({c}, '$.value') IS NOT NULL THEN {scalar(f'json_extract({c}, {chr(39)}$.value{chr(39)})')} "
           f"WHEN json_type({c}, '$.score') IS NOT NULL THEN {scalar(f'json_extract({c}, {chr(39)}$.score{chr(39)})')} "
           f"ELSE 0.5 END)")
    raw = (f"(CASE WHEN {c} IS NULL OR json_type({c}) = 'NULL' THEN 0.5 "
           f"WHEN json_type({c}) = 'ARRAY' THEN CASE WHEN {bad} THEN 0.5 ELSE {mean} END "
           f"WHEN json_type({c}) = 'OBJECT' THEN {obj} ELSE {scalar(c)} END)")
    return f"greatest(0.0, least(1.0, coalesce({raw}, 0.5)))"


def pytype(t: str) -> str:
    return (f"(CASE WHEN {t} = 'OBJECT' THEN 'dict' WHEN {t} = 'ARRAY' THEN 'list' WHEN {t} = 'VARCHAR' THEN 'str' "
            f"WHEN {t} = 'BOOLEAN' THEN 'bool' WHEN {t} IN ('UBIGINT', 'BIGINT') THEN 'int' "
            f"WHEN {t} = 'NULL' THEN 'NoneType' ELSE 'float' END)")


UNFENCE = (rf"CASE WHEN starts_with(t, '```') THEN "
           + strip(r"regexp_replace(regexp_replace(t, '^```(?:json|sql)?\s*\n?', ''), '\n?```\s*$', '')")
           + " ELSE t END")

PARSED = rf"""
r0 AS (SELECT document_id, document_type, {strip('response_text')} AS t FROM raw_responses),
r1 AS (SELECT document_id, document_type, {UNFENCE} AS u FROM r0),
r2 AS (SELECT document_id, document_type,
              CASE WHEN json_valid(u) THEN u
                   WHEN json_valid(regexp_extract(u, '\{{[\s\S]*\}}')) THEN regexp_extract(u, '\{{[\s\S]*\}}') END AS j
       FROM r1),
parsed AS (
  SELECT document_id, document_type, j,
         CASE WHEN j IS NULL THEN 'Invalid JSON: no parsable object in response'
              WHEN json_type(j) <> 'OBJECT' THEN 'Expected JSON object, got ' || {pytype('json_type(j)')}
              WHEN json_type(j, '$.fields') IS NULL THEN 'Missing required key ''fields'' in response JSON'
              WHEN json_type(j, '$.fields') <> 'OBJECT' THEN '''fields'' must be a dict, got ' || {pytype("json_type(j, '$.fields')")}
              WHEN json_type(j, '$.confidence_scores') IS NULL THEN 'Missing required key ''confidence_scores'' in response JSON'
              WHEN json_type(j, '$.confidence_scores') <> 'OBJECT'
                   THEN '''confidence_scores'' must be a dict, got ' || {pytype("json_type(j, '$.confidence_scores')")}
              WHEN len(json_keys(json_extract(j, '$.fields'))) = 0
                   THEN '''fields'' is empty — no data was extracted from the document'
         END AS parse_error,
         json_extract(j, '$.fields') AS f, json_extract(j, '$.confidence_scores') AS c,
         coalesce(json_extract_string(j, '$.notes'), '') AS model_notes
  FROM r2),
ok AS (SELECT * FROM parsed WHERE parse_error IS NULL),
fl0 AS (
  SELECT document_id, document_type, model_notes, f, c,
         unnest(json_keys(f)) AS field, unnest(generate_series(1, len(json_keys(f)))) AS pos
  FROM ok),
fl AS (
  SELECT document_id, document_type, model_notes, pos, field,
         json_extract_string(f, '$."' || field || '"') AS value,
         json_type(f, '$."' || field || '"') AS vtype,
         {coerce('''json_extract(c, '$."' || field || '"')''')} AS conf
  FROM fl0),
per_doc AS (
  SELECT document_id, document_type, any_value(model_notes) AS model_notes, count(*) AS n_fields,
         list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(conf ORDER BY pos)), lambda a, b: a + b) / count(*) AS mean,
         count(*) FILTER (WHERE conf < 0.7) AS n_review,
         coalesce(string_agg(field, ', ' ORDER BY pos) FILTER (WHERE conf < 0.4), '') AS very_low
  FROM fl GROUP BY document_id, document_type)"""

_expected_rows = ", ".join(
    f"('{t}', {i + 1}, '{f}')" for t, names in EXPECTED_FIELDS.items() for i, f in enumerate(names))
EXPECTED = f"expected(document_type, epos, field) AS (VALUES {_expected_rows})"

MISSING = f"""
{EXPECTED},
missing AS (
  SELECT d.document_id,
         coalesce(string_agg(e.field, ', ' ORDER BY e.epos) FILTER (
           WHERE NOT EXISTS (SELECT 1 FROM fl WHERE fl.document_id = d.document_id AND fl.field = e.field
                               AND coalesce(fl.value, '') <> '')), '') AS missing_fields
  FROM per_doc d LEFT JOIN expected e ON e.document_type = d.document_type
  GROUP BY d.document_id)"""


def _val(name: str) -> str:
    return f"max(CASE WHEN field = '{name}' THEN value END)"


def _typ(name: str) -> str:
    return f"max(CASE WHEN field = '{name}' THEN vtype END)"


def _plain(name: str) -> str:
    return (f"(CASE WHEN {_typ(name)} IN {NUM_TYPES} OR {_typ(name)} = 'VARCHAR' "
            f"THEN TRY_CAST(trim({_val(name)}) AS DOUBLE) END)")


def _qty(name: str, dollar: bool = False) -> str:
    pat = "[,$]" if dollar else ","
    cleaned = f"trim(regexp_replace({_val(name)}, '{pat}', '', 'g'))"
    return rf"(CASE WHEN length({cleaned}) > 0 THEN TRY_CAST(string_split_regex({cleaned}, '\s+')[1] AS DOUBLE) END)"


def _truthy(name: str) -> str:
    v, t = _val(name), _typ(name)
    return (f"({v} IS NOT NULL AND {t} <> 'NULL' AND NOT ({t} = 'VARCHAR' AND {v} = '') "
            f"AND NOT ({t} IN {NUM_TYPES} AND TRY_CAST({v} AS DOUBLE) = 0) AND NOT ({t} = 'BOOLEAN' AND {v} = 'false'))")


RULES = f"""
piv AS (
  SELECT document_id, document_type,
         {_plain('subtotal')} AS sub, {_plain('total_amount')} AS tot, {_plain('tax_amount')} AS tax,
         {_truthy('port_of_loading')} AND {_truthy('port_of_discharge')}
           AND lower(trim({_val('port_of_loading')})) = lower(trim({_val('port_of_discharge')})) AS same_ports,
         {_qty('total_gross_weight')} AS g, {_qty('total_net_weight')} AS n, {_qty('total_packages')} AS p,
         {_qty('declared_value', True)} AS dv,
         {_truthy('country_of_origin')} AND {_truthy('importer_name')}
           AND contains(lower({_val('importer_name')}), lower({_val('country_of_origin')})) AS imp_origin
  FROM fl GROUP BY document_id, document_type),
rules AS (
  SELECT document_id, document_type, list_filter(CASE document_type
    WHEN 'invoice' THEN [
      CASE WHEN sub IS NOT NULL AND tot IS NOT NULL AND tot < sub * 0.99 THEN
        'Inconsistency: total_amount (' || CAST(tot AS VARCHAR) || ') is less than subtotal (' || CAST(sub AS VARCHAR) || ').' END,
      CASE WHEN sub IS NOT NULL AND tot IS NOT NULL AND tax IS NOT NULL AND abs(sub + tax - tot) > tot * 0.02 + 0.01 THEN
        'Inconsistency: subtotal (' || CAST(sub AS VARCHAR) || ') + tax (' || CAST(tax AS VARCHAR) || ') = '
        || CAST(sub + tax AS VARCHAR) || ', but total_amount is ' || CAST(tot AS VARCHAR) || '.' END]
    WHEN 'bill_of_lading' THEN [
      CASE WHEN same_ports THEN 'Inconsistency: port_of_loading and port_of_discharge are the same.' END]
    WHEN 'packing_list' THEN [
      CASE WHEN g IS NOT NULL AND n IS NOT NULL AND n > g THEN
        'Inconsistency: net weight (' || CAST(n AS VARCHAR) || ') exceeds gross weight (' || CAST(g AS VARCHAR) || ').' END,
      CASE WHEN p IS NOT NULL AND p <= 0 THEN 'Inconsistency: total_packages should be positive.' END]
    WHEN 'customs_declaration' THEN [
      CASE WHEN dv IS NOT NULL AND dv <= 0 THEN 'Inconsistency: declared_value should be positive.' END,
      CASE WHEN imp_origin THEN 'Possible inconsistency: importer appears to be in the same country as origin.' END]
    ELSE [] END, lambda m: m IS NOT NULL) AS warnings
  FROM piv)"""

LINK = r"""
cand AS (
  SELECT document_id,
         CASE field WHEN 'shipment_ref' THEN 1 WHEN 'shipment_reference' THEN 2 WHEN 'shipment_id' THEN 3
                    WHEN 'po_number' THEN 4 ELSE 5 END AS priority,
         CASE WHEN field IN ('po_number') THEN 'po' WHEN field = 'invoice_number' THEN 'inv' ELSE 'sid' END AS kind,
         regexp_replace(value, '^\s+|\s+$', '', 'g') AS ref
  FROM fl
  WHERE field IN ('shipment_ref', 'shipment_reference', 'shipment_id', 'po_number', 'invoice_number')
    AND vtype = 'VARCHAR' AND regexp_replace(value, '^\s+|\s+$', '', 'g') <> ''),
idx AS (
  SELECT 'sid' AS kind, shipment_id AS ref, id AS sid, shipment_id FROM shipments
  UNION ALL
  SELECT 'po', po_number, min(id), arg_min(shipment_id, id) FROM shipments WHERE po_number IS NOT NULL GROUP BY po_number
  UNION ALL
  SELECT 'inv', i.invoice_number, s.id, s.shipment_id FROM invoices i JOIN shipments s ON s.id = i.shipment_id),
best AS (
  SELECT c.document_id, arg_min(x.shipment_id, c.priority * 1000000000000 + x.sid) AS linked_shipment_id,
         min(c.priority) AS link_priority
  FROM cand c JOIN idx x ON x.kind = c.kind AND x.ref = c.ref GROUP BY c.document_id)"""

REVIEW_LOG = """
docn AS (SELECT document_id, upload_timestamp, CAST(substr(document_id, 5) AS BIGINT) AS n FROM extracted_documents),
review_log AS (
  SELECT document_id, 'approved' AS review_status, CAST(NULL AS VARCHAR) AS corrected_fields,
         upload_timestamp + INTERVAL 2 HOUR AS reviewed_at FROM docn WHERE n % 5 = 0
  UNION ALL SELECT document_id, 'rejected', NULL, upload_timestamp + INTERVAL 3 HOUR FROM docn WHERE n % 5 = 1
  UNION ALL SELECT document_id, 'corrected', '{"corrected_by": "reviewer ' || CAST(n % 7 AS VARCHAR) || '"}',
         upload_timestamp + INTERVAL 5 HOUR FROM docn WHERE n % 10 = 1
  UNION ALL SELECT document_id, 'approved', NULL, upload_timestamp + INTERVAL 8 HOUR FROM docn WHERE n % 20 = 1
  UNION ALL SELECT document_id, 'rejected', NULL, upload_timestamp + INTERVAL 2 HOUR FROM docn WHERE n % 15 = 0
  UNION ALL SELECT 'DOC-X' || CAST(n AS VARCHAR), 'approved', NULL, upload_timestamp FROM docn WHERE n % 9 = 0),
last_review AS (
  SELECT s.document_id, s.review_status, f.corrected_fields
  FROM (SELECT document_id, review_status, row_number() OVER (PARTITION BY document_id ORDER BY reviewed_at DESC, review_status DESC) AS rn FROM review_log) s
  LEFT JOIN (SELECT document_id, corrected_fields, row_number() OVER (PARTITION BY document_id ORDER BY reviewed_at DESC, corrected_fields DESC) AS rn
             FROM review_log WHERE corrected_fields IS NOT NULL) f ON f.document_id = s.document_id AND f.rn = 1
  WHERE s.rn = 1)"""

LENIENT = rf"""
l0 AS (SELECT document_id, {strip('response_text')} AS t FROM raw_responses),
l1 AS (SELECT document_id, t, string_split(t, chr(10)) AS lines FROM l0),
l2 AS (SELECT document_id, t,
              {strip("CASE WHEN starts_with(t, '```') THEN array_to_string(list_slice(lines, 2, len(lines) - CASE WHEN trim(lines[len(lines)]) = '```' THEN 1 ELSE 0 END), chr(10)) ELSE t END")} AS cleaned
       FROM l1),
l3 AS (SELECT *, CASE WHEN json_valid(cleaned) AND t <> '' THEN json_type(cleaned) = 'OBJECT' AND json_type(cleaned, '$.fields') IS NOT NULL
              AND json_type(cleaned, '$.confidence_scores') IS NOT NULL AND json_type(cleaned, '$.document_type') IS NOT NULL ELSE false END AS ok FROM l2),
l4 AS (SELECT *, CASE WHEN ok AND json_type(cleaned, '$.confidence_scores') = 'OBJECT' THEN list_filter(list_transform(
              map_values(CAST(json_extract(cleaned, '$.confidence_scores') AS MAP(VARCHAR, JSON))),
              lambda x: CASE WHEN json_type(x) = 'BOOLEAN' THEN CAST(CAST(x AS BOOLEAN) AS DOUBLE) WHEN json_type(x) IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN greatest(0.0, least(1.0, CAST(x AS DOUBLE))) END), lambda x: x IS NOT NULL)
              END AS nums FROM l3)"""


def _w(ctes: str, body: str) -> str:
    # view CTEs are prefixed by the caller, so chain ours after a comma
    return f", {ctes.strip()}\n{body}"


SQL = {
    "i1_i2_parse_status": _w(PARSED, "SELECT document_id, parse_error FROM parsed"),
    "i3_lenient_check": _w(LENIENT, """
SELECT document_id,
       CASE WHEN t = '' OR NOT json_valid(cleaned) OR json_type(cleaned) <> 'OBJECT'
              OR json_type(cleaned, '$.fields') IS NULL OR json_type(cleaned, '$.confidence_scores') IS NULL
              OR json_type(cleaned, '$.document_type') IS NULL THEN false ELSE true END AS passed,
       CASE WHEN t = '' THEN 'Empty response from vision model.'
            WHEN NOT json_valid(cleaned) THEN 'Invalid JSON'
            WHEN json_type(cleaned) <> 'OBJECT' THEN 'Expected a JSON object, got something else.'
            WHEN json_type(cleaned, '$.fields') IS NULL THEN 'Missing required key: ''fields'''
            WHEN json_type(cleaned, '$.confidence_scores') IS NULL THEN 'Missing required key: ''confidence_scores'''
            WHEN json_type(cleaned, '$.document_type') IS NULL THEN 'Missing required key: ''document_type''' END AS reason,
       CASE WHEN ok THEN CAST(coalesce(len(nums), 0) AS INTEGER) END AS n_scores,
       CASE WHEN ok THEN round(coalesce(list_sum(nums), 0.0), 6) END AS score_sum
FROM l4"""),
    "i4_long_fields": _w(PARSED, """
SELECT document_id, CAST(pos AS INTEGER) AS pos, field, value, round(conf, 4) AS confidence, conf < 0.7 AS needs_review FROM fl"""),
    "i6_overall_confidence": _w(PARSED, """
SELECT document_id, CAST(n_fields AS INTEGER) AS n_fields, mean AS mean_confidence, mean < 0.3 AS unrecognizable FROM per_doc"""),
    "i9_review_summary": _w(PARSED, """
SELECT document_id, CAST(n_review AS INTEGER) AS fields_needing_review, CAST(n_fields AS INTEGER) AS total_fields,
       very_low AS very_low_fields FROM per_doc"""),
    "i10_rule_warnings": _w(PARSED + "," + RULES, """
SELECT document_id, document_type, array_to_string(warnings, ' | ') AS warnings FROM rules WHERE len(warnings) > 0"""),
    "i15_completeness": _w(PARSED + "," + MISSING, "SELECT document_id, missing_fields FROM missing"),
    "i16_auto_link": _w(PARSED + "," + LINK, """
SELECT d.document_id, b.linked_shipment_id, b.link_priority FROM per_doc d LEFT JOIN best b USING (document_id)"""),
    "i17_notes": _w(PARSED + "," + RULES + "," + MISSING, """
SELECT d.document_id, array_to_string(list_filter([
         CASE WHEN d.mean < 0.3 THEN 'WARNING: Very low overall confidence (' || printf('%.2f', d.mean)
              || '). Document may be unrecognizable. ' || d.model_notes ELSE d.model_notes END,
         CASE WHEN d.very_low <> '' THEN 'Very low confidence fields (below 0.4): ' || d.very_low END]
         || coalesce(r.warnings, [])
         || [CASE WHEN m.missing_fields <> '' THEN 'Missing expected fields: ' || m.missing_fields END],
       lambda x: x IS NOT NULL AND x <> ''), ' | ') AS notes
FROM per_doc d LEFT JOIN rules r USING (document_id) JOIN missing m USING (document_id)"""),
    "m1_stream_ingest": _w(PARSED + "," + RULES + "," + MISSING + "," + LINK, """
SELECT d.document_id, d.document_type, b.linked_shipment_id, array_to_string(list_filter([
         CASE WHEN d.mean < 0.3 THEN 'WARNING: Very low overall confidence (' || printf('%.2f', d.mean)
              || '). Document may be unrecognizable. ' || d.model_notes ELSE d.model_notes END,
         CASE WHEN d.very_low <> '' THEN 'Very low confidence fields (below 0.4): ' || d.very_low END]
         || coalesce(r.warnings, [])
         || [CASE WHEN m.missing_fields <> '' THEN 'Missing expected fields: ' || m.missing_fields END],
       lambda x: x IS NOT NULL AND x <> ''), ' | ') AS notes
FROM per_doc d LEFT JOIN rules r USING (document_id) JOIN missing m USING (document_id)
LEFT JOIN best b USING (document_id)"""),
    "m1_field_registry": _w(PARSED, "SELECT DISTINCT field AS field_name FROM fl"),
    "i18_review_merge": _w(REVIEW_LOG, """
SELECT e.document_id, coalesce(l.review_status, e.review_status) AS review_status,
       coalesce(l.corrected_fields, e.extracted_fields) AS extracted_fields
FROM extracted_documents e LEFT JOIN last_review l USING (document_id)"""),
    "i18_unknown_reviews": _w(REVIEW_LOG, """
SELECT DISTINCT document_id FROM review_log WHERE document_id NOT IN (SELECT document_id FROM extracted_documents)"""),
    "i19_manual_link": """
, docs6 AS (SELECT document_id, CAST(substr(document_id, 5) AS BIGINT) AS n FROM extracted_documents
            WHERE CAST(substr(document_id, 5) AS BIGINT) % 6 = 0),
link_log AS (
  SELECT d.document_id, s.shipment_id, CAST(s.booking_date AS TIMESTAMP) AS linked_at FROM docs6 d JOIN shipments s ON s.id = d.n + 1
  UNION ALL
  SELECT d.document_id, s.shipment_id, CAST(s.booking_date AS TIMESTAMP) + INTERVAL 1 DAY FROM docs6 d JOIN shipments s ON s.id = d.n + 2
  WHERE d.n % 12 = 0),
last_link AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY linked_at DESC) AS rn FROM link_log) WHERE rn = 1)
SELECT e.document_id, coalesce(l.shipment_id, e.linked_shipment_id) AS linked_shipment_id
FROM extracted_documents e LEFT JOIN last_link l USING (document_id)""",
    "i18_stored_reviews": _w(REVIEW_LOG, """
SELECT e.document_type, coalesce(l.review_status, e.review_status) AS review_status, count(*) AS documents,
       count(*) FILTER (WHERE contains(coalesce(l.corrected_fields, e.extracted_fields), 'corrected_by')) AS corrected
FROM extracted_documents e LEFT JOIN last_review l USING (document_id) GROUP BY 1, 2"""),
    "i19_stored_links": """
, docs6 AS (SELECT document_id, CAST(substr(document_id, 5) AS BIGINT) AS n FROM extracted_documents
            WHERE CAST(substr(document_id, 5) AS BIGINT) % 6 = 0),
link_log AS (
  SELECT d.document_id, s.shipment_id, CAST(s.booking_date AS TIMESTAMP) AS linked_at FROM docs6 d JOIN shipments s ON s.id = d.n + 1
  UNION ALL
  SELECT d.document_id, s.shipment_id, CAST(s.booking_date AS TIMESTAMP) + INTERVAL 1 DAY FROM docs6 d JOIN shipments s ON s.id = d.n + 2
  WHERE d.n % 12 = 0),
last_link AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY linked_at DESC) AS rn FROM link_log) WHERE rn = 1)
SELECT e.document_id, coalesce(l.shipment_id, e.linked_shipment_id) AS linked_shipment_id, true AS known
FROM extracted_documents e LEFT JOIN last_link l USING (document_id)
UNION ALL
SELECT DISTINCT 'DOC-Y' || substr(document_id, 5)::BIGINT::VARCHAR, NULL, false FROM extracted_documents WHERE substr(document_id, 5)::BIGINT % 14 = 0""",
    "i19_unknown_links": """
, d AS (SELECT document_id, CAST(substr(document_id, 5) AS BIGINT) AS n FROM extracted_documents)
SELECT DISTINCT 'DOC-Y' || CAST(n AS VARCHAR) AS document_id FROM d WHERE n % 14 = 0""",
    "i20_field_registry": "SELECT DISTINCT unnest(json_keys(extracted_fields)) AS field_name FROM extracted_documents",
    "i21_confidence_bands": """
SELECT document_type, CASE WHEN overall_confidence >= 0.8 THEN 'high' WHEN overall_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band,
       count(*) AS documents
FROM extracted_documents GROUP BY 1, 2""",
    "i22_type_rollup": "SELECT document_type, count(*) AS count, round(avg(overall_confidence), 2) AS avg_confidence FROM extracted_documents GROUP BY document_type",
    "i23_bol_fields": """
SELECT document_id, json_extract_string(extracted_fields, '$.bl_number') AS bl_number,
       json_extract_string(extracted_fields, '$.vessel_name') AS vessel_name,
       json_extract_string(extracted_fields, '$.port_of_loading') AS loading_port,
       json_extract_string(extracted_fields, '$.port_of_discharge') AS discharge_port,
       json_extract_string(extracted_fields, '$.shipper_name') AS shipper
FROM extracted_documents WHERE document_type = 'bill_of_lading'""",
    "i23_packing_fields": """
SELECT document_id, json_extract_string(extracted_fields, '$.packing_list_number') AS pl_number,
       json_extract_string(extracted_fields, '$.total_gross_weight') AS gross_weight,
       json_extract_string(extracted_fields, '$.total_net_weight') AS net_weight,
       json_extract_string(extracted_fields, '$.total_packages') AS packages
FROM extracted_documents WHERE document_type = 'packing_list'""",
    "i23_customs_fields": """
SELECT document_id, json_extract_string(extracted_fields, '$.declaration_number') AS declaration,
       json_extract_string(extracted_fields, '$.declared_value') AS declared_value,
       json_extract_string(extracted_fields, '$.country_of_origin') AS origin,
       json_extract_string(extracted_fields, '$.hs_code') AS hs_code
FROM extracted_documents WHERE document_type = 'customs_declaration'""",
    "i23_invoice_fields": """
SELECT document_id, json_extract_string(extracted_fields, '$.invoice_number') AS invoice_number,
       json_extract_string(extracted_fields, '$.total_amount') AS total_amount,
       json_extract_string(extracted_fields, '$.vendor_name') AS vendor_name
FROM extracted_documents WHERE document_type = 'invoice'""",
    "i23_parties": """
SELECT document_id, document_type, json_extract_string(extracted_fields, '$.shipper_name') AS shipper,
       json_extract_string(extracted_fields, '$.consignee_name') AS consignee,
       json_extract_string(extracted_fields, '$.vendor_name') AS vendor,
       json_extract_string(extracted_fields, '$.buyer_name') AS buyer
FROM extracted_documents""",
    "i24_typed_threshold": "SELECT count(*) AS invoices_above_threshold FROM extracted_documents WHERE document_type = 'invoice' AND overall_confidence > 0.9",
}
