r"""DuckDB SQL for screens, catalogue and quality jobs.

RE2 has ASCII ``\b``/``\w``/``\s`` and no lookaround, so texts are first mapped
so ASCII classes behave like Python's Unicode ones (non-ASCII letters and
digits -> 'a', Unicode spaces -> ' ', other non-ASCII -> '#'), and lookaheads
are rewritten as equivalent counts.
"""

# fixed values, stated here and not imported, so that a wrong pattern in the package shows
DATA_CLAIM_PATTERNS = [
    r"the data shows",
    r"according to the (results|data|query)",
    r"the (results|query) (show|indicate|reveal)",
    r"there are \d+",
    r"the (total|average|sum|count) is",
]
DESTRUCTIVE_INTENT_PATTERNS = [
    r"\b(drop|delete|remove|destroy|erase|wipe|clear|truncate|purge)\b.*\b(table|data|database|records|rows|everything|all)\b",
    r"\b(table|data|database|records|rows)\b.*\b(drop|delete|remove|destroy|erase|wipe|clear|truncate|purge)\b",
    r"\b(modify|change|update|alter|edit)\b.*\b(schema|table|column|structure)\b",
]
PROMPT_INJECTION_PATTERNS = [
    r"ignore\s+(previous|above)\s+instructions",
    r"disregard\s+(all|your)",
    r"you\s+are\s+now",
    r"new\s+instructions",
    r"system\s+prompt",
    r"forget\s+(your|all)",
]
SQL_INJECTION_PATTERNS = [
    r"(?:^|;\s*)DROP\s+TABLE\b",
    r"(?:^|;\s*)DELETE\s+FROM\b",
    r"(?:^|;\s*)INSERT\s+INTO\b",
    r"(?:^|;\s*)UPDATE\s+\w+\s+SET\b",
    r"(?:^|;\s*)ALTER\s+TABLE\b",
    r"(?:^|;\s*)TRUNCATE\s+TABLE\b",
    r"(?:^|;\s*)GRANT\b",
    r"(?:^|;\s*)REVOKE\b",
    r"UNION\s+SELECT\b",
    r";\s*--",
    r";\s*DROP\b",
]

ASCIIFY = (r"array_to_string(list_transform(string_split({x}, ''), lambda ch: CASE WHEN ord(ch) < 128 THEN ch "
           r"WHEN regexp_matches(ch, '^[\p{{L}}\p{{N}}]$') THEN 'a' "
           r"WHEN regexp_matches(ch, '^[\p{{Z}}\x{{85}}]$') THEN ' ' ELSE '#' END), '')")
USTRIP = r"regexp_replace({x}, '^[\s\v\p{{Z}}\x{{85}}]+|[\s\v\p{{Z}}\x{{85}}]+$', '', 'g')"


def _q(p: str) -> str:
    return p.replace("'", "''")


def _hits(col: str, patterns: list[str]) -> str:
    items = ", ".join(f"CASE WHEN regexp_matches({col}, '(?i){_q(p)}') THEN '{_q(p)}' END" for p in patterns)
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


Q1 = f"""
, q0 AS (SELECT question_id, conv_id, {USTRIP.format(x='text')} AS t FROM questions),
q1 AS (SELECT question_id, conv_id, t, {ASCIIFY.format(x='t')} AS a FROM q0),
q2 AS (SELECT question_id, conv_id, t, {_hits('a', SQL_INJECTION_PATTERNS)} AS h_sql,
              list_slice({_hits('a', DESTRUCTIVE_INTENT_PATTERNS)}, 1, 1) AS h_destr,
              {_hits('a', PROMPT_INJECTION_PATTERNS)} AS h_prompt FROM q1),
q3 AS (SELECT *, CASE WHEN t = '' THEN 'Input is empty.'
                      WHEN length(t) <= 1 THEN 'Input is too short. Please enter a meaningful question.'
                      WHEN length(t) > 1000 THEN 'Input is too long (' || CAST(length(t) AS VARCHAR) || ' chars). Maximum is 1000 characters.'
                      WHEN len(h_sql) > 0 THEN 'Input contains potentially dangerous SQL patterns.'
                      WHEN len(h_destr) > 0 THEN 'This is a read-only analytics system. Data modification (drop, delete, update) is not supported.'
                      WHEN len(h_prompt) > 0 THEN 'Input contains prompt injection patterns.' END AS reason
       FROM q2)
SELECT question_id, conv_id, reason IS NULL AS passed, reason,
       array_to_string(CASE WHEN t = '' OR length(t) <= 1 OR length(t) > 1000 THEN []
                            WHEN len(h_sql) > 0 THEN h_sql WHEN len(h_destr) > 0 THEN h_destr ELSE h_prompt END, chr(10))
         AS matched_patterns
FROM q3"""

J2 = r"""
, s0 AS (SELECT query_id, regexp_replace(coalesce(sql, ''), '^\s+|\s+$', '', 'g') AS s FROM sql_log),
s1 AS (SELECT query_id, s,
   CASE WHEN s = '' THEN 'Empty SQL query.'
        WHEN regexp_matches(s, '(?i)^\s*(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|EXEC|GRANT|REVOKE)\b')
             THEN 'Dangerous SQL operation detected: ' || substr(s, 1, 50) || '...'
        WHEN NOT starts_with(upper(s), 'SELECT') THEN 'Only SELECT queries are allowed. Got: ' || substr(s, 1, 50) || '...'
        WHEN regexp_matches(s, ';\s*\w') THEN 'Multi-statement queries are not allowed.'
        WHEN contains(regexp_replace(regexp_replace(s, ';+$', ''), '\s+$', ''), ';') THEN 'Multiple SQL statements detected'
   END AS reason FROM s0)
SELECT query_id, reason IS NULL AS passed, reason, reason IS NULL AND NOT contains(upper(s), 'LIMIT') AS uncapped FROM s1"""

J4 = r"""
, u0 AS (SELECT query_id, upper(sql) AS u FROM sql_log),
u1 AS (SELECT query_id, u,
   regexp_extract_all(u, '\bJOIN\s+(\w+)\s*(?:\w+\s*)?(?:JOIN|WHERE|GROUP|ORDER|LIMIT|$)', 1) AS jt0 FROM u0),
u2 AS (SELECT query_id, u, list_filter(jt0, lambda t: regexp_matches(u, 'JOIN\s+' || t || '\s+')) AS jt FROM u1),
u3 AS (SELECT query_id, list_filter([
     CASE WHEN regexp_matches(u, 'NOT\s+IN\s*\(') THEN {'severity': 'warning', 'message': 'NOT IN can return unexpected results if the subquery contains NULL values.', 'suggestion': 'Consider using NOT EXISTS instead: WHERE NOT EXISTS (SELECT 1 FROM ... WHERE ...)'} END,
     CASE WHEN len(regexp_extract_all(u, '\bUNION\b')) > len(regexp_extract_all(u, '\bUNION\s+ALL')) THEN {'severity': 'warning', 'message': 'UNION removes duplicates (slow). If duplicates aren''t a concern, use UNION ALL.', 'suggestion': 'Change UNION to UNION ALL unless you specifically need deduplication.'} END,
     CASE WHEN regexp_matches(u, '\b(COUNT|SUM|AVG|MAX|MIN)\s*\(') AND NOT contains(u, 'GROUP BY')
               AND regexp_matches(u, '(?s)SELECT\s+(.*?)\s+FROM') AND contains(regexp_extract(u, '(?s)SELECT\s+(.*?)\s+FROM', 1), ',')
          THEN {'severity': 'error', 'message': 'Multiple columns in SELECT with aggregate functions but no GROUP BY clause.', 'suggestion': 'Add GROUP BY for all non-aggregated columns in the SELECT.'} END,
     CASE WHEN len(jt) > 0 AND NOT contains(u, 'ON') THEN {'severity': 'error', 'message': 'JOIN with ' || jt[1] || ' appears to be missing an ON clause.', 'suggestion': 'Add ON clause: JOIN ' || jt[1] || ' ON <condition>'} END,
     CASE WHEN contains(u, 'SELECT *') AND contains(u, 'JOIN') THEN {'severity': 'warning', 'message': 'SELECT * with JOINs can cause ambiguous column names.', 'suggestion': 'Specify explicit columns: SELECT t1.col1, t2.col2 instead of SELECT *.'} END,
     CASE WHEN contains(u, 'HAVING') AND NOT contains(u, 'GROUP BY') THEN {'severity': 'error', 'message': 'HAVING clause without GROUP BY doesn''t make sense.', 'suggestion': 'Add GROUP BY before HAVING, or move the condition to WHERE.'} END
   ], lambda x: x IS NOT NULL) AS kept FROM u2)
SELECT query_id, CAST(len(list_filter(kept, lambda x: x.severity = 'error')) AS INTEGER) AS errors,
       CAST(len(kept) AS INTEGER) AS warnings, array_to_string(list_transform(kept, lambda x: x.message), ' | ') AS messages,
       array_to_string(list_transform(kept, lambda x: x.severity), ' | ') AS severities,
       array_to_string(list_transform(kept, lambda x: x.suggestion), ' | ') AS suggestions
FROM u3"""

_KNOWN = "['customers', 'carriers', 'shipments', 'shipment_charges', 'tracking_events', 'invoices', 'extracted_documents']"
# DuckDB's list_distinct does not keep order; keep first occurrences explicitly
REFS = rf"""list_filter(w, lambda x, i: list_position(w, x) = i)"""
J5 = rf"""
, r0 AS (SELECT query_id, sql, list_filter(list_transform(regexp_extract_all(sql, '(?i)(?:FROM|JOIN)\s+(\w+)', 1), lambda x: lower(x)),
                         lambda x: list_contains({_KNOWN}, x)) AS w FROM sql_log)
SELECT query_id, array_to_string({REFS}, ',') AS tables FROM r0"""

COUNTS = """
counts AS (
  SELECT 'customers' AS table_name, count(*) AS row_count FROM customers
  UNION ALL SELECT 'carriers', count(*) FROM carriers
  UNION ALL SELECT 'shipments', count(*) FROM shipments
  UNION ALL SELECT 'shipment_charges', count(*) FROM shipment_charges
  UNION ALL SELECT 'tracking_events', count(*) FROM tracking_events
  UNION ALL SELECT 'invoices', count(*) FROM invoices
  UNION ALL SELECT 'extracted_documents', count(*) FROM extracted_documents)"""

# fixed values, stated here and not imported
INDEXED_COLUMNS = {'customers': ['industry', 'country', 'tier'],
 'shipments': ['customer_id',
               'carrier_id',
               'status',
               'mode',
               'origin_country',
               'destination_country',
               'booking_date',
               'commodity'],
 'shipment_charges': ['shipment_id', 'charge_type'],
 'tracking_events': ['shipment_id', 'event_type', 'event_timestamp'],
 'invoices': ['shipment_id', 'customer_id', 'payment_status', 'invoice_date'],
 'extracted_documents': ['document_type', 'review_status', 'linked_shipment_id'],
 'carriers': []}

_IDX = "MAP {" + ", ".join(f"'{t}': [" + ", ".join(f"'{c}'" for c in ["id", *cols]) + "]"
                          for t, cols in INDEXED_COLUMNS.items()) + "}"
J6 = rf"""
, r0 AS (SELECT query_id, sql, regexp_extract(sql, '(?is)\bWHERE\b(.*)$', 1) AS where_text,
                list_filter(list_transform(regexp_extract_all(sql, '(?i)(?:FROM|JOIN)\s+(\w+)', 1), lambda x: lower(x)),
                         lambda x: list_contains({_KNOWN}, x)) AS w FROM sql_log),
r1 AS (SELECT query_id, where_text, unnest({REFS}) AS table_name FROM r0),
{COUNTS.strip()}
SELECT r1.query_id, r1.table_name, c.row_count FROM r1 JOIN counts c USING (table_name)
WHERE c.row_count > 1000
  AND len(list_filter({_IDX}[r1.table_name], lambda col: regexp_matches(r1.where_text, '(?i)\b' || col || '\b'))) = 0"""

J7 = f"""
, g0 AS (SELECT answer_id, result_rows, {_hits('answer', DATA_CLAIM_PATTERNS)} AS claims FROM answers)
SELECT answer_id, NOT (result_rows = 0 AND len(claims) > 0) AS passed,
       CASE WHEN result_rows = 0 AND len(claims) > 0 THEN claims[1] END AS blocked_pattern FROM g0"""

J8 = f"""
, i0 AS (SELECT question_id, lower({USTRIP.format(x='text')}) AS q FROM questions)
SELECT question_id, CASE WHEN q IN ('hi', 'hello', 'hey', 'thanks', 'thank you', 'bye') THEN 'general'
                         WHEN length(q) < 5 THEN 'clarification' ELSE 'sql_query' END AS intent FROM i0"""

A9 = """
, prof AS (
  SELECT 'shipments' AS table_name, 'mode' AS column_name, mode AS value, count(*) AS n FROM shipments GROUP BY mode
  UNION ALL SELECT 'shipments', 'status', status, count(*) FROM shipments GROUP BY status
  UNION ALL SELECT 'shipments', 'priority', priority, count(*) FROM shipments GROUP BY priority
  UNION ALL SELECT 'customers', 'tier', tier, count(*) FROM customers GROUP BY tier
  UNION ALL SELECT 'customers', 'industry', industry, count(*) FROM customers GROUP BY industry
  UNION ALL SELECT 'invoices', 'payment_status', payment_status, count(*) FROM invoices GROUP BY payment_status
  UNION ALL SELECT 'carriers', 'carrier_type', carrier_type, count(*) FROM carriers GROUP BY carrier_type),
pct AS (SELECT *, CAST((n * 200 + sum(n) OVER w) // (2 * sum(n) OVER w) AS INTEGER) AS p
        FROM prof WINDOW w AS (PARTITION BY table_name, column_name))
SELECT table_name, column_name,
       string_agg(coalesce(value, 'NULL') || '(' || CAST(p AS VARCHAR) || '%)', ', ' ORDER BY n DESC, value) AS profile
FROM pct GROUP BY table_name, column_name"""

SQL = {
    "j1_question_screen": Q1,
    "j2_j3_readonly_sql": J2,
    "j4_pitfall_lint": J4,
    "j5_referenced_tables": J5,
    "j6_scan_budget": J6,
    "j7_answer_grounding": J7,
    "j8_rule_intent": J8,
    "a2_parameterised_select": "SELECT shipment_id, status, delay_days FROM shipments WHERE origin_country = 'NATION_7' AND delay_days > 5",
    "a6_row_counts": ", " + COUNTS.strip() + "\nSELECT * FROM counts",
    "a9_value_profile": A9,
    "l1_row_count_expectations": ", " + COUNTS.strip() + """
SELECT table_name, row_count,
       CASE table_name WHEN 'carriers' THEN row_count = (SELECT count(*) FROM supplier)
                       WHEN 'customers' THEN row_count = (SELECT count(*) FROM customer)
                       WHEN 'shipments' THEN row_count = (SELECT count(*) FROM orders)
                       WHEN 'invoices' THEN row_count <= (SELECT count(*) FROM orders) AND row_count > 0
                       WHEN 'shipment_charges' THEN row_count > (SELECT count(*) FROM orders)
                       WHEN 'tracking_events' THEN row_count > (SELECT count(*) FROM orders)
                       ELSE row_count > 0 END AS passed
FROM counts""",
    "l2_orphan_keys": """
SELECT 'shipments.customer_id -> customers.id' AS relation, count(*) AS orphans FROM shipments x WHERE customer_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM customers p WHERE p.id = x.customer_id)
UNION ALL SELECT 'shipments.carrier_id -> carriers.id', count(*) FROM shipments x WHERE carrier_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM carriers p WHERE p.id = x.carrier_id)
UNION ALL SELECT 'shipment_charges.shipment_id -> shipments.id', count(*) FROM shipment_charges x WHERE NOT EXISTS (SELECT 1 FROM shipments p WHERE p.id = x.shipment_id)
UNION ALL SELECT 'tracking_events.shipment_id -> shipments.id', count(*) FROM tracking_events x WHERE NOT EXISTS (SELECT 1 FROM shipments p WHERE p.id = x.shipment_id)
UNION ALL SELECT 'invoices.shipment_id -> shipments.id', count(*) FROM invoices x WHERE NOT EXISTS (SELECT 1 FROM shipments p WHERE p.id = x.shipment_id)
UNION ALL SELECT 'invoices.customer_id -> customers.id', count(*) FROM invoices x WHERE NOT EXISTS (SELECT 1 FROM customers p WHERE p.id = x.customer_id)
UNION ALL SELECT 'invoices.carrier_id -> carriers.id', count(*) FROM invoices x WHERE NOT EXISTS (SELECT 1 FROM carriers p WHERE p.id = x.carrier_id)
UNION ALL SELECT 'extracted_documents.linked_shipment_id -> shipments.shipment_id', count(*) FROM extracted_documents x
WHERE linked_shipment_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shipments p WHERE p.shipment_id = x.linked_shipment_id)""",
    "l3_coverage": """
SELECT 'shipments_without_charges' AS check_name, count(*) AS missing FROM shipments s WHERE NOT EXISTS (SELECT 1 FROM shipment_charges c WHERE c.shipment_id = s.id)
UNION ALL SELECT 'shipments_without_invoice', count(*) FROM shipments s WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.shipment_id = s.id)""",
    "l4_unique_keys": """
SELECT 'shipments.shipment_id' AS key_name, count(shipment_id) - count(DISTINCT shipment_id) AS duplicates FROM shipments
UNION ALL SELECT 'invoices.invoice_number', count(invoice_number) - count(DISTINCT invoice_number) FROM invoices
UNION ALL SELECT 'customers.customer_code', count(customer_code) - count(DISTINCT customer_code) FROM customers
UNION ALL SELECT 'carriers.carrier_code', count(carrier_code) - count(DISTINCT carrier_code) FROM carriers
UNION ALL SELECT 'extracted_documents.document_id', count(document_id) - count(DISTINCT document_id) FROM extracted_documents""",
    "l5_conditional_not_null": """
SELECT count(*) FILTER (WHERE status = 'delayed' AND delay_reason IS NULL) AS delayed_without_reason,
       count(*) FILTER (WHERE status = 'delayed' AND NOT (delay_days BETWEEN 1 AND 30)) AS delayed_bad_days,
       count(*) FILTER (WHERE status = 'delivered' AND actual_arrival IS NULL) AS delivered_without_arrival
FROM shipments""",
    "l6_distribution_order": """
, m AS (SELECT count(*) FILTER (WHERE mode = 'ocean') AS ocean, count(*) FILTER (WHERE mode = 'air') AS air,
               count(*) FILTER (WHERE mode = 'road') AS road, count(*) FILTER (WHERE mode = 'rail') AS rail FROM shipments),
t AS (SELECT status FROM shipments GROUP BY status ORDER BY count(*) DESC, status DESC LIMIT 1)
SELECT ocean > air AND air > road AND road > rail AS mode_order_ok, (SELECT status FROM t) = 'delivered' AS delivered_most_common,
       ocean, air, road, rail FROM m""",
    "l7_invoice_reconciliation": """
, ch AS (SELECT shipment_id, sum(amount_usd) AS charges FROM shipment_charges GROUP BY shipment_id)
SELECT count(*) AS invoices_checked,
       count(*) FILTER (WHERE abs(i.subtotal_usd - ch.charges) > 0.01) AS subtotal_mismatches,
       count(*) FILTER (WHERE abs(i.subtotal_usd + i.tax_usd - i.total_usd) > 0.01) AS total_mismatches
FROM invoices i JOIN ch USING (shipment_id)""",
}


# ---------------------------------------------------------------- A7 table profile

# fixed values: column contract of each logistics table (FIXTURES section 1, as built here)
_COLUMNS = {
    "customers": ["id", "customer_code", "company_name", "industry", "country", "city", "tier", "contact_email",
                  "annual_volume_teu"],
    "carriers": ["id", "carrier_code", "carrier_name", "carrier_type", "headquarters_country", "reliability_score",
                 "avg_transit_days", "cost_per_kg_usd"],
    "shipments": ["id", "shipment_id", "customer_id", "carrier_id", "origin_port", "origin_country",
                  "destination_port", "destination_country", "mode", "status", "booking_date", "estimated_departure",
                  "actual_departure", "estimated_arrival", "actual_arrival", "weight_kg", "volume_cbm",
                  "container_type", "container_count", "commodity", "incoterm", "po_number", "delay_days",
                  "delay_reason", "priority"],
    "shipment_charges": ["shipment_id", "charge_type", "amount_usd", "currency"],
    "tracking_events": ["id", "shipment_id", "event_type", "event_timestamp", "location", "location_country",
                        "description", "created_by", "is_milestone"],
    "invoices": ["id", "invoice_number", "shipment_id", "customer_id", "carrier_id", "invoice_date", "due_date",
                 "subtotal_usd", "tax_usd", "total_usd", "currency", "payment_status", "payment_date"],
    "extracted_documents": ["id", "document_id", "document_type", "file_name", "upload_timestamp",
                            "extraction_model", "overall_confidence", "review_status", "extracted_fields",
                            "confidence_scores", "linked_shipment_id"],
}
_FKS = [
    ("shipments", "customer_id", "customers", "id"), ("shipments", "carrier_id", "carriers", "id"),
    ("shipment_charges", "shipment_id", "shipments", "id"), ("tracking_events", "shipment_id", "shipments", "id"),
    ("invoices", "shipment_id", "shipments", "id"), ("invoices", "customer_id", "customers", "id"),
    ("invoices", "carrier_id", "carriers", "id"),
    ("extracted_documents", "linked_shipment_id", "shipments", "shipment_id"),
]
# stated here and not imported, so that a wrong declaration in the package shows
_NOT_NULL = {
    "customers": "customer_code company_name industry country city tier",
    "carriers": "carrier_code carrier_name carrier_type",
    "shipments": "shipment_id customer_id carrier_id origin_port origin_country destination_port destination_country mode status booking_date weight_kg commodity",
    "shipment_charges": "shipment_id charge_type amount_usd",
    "tracking_events": "shipment_id event_type event_timestamp location",
    "invoices": "invoice_number shipment_id customer_id carrier_id invoice_date due_date subtotal_usd total_usd",
    "extracted_documents": "document_id document_type file_name extracted_fields confidence_scores",
}
_DEFAULTS = {
    "shipments.container_count": "1", "shipments.delay_days": "0", "shipments.priority": "'standard'", "shipment_charges.currency": "'USD'",
    "tracking_events.created_by": "'system'", "tracking_events.is_milestone": "0", "invoices.tax_usd": "0", "invoices.currency": "'USD'",
    "invoices.payment_status": "'pending'", "extracted_documents.upload_timestamp": "CURRENT_TIMESTAMP", "extracted_documents.review_status": "'pending'",
}


def declared(t: str, c: str) -> tuple[str, str, str]:
    """SQL literals: primary key, not null, default."""
    pk = c == "id" and t != "shipment_charges"
    default = _DEFAULTS.get(f"{t}.{c}")
    return str(pk).lower(), str(pk or c in _NOT_NULL[t].split()).lower(), "NULL" if default is None else "'" + default.replace("'", "''") + "'"


_TYPED = "\n  UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, (SELECT typeof({c}) FROM {t} LIMIT 1) AS t"
    for t, cols in _COLUMNS.items() for c in cols)
_FK_ROWS = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in _FKS)

SQL["a7_table_profile"] = ", " + COUNTS.strip() + f""",
typed AS (
  {_TYPED}),
ctypes AS (
  SELECT table_name, column_name,
         CASE WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BIGINT' THEN 'bigint' WHEN t = 'INTEGER' THEN 'int'
              WHEN t = 'DOUBLE' THEN 'double' WHEN t = 'DATE' THEN 'date' WHEN t = 'TIMESTAMP' THEN 'timestamp_ntz'
              WHEN t = 'BOOLEAN' THEN 'boolean' ELSE lower(replace(t, ' ', '')) END AS data_type
  FROM typed),
cols AS (SELECT table_name, count(*) AS column_count,
                string_agg(column_name || ' ' || data_type, ', ' ORDER BY column_name, data_type) AS columns
         FROM ctypes GROUP BY table_name),
fk(from_table, from_column, to_table, to_column) AS (VALUES {_FK_ROWS}),
fks AS (SELECT from_table AS table_name,
               string_agg(from_column || ' -> ' || to_table || '.' || to_column, '; '
                          ORDER BY from_column || ' -> ' || to_table || '.' || to_column) AS foreign_keys
        FROM fk GROUP BY from_table)
SELECT c.table_name, c.row_count, l.column_count, l.columns, f.foreign_keys
FROM counts c JOIN cols l USING (table_name) LEFT JOIN fks f USING (table_name)"""

_FACTS = "\n  UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS position, {declared(t, c)[0]} AS is_pk, {declared(t, c)[1]} AS notnull, "
    f"{declared(t, c)[2]} AS default_value"
    for t, cols in _COLUMNS.items() for i, c in enumerate(cols))
_CTES = SQL["a7_table_profile"][:SQL["a7_table_profile"].rindex("SELECT c.table_name, c.row_count")].rstrip()
SQL["a7_schema_text"] = _CTES + f""",
facts AS ({_FACTS}),
lines AS (SELECT table_name, string_agg('    ' || column_name || ' ' || data_type || CASE WHEN is_pk THEN ' PRIMARY KEY'
                 WHEN "notnull" THEN ' NOT NULL' ELSE '' END || coalesce(' DEFAULT ' || default_value, ''), chr(10) ORDER BY position) AS body
          FROM ctypes JOIN facts USING (table_name, column_name) GROUP BY table_name),
refs AS (SELECT from_table AS table_name,
                string_agg(chr(10) || '    FOREIGN KEY (' || from_column || ') REFERENCES ' || to_table || '(' || to_column || ')', ''
                           ORDER BY from_column) AS tail FROM fk GROUP BY from_table)
SELECT table_name, 'TABLE: ' || table_name || ' (' || format('{{:,}}', row_count) || ' rows)' || chr(10) || body || coalesce(tail, '')
       AS description
FROM counts JOIN lines USING (table_name) LEFT JOIN refs USING (table_name)"""
_NULLS = "\n  UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS null_count FROM {t}"
                              for t, cols in _COLUMNS.items() for c in cols)
SQL["a4_column_metadata"] = _CTES + f""",
facts AS ({_FACTS}),
nulls AS ({_NULLS})
SELECT table_name, column_name, position, null_count, data_type, "notnull", default_value, is_pk
FROM facts JOIN nulls USING (table_name, column_name) JOIN ctypes USING (table_name, column_name)"""
SQL["l5_quarantine"] = """
, lost AS (
  SELECT CASE WHEN id % 5 <> 0 THEN status END AS status, CASE WHEN id % 7 <> 0 THEN origin_country END AS origin_country,
         coalesce(CASE WHEN id % 3 <> 0 THEN delay_days END, 0) AS delay_days FROM shipments),
judged AS (
  SELECT delay_days, array_to_string(list_filter([CASE WHEN origin_country IS NULL THEN 'origin_country' END, CASE WHEN status IS NULL THEN 'status' END], lambda x: x IS NOT NULL), ',') AS violations
  FROM lost)
SELECT violations, count(*) AS shipments, sum(delay_days) AS delay_days, count(*) AS standard FROM judged GROUP BY violations"""
