"""DuckDB SQL for SURVEY 2.2-2.6; views come from the shared CTE prefix."""

AS_OF = "DATE '2001-08-01'"

SQL = {
    "b1_projection": "SELECT shipment_id AS shipment, origin_country AS origin, destination_country AS destination, mode AS transport_mode FROM shipments",
    "b2_eq_filter": "SELECT shipment_id, origin_country, destination_country, delay_days, delay_reason FROM shipments WHERE status = 'delayed'",
    "b3_numeric_filter": "SELECT shipment_id, mode, weight_kg FROM shipments WHERE weight_kg > 20000",
    "b4_conjunction": "SELECT shipment_id, carrier_id, delay_days FROM shipments WHERE status = 'delivered' AND mode = 'air' AND delay_days > 0",
    "b5_null_checks": """
SELECT 'carriers_without_hq' AS check_name, count(*) AS row_count FROM carriers WHERE headquarters_country IS NULL
UNION ALL
SELECT 'shipments_with_delay_reason', count(*) FROM shipments WHERE delay_reason IS NOT NULL""",
    "b6_not_equal": "SELECT payment_status, count(*) AS invoice_count FROM invoices WHERE payment_status <> 'cancelled' GROUP BY payment_status",
    "b7_boolean_flag": "SELECT event_type, count(*) AS event_count FROM tracking_events WHERE is_milestone GROUP BY event_type",
    "b8_month_range": "SELECT shipment_id, mode, status, booking_date FROM shipments WHERE booking_date >= DATE '1998-01-01' AND booking_date < DATE '1998-02-01'",
    "b9_calendar_periods": """
SELECT count(*) FILTER (WHERE year(booking_date) = 1998) AS year_1998,
       count(*) FILTER (WHERE year(booking_date) = 1999 AND quarter(booking_date) = 3) AS q3_1999,
       count(*) FILTER (WHERE year(booking_date) = 2000 AND month(booking_date) <= 6) AS h1_2000,
       count(*) FILTER (WHERE booking_date >= DATE '1996-03-01' AND booking_date < DATE '1996-06-01') AS mar_may_1996
FROM shipments""",
    "b10_relative_periods": f"""
SELECT count(*) FILTER (WHERE booking_date > {AS_OF} - INTERVAL 30 DAY AND booking_date <= {AS_OF}) AS last_30_days,
       count(*) FILTER (WHERE booking_date > {AS_OF} - INTERVAL 7 DAY AND booking_date <= {AS_OF}) AS past_week,
       count(*) FILTER (WHERE booking_date >= date_trunc('quarter', {AS_OF}) - INTERVAL 3 MONTH
                          AND booking_date < date_trunc('quarter', {AS_OF})) AS last_quarter
FROM shipments""",
    "b11_past_due": f"SELECT count(*) AS past_due_count, sum(total_usd) AS past_due_amount FROM invoices WHERE due_date < {AS_OF} AND payment_status = 'pending'",
    "b12_date_diff": "SELECT count(*) FILTER (WHERE datediff('day', invoice_date, payment_date) <= 30) AS paid_within_30, count(*) AS paid_total FROM invoices WHERE payment_status = 'paid'",
    "b13_column_compare": "SELECT shipment_id, estimated_arrival, actual_arrival FROM shipments WHERE actual_arrival < estimated_arrival",
    "b14_distinct": "SELECT DISTINCT origin_country, destination_country FROM shipments",
    "b15_in_list": "SELECT mode, count(*) AS shipment_count FROM shipments WHERE mode IN ('ocean', 'air') GROUP BY mode",
    "b16_in_subquery": "SELECT mode, count(*) AS shipment_count FROM shipments WHERE customer_id IN (SELECT id FROM customers WHERE tier = 'gold') GROUP BY mode",
    "b17_name_match": "SELECT c.carrier_name, count(*) AS shipment_count FROM shipments s JOIN carriers c ON s.carrier_id = c.id WHERE c.carrier_name ILIKE '%maersk%' GROUP BY c.carrier_name",
    "b18_point_hit": """SELECT shipment_id, status, mode FROM shipments
WHERE shipment_id = (SELECT max_by(shipment_id, (booking_date, shipment_id)) FROM shipments)""",
    "b18_point_lookup": "SELECT shipment_id, status, mode FROM shipments WHERE shipment_id = 'SHP-00100'",
    "b19_json_filter": """
SELECT document_id, document_type, overall_confidence, review_status,
       json_extract_string(extracted_fields, '$.bl_number') AS bl_number,
       json_extract_string(extracted_fields, '$.shipper_name') AS shipper_name,
       json_extract_string(extracted_fields, '$.vessel_name') AS vessel_name
FROM extracted_documents WHERE starts_with(json_extract_string(extracted_fields, '$.bl_number'), 'BL-1998-')""",
    "c1_two_table_join": "SELECT c.carrier_name, c.carrier_type, count(*) AS shipment_count FROM shipments s JOIN carriers c ON s.carrier_id = c.id GROUP BY c.id, c.carrier_name, c.carrier_type",
    "c2_three_table_join": """
SELECT c.carrier_name, round(CAST(sum(sc.amount_usd) AS DOUBLE) / count(sc.amount_usd), 2) AS avg_freight
FROM shipment_charges sc JOIN shipments s ON sc.shipment_id = s.id JOIN carriers c ON s.carrier_id = c.id
WHERE sc.charge_type = 'freight' GROUP BY c.id, c.carrier_name""",
    "c3_four_table_join": """
SELECT cu.tier, count(*) AS delivered_shipments, sum(i.total_usd) AS invoiced_usd
FROM (SELECT shipment_id, count(*) AS n FROM tracking_events WHERE event_type = 'delivered' GROUP BY shipment_id) t
JOIN shipments s ON t.shipment_id = s.id JOIN invoices i ON i.shipment_id = s.id JOIN customers cu ON cu.id = s.customer_id
GROUP BY cu.tier""",
    "c4_carrier_performance": """
SELECT c.carrier_name, c.carrier_type, count(*) AS total_shipments,
       round(CAST(100 * sum(CASE WHEN s.delay_days = 0 AND s.status = 'delivered' THEN 1 ELSE 0 END) AS DOUBLE)
             / NULLIF(sum(CASE WHEN s.status = 'delivered' THEN 1 ELSE 0 END), 0), 1) AS ontime_pct,
       round(CAST(sum(sc.total_cost) AS DOUBLE) / count(sc.total_cost), 2) AS avg_cost
FROM carriers c JOIN shipments s ON c.id = s.carrier_id
LEFT JOIN (SELECT shipment_id, sum(amount_usd) AS total_cost FROM shipment_charges GROUP BY shipment_id) sc ON s.id = sc.shipment_id
GROUP BY c.id, c.carrier_name, c.carrier_type
ORDER BY total_shipments DESC, c.carrier_name ASC LIMIT 10""",
    "c5_without_events": "SELECT s.shipment_id, s.status FROM shipments s LEFT JOIN tracking_events t ON t.shipment_id = s.id WHERE t.id IS NULL",
    "c5_without_shipments": "SELECT c.customer_code, c.company_name FROM customers c LEFT JOIN shipments s ON s.customer_id = c.id WHERE s.id IS NULL",
    "c5_anti_join": "SELECT s.shipment_id, s.status FROM shipments s WHERE NOT EXISTS (SELECT 1 FROM invoices i WHERE i.shipment_id = s.id)",
    "c6_semi_join": "SELECT customer_code, company_name, tier FROM customers cu WHERE EXISTS (SELECT 1 FROM shipments s WHERE s.customer_id = cu.id AND s.status = 'cancelled')",
    "c7_document_shipment_join": """
SELECT s.shipment_id, s.status, s.mode, s.origin_country, s.destination_country, e.document_type, e.overall_confidence
FROM extracted_documents e JOIN shipments s ON e.linked_shipment_id = s.shipment_id""",
    "c8_extracted_vs_actual": """
SELECT json_extract_string(e.extracted_fields, '$.invoice_number') AS invoice_number,
       json_extract_string(e.extracted_fields, '$.total_amount') AS extracted_amount,
       s.shipment_id, CAST(sum(sc.amount_usd) AS DECIMAL(18,2)) AS actual_charges
FROM extracted_documents e JOIN shipments s ON e.linked_shipment_id = s.shipment_id
JOIN shipment_charges sc ON s.id = sc.shipment_id
WHERE e.document_type = 'invoice'
GROUP BY e.document_id, s.shipment_id, e.extracted_fields""",
    "c9_document_timeline": """
SELECT e.document_type, s.shipment_id, t.event_type, t.event_timestamp, t.location
FROM extracted_documents e JOIN shipments s ON e.linked_shipment_id = s.shipment_id
JOIN tracking_events t ON s.id = t.shipment_id""",
    "c10_document_carrier": """
SELECT e.document_type, json_extract_string(e.extracted_fields, '$.bl_number') AS bl_number,
       json_extract_string(e.extracted_fields, '$.invoice_number') AS invoice_number,
       s.shipment_id, c.carrier_name, c.carrier_type
FROM extracted_documents e JOIN shipments s ON e.linked_shipment_id = s.shipment_id JOIN carriers c ON s.carrier_id = c.id""",
    "c11_documents_delayed": """
SELECT e.document_id, e.document_type, s.shipment_id, s.delay_days
FROM extracted_documents e JOIN shipments s ON e.linked_shipment_id = s.shipment_id WHERE s.status = 'delayed'""",
    "c12_fanout_measures": """
SELECT cu.company_name, cu.tier, sh.shipment_count, sp.total_spend
FROM customers cu
JOIN (SELECT customer_id, count(*) AS shipment_count FROM shipments GROUP BY customer_id) sh ON sh.customer_id = cu.id
LEFT JOIN (SELECT customer_id, sum(total_usd) AS total_spend FROM invoices GROUP BY customer_id) sp ON sp.customer_id = cu.id""",
    "d1_count": "SELECT count(*) AS total_shipments FROM shipments",
    "d2_count_by_group": "SELECT status, count(*) AS shipment_count FROM shipments GROUP BY status",
    "d3_global_aggregates": "SELECT sum(total_usd) AS total, min(total_usd) AS min_total, max(total_usd) AS max_total, round(CAST(sum(total_usd) AS DOUBLE) / count(total_usd), 2) AS avg_total FROM invoices",
    "d4_grouped_measures": "SELECT charge_type, count(*) AS charge_count, round(CAST(sum(amount_usd) AS DOUBLE) / count(amount_usd), 2) AS avg_amount, sum(amount_usd) AS total_amount FROM shipment_charges GROUP BY charge_type",
    "d5_multi_key_group": "SELECT commodity, mode, count(*) AS shipment_count FROM shipments GROUP BY commodity, mode",
    "d6_count_distinct": "SELECT c.carrier_type, count(DISTINCT s.customer_id) AS distinct_customers, count(DISTINCT s.destination_country) AS distinct_destinations FROM shipments s JOIN carriers c ON s.carrier_id = c.id GROUP BY c.carrier_type",
    "d7_conditional_rate": """
SELECT c.carrier_name, count(*) AS total, sum(CASE WHEN s.delay_days > 0 THEN 1 ELSE 0 END) AS delayed,
       round(CAST(100 * sum(CASE WHEN s.delay_days > 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 1) AS delay_rate_pct
FROM shipments s JOIN carriers c ON s.carrier_id = c.id GROUP BY c.id, c.carrier_name""",
    "d8_nullif_rate": """
SELECT mode, round(CAST(100 * count(*) FILTER (WHERE status = 'delivered' AND delay_days = 0) AS DOUBLE)
                   / NULLIF(count(*) FILTER (WHERE status = 'delivered'), 0), 1) AS ontime_pct
FROM shipments GROUP BY mode""",
    "d9_ratio_of_sums": """
SELECT s.mode, round(CAST(sum(f.freight) AS DOUBLE) / sum(s.weight_kg), 4) AS cost_per_kg
FROM (SELECT shipment_id, sum(amount_usd) AS freight FROM shipment_charges WHERE charge_type = 'freight' GROUP BY shipment_id) f
JOIN shipments s ON f.shipment_id = s.id GROUP BY s.mode""",
    "d10_having": """
SELECT origin_country, destination_country, round(CAST(sum(delay_days) AS DOUBLE) / count(*), 1) AS avg_delay, count(*) AS total
FROM shipments WHERE delay_days > 0 GROUP BY origin_country, destination_country HAVING count(*) >= 5""",
    "d11_group_by_alias": """
SELECT 'month' AS grain, strftime(booking_date, '%Y-%m') AS period, CAST(count(*) AS DOUBLE) AS value FROM shipments GROUP BY period
UNION ALL
SELECT 'quarter_revenue', CAST(year(invoice_date) AS VARCHAR) || '-Q' || CAST(quarter(invoice_date) AS VARCHAR) AS period,
       CAST(sum(total_usd) AS DOUBLE) FROM invoices WHERE payment_status <> 'cancelled' GROUP BY period""",
    "d13_two_level_aggregate": """
SELECT s.mode, round(CAST(sum(p.n_charges) AS DOUBLE) / count(*), 4) AS avg_charges,
       round(CAST(sum(p.amount) AS DOUBLE) / count(p.amount), 2) AS avg_amount
FROM (SELECT shipment_id, count(*) AS n_charges, sum(amount_usd) AS amount FROM shipment_charges GROUP BY shipment_id) p
JOIN shipments s ON p.shipment_id = s.id GROUP BY s.mode""",
    "d14_percentage_of_total": "SELECT round(CAST(100 * count(*) FILTER (WHERE status = 'delayed') AS DOUBLE) / count(*), 2) AS pct_delayed FROM shipments",
    "d15_rate_comparison": "SELECT priority, round(CAST(100 * count(*) FILTER (WHERE status = 'cancelled') AS DOUBLE) / count(*), 2) AS cancel_pct FROM shipments GROUP BY priority",
    "d16_two_group_comparison": "SELECT mode, count(*) AS shipments, round(avg(weight_kg), 2) AS avg_weight, round(CAST(sum(delay_days) AS DOUBLE) / count(*), 3) AS avg_delay FROM shipments WHERE mode IN ('ocean', 'air') GROUP BY mode",
    "d17_year_over_year": """
SELECT year, shipments, shipments - lag(shipments) OVER (ORDER BY year) AS change
FROM (SELECT year(booking_date) AS year, count(*) AS shipments FROM shipments GROUP BY 1) y""",
    "d18_monthly_average": "SELECT strftime(invoice_date, '%Y-%m') AS month, round(CAST(sum(total_usd) AS DOUBLE) / count(total_usd), 2) AS avg_invoice FROM invoices WHERE year(invoice_date) = 1998 GROUP BY month",
    "d19_empty_aggregate": "SELECT avg(delay_days) AS avg_delay, count(*) AS n FROM shipments WHERE status = 'booked' AND delay_days > 0",
    "d20_join_group": """
SELECT cu.industry, count(*) AS invoices, sum(i.total_usd) AS total_spend
FROM invoices i JOIN customers cu ON i.customer_id = cu.id GROUP BY cu.industry""",
    "d21_three_join_filter": """
SELECT c.carrier_type, round(CAST(sum(f.freight) AS DOUBLE) / count(f.freight), 2) AS avg_freight, count(*) AS shipments
FROM (SELECT shipment_id, sum(amount_usd) AS freight FROM shipment_charges WHERE charge_type = 'freight' GROUP BY shipment_id) f
JOIN shipments s ON f.shipment_id = s.id JOIN customers cu ON cu.id = s.customer_id AND cu.tier = 'gold'
JOIN carriers c ON c.id = s.carrier_id GROUP BY c.carrier_type""",
    "e1_latest_per_key": """
SELECT shipment_id, event_type, event_timestamp, location FROM (
  SELECT *, row_number() OVER (PARTITION BY shipment_id ORDER BY event_timestamp DESC, id DESC) AS rn FROM tracking_events) t
WHERE rn = 1""",
    "e2_transit_time": """
SELECT shipment_id, CAST(datediff('hour', dep, dlv) AS BIGINT) AS transit_hours FROM (
  SELECT shipment_id, min(CASE WHEN event_type = 'departed_origin' THEN event_timestamp END) AS dep,
         max(CASE WHEN event_type = 'delivered' THEN event_timestamp END) AS dlv
  FROM tracking_events WHERE event_type IN ('departed_origin', 'delivered') GROUP BY shipment_id) g
WHERE dep IS NOT NULL AND dlv IS NOT NULL""",
    "e3_recent_turns": """
SELECT conv_id, string_agg(upper(role) || ': ' || CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END,
                           chr(10) ORDER BY turn) AS history, count(*) AS turns_kept
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) c
WHERE rn <= 10 GROUP BY conv_id""",
    "f1_top_n_groups": """
SELECT c.carrier_name, c.carrier_type, count(*) AS shipment_count FROM shipments s JOIN carriers c ON s.carrier_id = c.id
GROUP BY c.id, c.carrier_name, c.carrier_type ORDER BY shipment_count DESC, c.carrier_name LIMIT 10""",
    "f2_top_n_rows": "SELECT shipment_id, weight_kg FROM shipments ORDER BY weight_kg DESC, shipment_id LIMIT 10",
    "f3_cheapest_carrier_type": """SELECT carrier_type, round(avg(cost_per_kg_usd), 6) AS mean_cost FROM carriers
GROUP BY carrier_type ORDER BY avg(cost_per_kg_usd), carrier_type LIMIT 1""",
    "f3_arg_extremes": """
(SELECT 'cheapest_carrier' AS question, carrier_name AS answer, avg_freight AS value FROM (
   SELECT c.carrier_name, round(CAST(sum(sc.amount_usd) AS DOUBLE) / count(sc.amount_usd), 2) AS avg_freight
   FROM shipment_charges sc JOIN shipments s ON sc.shipment_id = s.id JOIN carriers c ON s.carrier_id = c.id
   WHERE sc.charge_type = 'freight' GROUP BY c.id, c.carrier_name) x ORDER BY avg_freight, carrier_name LIMIT 1)
UNION ALL
(SELECT 'busiest_month', month, CAST(n AS DOUBLE) FROM (
   SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS n FROM shipments GROUP BY 1) m
 ORDER BY n DESC, month DESC LIMIT 1)""",
    "f4_chronological": "SELECT strftime(booking_date, '%Y-%m') AS month, count(*) AS shipments FROM shipments GROUP BY 1 ORDER BY 1",
    "f5_default_cap": "SELECT shipment_id, booking_date, status FROM shipments ORDER BY booking_date DESC, shipment_id LIMIT 100",
    "h6_json_extract": """
SELECT event_type, sum(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS sum_k,
       count(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS n_k,
       max(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER)) AS max_k
FROM events GROUP BY event_type""",
    "h_scalar_functions": """
SELECT id, strftime(booking_date, '%Y-%m') AS month, CAST(year(booking_date) AS VARCHAR) || '-Q' || CAST(quarter(booking_date) AS VARCHAR) AS quarter,
       datediff('day', booking_date, estimated_arrival) AS planned_days, CAST(booking_date - INTERVAL 30 DAY AS DATE) AS window_start,
       coalesce(volume_cbm, 0.0) AS volume_or_zero, greatest(0.0, least(1.0, delay_days / 20.0)) AS delay_score,
       printf('INV-%d-%06d', year(booking_date), id) AS invoice_key
FROM shipments""",
    "h12_cut_text": """
SELECT question_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...' ELSE text END AS title,
       lower(trim(text)) = 'hi' AS is_hi, contains(lower(text), 'drop table') AS mentions_drop
FROM questions""",
    "d12_bare_columns": """
SELECT e.document_id, s.shipment_id,
       any_value(json_extract_string(e.extracted_fields, '$.invoice_number')) AS invoice_number,
       any_value(json_extract_string(e.extracted_fields, '$.total_amount')) AS extracted_amount,
       sum(sc.amount_usd) AS actual_charges
FROM extracted_documents e JOIN shipments s ON e.linked_shipment_id = s.shipment_id
JOIN shipment_charges sc ON s.id = sc.shipment_id
WHERE e.document_type = 'invoice'
GROUP BY e.document_id, s.shipment_id""",
}
