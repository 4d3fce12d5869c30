"""DuckDB SQL for the catalogue and document-store jobs; constants are stated here."""

from oracle.evaluation import RESULTS
from oracle.screens import _COLUMNS, _FKS as _KEYS


SQL = {
    "a3_table_names": " UNION ALL ".join(f"SELECT '{t}' AS table_name WHERE EXISTS (SELECT 1 FROM {t})" for t in _COLUMNS),
    "a5_foreign_keys": " UNION ALL ".join(
        f"SELECT '{a}' AS from_table, '{b}' AS from_column, '{c}' AS to_table, '{d}' AS to_column, count({b}) AS rows_with_key FROM {a}"
        for a, b, c, d in _KEYS),
    # of an id with remainder 0 two rows arrive in one append, of one with 2 one in each append
    "a10_append": """SELECT document_type, 'pending' AS review_status, count(*) AS stored, count(*) FILTER (WHERE id % 3 <> 1) AS duplicates
FROM extracted_documents GROUP BY document_type""",
    "a11_list_documents": """SELECT document_id, document_type, CAST(len(json_keys(extracted_fields)) AS INTEGER) AS n_fields,
       array_to_string(list_sort(json_keys(confidence_scores)), ',') AS scored_fields FROM extracted_documents""",
    "a12_get_document": """SELECT document_id, document_type, review_status FROM extracted_documents
ORDER BY upload_timestamp DESC, document_id DESC LIMIT 1""",
    "a13_upload_screening": """, files AS (
SELECT file_name, CAST(octet_length(encode(response_text)) AS BIGINT) AS length FROM raw_responses
UNION ALL
SELECT string_split(string_split(url, '?')[1], '/')[-1] || ['.PDF', '.png', '.exe', ''][page_id % 4 + 1],
       CAST(octet_length(encode(html)) AS BIGINT) * 4096 FROM pages),
named AS (SELECT *, CASE WHEN contains(file_name, '.') THEN lower(string_split(file_name, '.')[-1]) END AS ext FROM files),
judged AS (SELECT *, CASE WHEN ext IS NULL OR ext NOT IN ('pdf', 'png', 'jpg', 'jpeg') THEN 'Unsupported file type: .' || coalesce(ext, '')
                          WHEN length > 10485760 THEN 'File too large (max 10 MB)' END AS reason FROM named)
SELECT file_name, length, reason IS NULL AS accepted, reason FROM judged""",
    "a15_result_sink": ", " + RESULTS.lstrip().lstrip(",") + """,
best AS (SELECT model FROM summ2 ORDER BY round(comp, 1) DESC, model DESC LIMIT 1)
SELECT c.model, count(*) AS results, sum(correct_behavior) AS correct, sum(output_tokens) AS output_tokens, max(s.test_count) AS summary_count,
       round(max(s.comp), 1) AS composite_score, count(*) FILTER (WHERE correct_behavior = 0) AS failed, c.model = (SELECT model FROM best) AS is_winner
FROM costed c JOIN summ2 s USING (model) GROUP BY c.model""",
}
