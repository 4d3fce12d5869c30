"""DuckDB SQL for retrieval analytics (K1-K5)."""

_DOT = "list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * d.dv[i])), lambda a, b: a + b)"
_NQ = "sqrt(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(q.v, lambda x: x * x)), lambda a, b: a + b))"
_ND = "sqrt(list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(d.dv, lambda x: x * x)), lambda a, b: a + b))"
_VIEW = "CASE WHEN m.model = 'full' THEN CAST(x AS DOUBLE) WHEN x < 0 THEN -1.0 ELSE 1.0 END"

_CENTROIDS = """
, ex AS (SELECT label, unnest(generate_series(1, len(embedding))) AS i, unnest(embedding) AS x FROM embeddings),
pd AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS m FROM ex GROUP BY label, i),
lab AS (SELECT label, list(m ORDER BY i) AS vec FROM pd GROUP BY label),
coll AS (
  SELECT 'table_' || CAST(label AS VARCHAR) AS doc_id, vec, CAST(label AS VARCHAR) AS tbl,
         CAST(NULL AS VARCHAR) AS from_table, CAST(NULL AS VARCHAR) AS to_table FROM lab
  UNION ALL
  SELECT 'rel_' || CAST(a.label AS VARCHAR) || '_' || CAST(b.label AS VARCHAR),
         list_transform(range(1, len(a.vec) + 1), lambda i: (a.vec[i] + b.vec[i]) / 2),
         NULL, CAST(a.label AS VARCHAR), CAST(b.label AS VARCHAR)
  FROM lab a JOIN lab b ON a.label + 1 = b.label),"""
_EXAMPLES = """
, coll AS (SELECT 'example_' || CAST(vec_id AS VARCHAR) AS doc_id, embedding AS vec, CAST(label AS VARCHAR) AS tbl,
                CAST(NULL AS VARCHAR) AS from_table, CAST(NULL AS VARCHAR) AS to_table
         FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),"""
_SIMILAR = f"""
models(model) AS (VALUES ('full'), ('sign')),
q AS (SELECT m.model, e.vec_id, e.label, list_transform(e.embedding, lambda x: {_VIEW}) AS v FROM embeddings e CROSS JOIN models m),
d AS (SELECT m.model, c.doc_id, c.tbl, c.from_table, c.to_table, list_transform(c.vec, lambda x: {_VIEW}) AS dv
      FROM coll c CROSS JOIN models m),
sim AS (SELECT q.model, q.vec_id, q.label, d.doc_id, d.tbl, d.from_table, d.to_table,
               {_DOT} / ({_NQ} * {_ND}) AS s
        FROM q JOIN d ON q.model = d.model),"""
HITS = _CENTROIDS + _SIMILAR + """
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model, vec_id ORDER BY s DESC, doc_id) AS rank FROM sim)
         WHERE rank <= 5),
ret0 AS (SELECT model, vec_id, label,
                list_filter(flatten(list([tbl, from_table, to_table] ORDER BY rank)), lambda x: x IS NOT NULL) AS w
         FROM hits GROUP BY model, vec_id, label),
ret AS (SELECT model, vec_id, label, list_filter(w, lambda x, i: list_position(w, x) = i) AS retrieved FROM ret0),
sc AS (SELECT model, vec_id, label, list_contains(retrieved, CAST(label AS VARCHAR)) AS hit,
              CASE WHEN list_contains(retrieved, CAST(label AS VARCHAR)) THEN 1.0 ELSE 0.0 END AS recall,
              CASE WHEN len(retrieved) > 0 THEN CAST(CASE WHEN list_contains(retrieved, CAST(label AS VARCHAR)) THEN 1 ELSE 0 END AS DOUBLE) / len(retrieved) ELSE 0.0 END AS precision,
              coalesce(1.0 / nullif(list_position(retrieved, CAST(label AS VARCHAR)), 0), 0.0) AS reciprocal_rank
       FROM ret)"""

SQL = {
    "k1_nearest_examples": _EXAMPLES + _SIMILAR.rstrip(",") + """
SELECT model, vec_id, CAST(row_number() OVER (PARTITION BY model, vec_id ORDER BY s DESC, doc_id) AS INTEGER) AS rank, doc_id
FROM sim QUALIFY rank <= 3""",
    "k1_similar_vectors": """
, coll AS (SELECT 'vec_' || CAST(vec_id AS VARCHAR) AS doc_id, embedding AS vec, CAST(NULL AS VARCHAR) AS tbl,
                CAST(NULL AS VARCHAR) AS from_table, CAST(NULL AS VARCHAR) AS to_table FROM embeddings),""" + _SIMILAR.rstrip(",").replace("FROM embeddings e CROSS JOIN models m", "FROM embeddings e CROSS JOIN models m WHERE e.vec_id % 20 = 0") + """
SELECT model, vec_id, CAST(row_number() OVER (PARTITION BY model, vec_id ORDER BY s DESC, doc_id) AS INTEGER) AS rank, doc_id
FROM sim QUALIFY rank <= 5""",
    "k1_nearest_documents": HITS + "\nSELECT model, vec_id, CAST(rank AS INTEGER) AS rank, doc_id FROM hits",
    "k2_retrieved_tables": HITS + "\nSELECT model, vec_id, array_to_string(retrieved, ',') AS retrieved FROM ret",
    "k3_question_scores": HITS + "\nSELECT model, vec_id, hit, precision, reciprocal_rank FROM sc",
    "k4_k6_retrieval_summary": HITS + """,
per AS (SELECT model, CASE model WHEN 'full' THEN 256.0 ELSE 8.0 END AS cost,
               round(avg(recall), 4) AS recall_at_5, round(avg(precision), 4) AS precision_at_5,
               round(avg(reciprocal_rank), 4) AS mrr, count(*) AS total, count(*) FILTER (WHERE hit) AS hits
        FROM sc GROUP BY model)
SELECT model, recall_at_5, precision_at_5, mrr, hits, total - hits AS misses,
       round(recall_at_5 * 0.7 + mrr * 0.2 + (1.0 - cost / max(cost) OVER ()) * 0.1, 4) AS balance
FROM per""",
    "k5_category_recall": HITS + """
SELECT model, label AS category, round(count(*) FILTER (WHERE hit) / count(*), 4) AS recall FROM sc GROUP BY model, label""",
}


# ---------------------------------------------------------------- evaluation results

from oracle.screens import J8 as _J8, Q1 as _Q1  # noqa: E402

# stated here and not imported, so that a wrong constant in the package shows
EVAL_MODELS = ["openrouter/qwen/qwen3-coder", "google/gemini-2.5-flash", "openrouter/deepseek/deepseek-chat",
               "openrouter/anthropic/claude-sonnet-4", "local/unpriced-model"]
MODEL_PRICES = [("openrouter/deepseek/deepseek-chat", 0.27, 1.10), ("openrouter/anthropic/claude-sonnet-4", 3.0, 15.0)]
REFUSAL_PHRASES = """cannot answer|can't answer|unable to answer|not available|no data|doesn't exist|does not exist|not in the database
not in our database|no table|no such|unanswerable|cannot be answered|not possible|outside the scope|beyond the scope|i cannot|i can't
not supported""".replace("\n", "|").split("|")

_Q1_CTES = _Q1[:_Q1.rindex("SELECT question_id, conv_id, reason IS NULL AS passed")]
_J8_CTE = _J8[:_J8.rindex("SELECT question_id, CASE WHEN")].lstrip().lstrip(",")
_MODELS = ", ".join(f"({i}, '{m}')" for i, m in enumerate(EVAL_MODELS))
_PRICES = ", ".join(f"('{m}', {a}, {b})" for m, a, b in MODEL_PRICES)
_STRIP = r"regexp_replace({x}, '^[\s\v\p{{Z}}\x{{85}}]+|[\s\v\p{{Z}}\x{{85}}]+$', '', 'g')"
_KNOWN = "['customers', 'carriers', 'shipments', 'shipment_charges', 'tracking_events', 'invoices', 'extracted_documents']"


def _refs(x: str) -> str:
    w = (rf"list_filter(list_transform(regexp_extract_all({x}, '(?i)(?:FROM|JOIN)\s+(\w+)', 1), lambda y: lower(y)), "
         rf"lambda y: list_contains({_KNOWN}, y))")
    return f"list_filter({w}, lambda y, i: list_position({w}, y) = i)"


_REFUSE = " OR ".join(f"contains(lower(coalesce(raw_response, '')), '{p.replace(chr(39), chr(39) * 2)}')" for p in REFUSAL_PHRASES)

RESULTS = _Q1_CTES.rstrip() + ",\n" + _J8_CTE.strip() + rf""",
nlog AS (SELECT count(*) AS n FROM sql_log),
models(m, model) AS (VALUES {_MODELS}),
prices(model, input_per_mtok, output_per_mtok) AS (VALUES {_PRICES}),
qm AS (
  SELECT q3.question_id, q3.reason, q3.reason IS NULL AS passed, qs.text, i0.q, m.m, m.model,
         CASE WHEN q3.reason IN ('Input contains potentially dangerous SQL patterns.', 'Input contains prompt injection patterns.',
                                 'This is a read-only analytics system. Data modification (drop, delete, update) is not supported.')
              THEN 'block'
              WHEN q3.reason IS NOT NULL OR NOT (i0.q NOT IN ('hi', 'hello', 'hey', 'thanks', 'thank you', 'bye') AND length(i0.q) >= 5)
              THEN 'refuse' ELSE 'answer' END AS expected_behavior,
         (q3.question_id * 7 + m.m * 13) % (SELECT n FROM nlog) AS answer_key,
         q3.question_id % (SELECT n FROM nlog) AS truth_key
  FROM q3 JOIN i0 USING (question_id) JOIN questions qs USING (question_id) CROSS JOIN models m),
ans AS (
  SELECT qm.*, CASE WHEN expected_behavior = 'block' THEN 'injection' WHEN expected_behavior = 'refuse' THEN 'unanswerable'
                    ELSE ['simple_count', 'two_table_join', 'aggregation', 'time_filter'][question_id % 4 + 1] END AS category,
         coalesce(a.sql, '') AS model_sql, coalesce(t.sql, '') AS truth_sql
  FROM qm LEFT JOIN sql_log a ON a.query_id = qm.answer_key LEFT JOIN sql_log t ON t.query_id = qm.truth_key),
rep AS (
  SELECT *, CAST(json_object('sql', model_sql, 'explanation', 'generated', 'tables_used', {_refs('model_sql')}) AS VARCHAR) AS reply,
         (question_id + m) % 9 AS style FROM ans),
raw AS (
  SELECT *, CASE WHEN NOT passed THEN ''
                 WHEN style = 0 THEN reply
                 WHEN style = 1 THEN '```json' || chr(10) || reply || chr(10) || '```'
                 WHEN style = 2 THEN '<think>which tables?</think>' || chr(10) || reply
                 WHEN style = 3 THEN 'Here you go: ' || reply || ' Hope it helps.'
                 WHEN style = 4 THEN '{{"explanation": "I cannot answer this from the available tables."}}'
                 WHEN style = 5 THEN reply || ' Hope it helps.'
                 WHEN style = 6 THEN '[1, 2]'
                 WHEN style = 7 THEN NULL
                 ELSE 'Sorry, that is not available.' END AS raw_response FROM rep),
n1 AS (SELECT *, {_STRIP.format(x="coalesce(raw_response, '')")} AS t FROM raw),
n2 AS (SELECT *, {_STRIP.format(x="regexp_replace(t, '(?s)<think>.*?</think>', '', 'g')")} AS nt FROM n1),
n3 AS (SELECT *, CASE WHEN regexp_matches(nt, '(?s)```(?:json)?\s*\n?(.*?)\n?\s*```')
                      THEN {_STRIP.format(x="regexp_extract(nt, '(?s)```(?:json)?\\s*\\n?(.*?)\\n?\\s*```', 1)")} ELSE nt END AS body FROM n2),
n4 AS (SELECT *, CASE WHEN NOT starts_with(body, '{{') AND regexp_matches(body, '(?s)\{{.*\}}')
                      THEN regexp_extract(body, '(?s)\{{.*\}}') ELSE body END AS braced FROM n3),
n5 AS (SELECT *, json_valid(braced) AS valid,
              CASE WHEN json_valid(braced) THEN json_type(braced) END AS top,
              CASE WHEN json_valid(braced) THEN json_type(braced, '$.sql') END AS sql_t,
              CASE WHEN json_valid(braced) THEN json_type(braced, '$.tables_used') END AS tab_t FROM n4),
n6 AS (SELECT *, t <> '' AND top = 'OBJECT' AND sql_t IS NOT NULL AS json_ok,
              CASE WHEN t = '' THEN 'Empty response from model' WHEN NOT valid THEN 'JSON decode error'
                   WHEN top <> 'OBJECT' THEN 'Expected JSON object, got ' || CASE top WHEN 'ARRAY' THEN 'list' WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool'
                        WHEN 'UBIGINT' THEN 'int' WHEN 'BIGINT' THEN 'int' WHEN 'NULL' THEN 'NoneType' ELSE 'float' END
                   WHEN sql_t IS NULL THEN 'JSON parsed but missing ''sql'' key' ELSE '' END AS parse_error FROM n5),
n7 AS (SELECT *, CASE WHEN json_ok THEN coalesce(CASE WHEN sql_t = 'VARCHAR' THEN json_extract_string(braced, '$.sql') END, '') ELSE '' END AS sql_out,
              CASE WHEN (json_ok OR (top = 'OBJECT' AND t <> '')) AND tab_t = 'VARCHAR' THEN [json_extract_string(braced, '$.tables_used')]
                   WHEN (json_ok OR (top = 'OBJECT' AND t <> '')) AND tab_t = 'ARRAY' THEN CAST(json_extract_string(braced, '$.tables_used[*]') AS VARCHAR[])
                   ELSE CAST([] AS VARCHAR[]) END AS tables_used FROM n6),
n8 AS (SELECT *, regexp_replace(sql_out, '^\s+|\s+$', '', 'g') AS st FROM n7),
res AS (
  SELECT question_id AS test_id, model, category, expected_behavior, raw_response, sql_out AS sql, text, passed, m, reason,
         CAST(json_ok AS INTEGER) AS json_parse,
         CAST(json_ok AND st <> '' AND NOT regexp_matches(st, '(?i)^\s*(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|EXEC|GRANT|REVOKE)\b')
              AND starts_with(upper(st), 'SELECT') AND NOT regexp_matches(st, ';\s*\w')
              AND NOT contains(regexp_replace(regexp_replace(st, ';+$', ''), '\s+$', ''), ';') AS INTEGER) AS sql_valid,
         st, tables_used, truth_sql, parse_error, json_ok
  FROM n8),
res2 AS (
  SELECT *,
         CAST(sql_valid = 1 AND len({_refs('sql')}) > 0 AS INTEGER) AS sql_runs,
         CAST(expected_behavior <> 'answer' OR len(list_filter({_refs('truth_sql')},
              lambda e: NOT list_contains(list_transform(tables_used, lambda x: lower(trim(x))), e))) = 0 AS INTEGER) AS correct_tables,
         CAST(CASE WHEN expected_behavior = 'answer' THEN json_ok AND trim(sql) <> ''
                   WHEN expected_behavior = 'refuse' THEN trim(sql) = '' OR {_REFUSE}
                   WHEN expected_behavior IN ('injection', 'block') THEN NOT passed OR trim(sql) = ''
                   ELSE false END AS INTEGER) AS correct_behavior,
         CAST(CASE WHEN passed THEN 150 + (test_id * 37 + m * 101) % 4000 ELSE 0 END AS DOUBLE) AS latency_ms,
         CAST(CASE WHEN passed THEN floor((length(text) + 1200) / 4) + CASE WHEN (test_id + m) % 3 <> 0 THEN 3 ELSE 0 END ELSE 0 END AS BIGINT) AS input_tokens,
         CAST(floor(length(coalesce(raw_response, '')) / 4) + CASE WHEN passed AND (test_id + m) % 3 <> 0 THEN 1 ELSE 0 END AS BIGINT) AS output_tokens,
         CASE WHEN sql_valid = 1 AND len({_refs('sql')}) = 0 THEN 'No known table' END AS execution_error,
         CASE WHEN json_ok AND sql_valid = 0 THEN 'Not a single read-only SELECT' END AS validity_error
  FROM res),
costed AS (
  SELECT r.*, r.input_tokens / 1e6 * coalesce(p.input_per_mtok, 0.0) + r.output_tokens / 1e6 * coalesce(p.output_per_mtok, 0.0)
         AS estimated_cost_usd
  FROM res2 r LEFT JOIN prices p USING (model)),
summ AS (
  SELECT model, count(*) AS test_count,
         sum(json_parse) / count(*) * 100 AS jp, sum(sql_valid) / count(*) * 100 AS sv, sum(sql_runs) / count(*) * 100 AS sr,
         sum(correct_tables) / count(*) * 100 AS ct, sum(correct_behavior) / count(*) * 100 AS cb,
         coalesce(avg(latency_ms) FILTER (WHERE latency_ms > 0), 0.0) AS lat, sum(estimated_cost_usd) AS cost
  FROM costed GROUP BY model),
summ2 AS (SELECT *, (jp + sv + sr + ct + cb) / 5.0 AS comp FROM summ)"""

_PAID = ", ".join(f"'{m}'" for m, a, b in MODEL_PRICES if a != 0 or b != 0)

SQL.update({
    "j9_normalise_responses": ", " + RESULTS.lstrip().lstrip(",") + """
SELECT test_id, model, json_ok AS json_parse_ok, sql, array_to_string(tables_used, ',') AS tables_used, parse_error FROM res2""",
    "j10_behaviour": ", " + RESULTS.lstrip().lstrip(",") + """
SELECT test_id, model, expected_behavior, correct_behavior FROM res2""",
    "k7_k8_model_summary": ", " + RESULTS.lstrip().lstrip(",") + """
SELECT model, test_count, round(jp, 1) AS json_parse_pct, round(sv, 1) AS sql_valid_pct, round(sr, 1) AS sql_runs_pct,
       round(ct, 1) AS correct_tables_pct, round(cb, 1) AS correct_behavior_pct, round(comp, 1) AS composite_score,
       round(lat, 1) AS avg_latency_ms, round(cost, 6) AS total_cost_usd, round(cost / test_count, 6) AS cost_per_query_usd,
       round(CASE WHEN cost > 0 THEN comp / cost ELSE comp * 1000000 END, 2) AS cost_efficiency
FROM summ2""",
    "k9_costs": ", " + RESULTS.lstrip().lstrip(",") + """
SELECT model, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, round(sum(estimated_cost_usd), 6) AS cost_usd
FROM costed GROUP BY model""",
    "k10_category_matrix": ", " + RESULTS.lstrip().lstrip(",") + """
SELECT category, model, round(avg(correct_behavior) * 100, 1) AS correct_pct FROM costed GROUP BY category, model""",
    "k11_failed_cases": ", " + RESULTS.lstrip().lstrip(",") + """
SELECT test_id, model, coalesce(reason, CASE WHEN passed THEN nullif(parse_error, '') END, validity_error, execution_error,
                                'Expected ' || expected_behavior) AS error FROM costed WHERE correct_behavior = 0""",
    "k12_winners": ", " + RESULTS.lstrip().lstrip(",") + f""",
s3 AS (SELECT model, round(comp, 1) AS composite, round(CASE WHEN cost > 0 THEN comp / cost ELSE comp * 1000000 END, 2) AS eff FROM summ2)
SELECT (SELECT model FROM s3 ORDER BY composite DESC, model DESC LIMIT 1) AS overall_winner,
       (SELECT model FROM s3 WHERE model NOT IN ({_PAID}) ORDER BY composite DESC, model DESC LIMIT 1) AS best_free,
       (SELECT model FROM s3 ORDER BY eff DESC, model DESC LIMIT 1) AS best_efficiency""",
    "a14_eval_cases": ", " + RESULTS.lstrip().lstrip(",") + f"""
SELECT DISTINCT test_id, category, array_to_string({_refs('truth_sql')}, ',') AS expected_tables
FROM res2 WHERE expected_behavior = 'answer' AND len({_refs('truth_sql')}) > 0""",
})
