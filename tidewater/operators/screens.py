"""Text and query-log screens as column expressions over tables.

Every rule is a JVM-side ``rlike`` / string expression; a whole table of
questions, SQL texts or answers is screened in one projection, no UDFs.
Java regex gets ``(?U)`` so ``\\b``, ``\\w`` and ``\\s`` are Unicode-aware like
Python's ``re`` on ``str``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.config import KNOWN_TABLES, SETTINGS
from tidewater.functions import bound

# --- fixed values: question screen patterns, in checking order ---
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
# --- fixed values: read-only SQL check ---
DML_PATTERN = r"^\s*(INSERT|UPDATE|DELETE|DROP|ALTER|CREATE|TRUNCATE|EXEC|GRANT|REVOKE)\b"
MULTI_STATEMENT_PATTERN = r";\s*\w"
# --- fixed values: answer grounding claims ---
DATA_CLAIM_PATTERNS = [
    r"the data shows",
    r"according to the (results|data|query)",
    r"the (results|query) (show|indicate|reveal)",
    r"there are \d+",
    r"the (total|average|sum|count) is",
]
# --- fixed values: declared secondary indexes per table (plus each table's id) ---
INDEXED_COLUMNS = {
    "customers": ["industry", "country", "tier"],
    "shipments": ["customer_id", "carrier_id", "status", "mode", "origin_country", "destination_country",
                  "booking_date", "commodity"],
    "shipment_charges": ["shipment_id", "charge_type"],
    "tracking_events": ["shipment_id", "event_type", "event_timestamp"],
    "invoices": ["shipment_id", "customer_id", "payment_status", "invoice_date"],
    "extracted_documents": ["document_type", "review_status", "linked_shipment_id"],
    "carriers": [],
}
# --- fixed values: rule-based intent greetings ---
GREETINGS = ["hi", "hello", "hey", "thanks", "thank you", "bye"]
# --- fixed values: pitfall messages (severity, message, suggestion) ---
PITFALLS = {
    "not_in": ("warning", "NOT IN can return unexpected results if the subquery contains NULL values.",
               "Consider using NOT EXISTS instead: WHERE NOT EXISTS (SELECT 1 FROM ... WHERE ...)"),
    "union": ("warning", "UNION removes duplicates (slow). If duplicates aren't a concern, use UNION ALL.",
              "Change UNION to UNION ALL unless you specifically need deduplication."),
    "agg_no_group": ("error", "Multiple columns in SELECT with aggregate functions but no GROUP BY clause.",
                     "Add GROUP BY for all non-aggregated columns in the SELECT."),
    "select_star_join": ("warning", "SELECT * with JOINs can cause ambiguous column names.",
                         "Specify explicit columns: SELECT t1.col1, t2.col2 instead of SELECT *."),
    "having_no_group": ("error", "HAVING clause without GROUP BY doesn't make sense.",
                        "Add GROUP BY before HAVING, or move the condition to WHERE."),
}


def _ci(pattern: str) -> str:
    return "(?iduU)" + pattern  # d: only a newline ends what a dot matches


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _matches(text: Column, patterns: list[str]) -> Column:
    """Array of the patterns (as written) that match, in order."""
    hits = F.array(*[F.when(text.rlike(_ci(p)), F.lit(p)) for p in patterns])
    return F.filter(hits, lambda x: x.isNotNull())


def screen_questions(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """First failing check wins; ``matched_patterns`` lists what fired."""
    t = _strip(F.col(text_col))
    limit = SETTINGS.max_input_length
    staged = (questions.withColumn("_t", t)
              .withColumn("_sql", _matches(F.col("_t"), SQL_INJECTION_PATTERNS))
              .withColumn("_destr", F.slice(_matches(F.col("_t"), DESTRUCTIVE_INTENT_PATTERNS), 1, 1))
              .withColumn("_prompt", _matches(F.col("_t"), PROMPT_INJECTION_PATTERNS)))
    reason = (F.when(F.col("_t") == "", F.lit("Input is empty."))
              .when(F.length("_t") <= 1, F.lit("Input is too short. Please enter a meaningful question."))
              .when(F.length("_t") > limit, F.concat(F.lit("Input is too long ("), F.length("_t").cast("string"),
                                                     F.lit(f" chars). Maximum is {limit} characters.")))
              .when(F.size("_sql") > 0, F.lit("Input contains potentially dangerous SQL patterns."))
              .when(F.size("_destr") > 0, F.lit("This is a read-only analytics system. Data modification "
                                                "(drop, delete, update) is not supported."))
              .when(F.size("_prompt") > 0, F.lit("Input contains prompt injection patterns.")))
    matched = (F.when((F.col("_t") == "") | (F.length("_t") <= 1) | (F.length("_t") > limit),
                      F.array().cast("array<string>"))
               .when(F.size("_sql") > 0, F.col("_sql")).when(F.size("_destr") > 0, F.col("_destr"))
               .otherwise(F.col("_prompt")))
    return staged.select(*[c for c in questions.columns if c != text_col],
                         reason.isNull().alias("passed"), reason.alias("reason"),
                         F.array_join(matched, "\n").alias("matched_patterns"),
                         F.when(reason.isNull(), F.col("_t")).alias("sanitized_input"))


def check_readonly_sql(log: DataFrame, sql_col: str = "sql") -> DataFrame:
    """J2 + J3: read-only check; passing texts without LIMIT are flagged ``uncapped``."""
    s = _strip(F.coalesce(F.col(sql_col), F.lit("")))
    head = F.concat(F.substring("_s", 1, 50), F.lit("..."))
    no_trailing = F.regexp_replace(F.regexp_replace("_s", ";+$", ""), r"(?U)\s+$", "")
    reason = (F.when(F.col("_s") == "", F.lit("Empty SQL query."))
              .when(F.col("_s").rlike(_ci(DML_PATTERN)), F.concat(F.lit("Dangerous SQL operation detected: "), head))
              .when(~F.upper("_s").startswith("SELECT"), F.concat(F.lit("Only SELECT queries are allowed. Got: "), head))
              .when(F.col("_s").rlike(_ci(MULTI_STATEMENT_PATTERN)), F.lit("Multi-statement queries are not allowed."))
              .when(F.contains(no_trailing, F.lit(";")), F.lit("Multiple SQL statements detected")))
    return (log.withColumn("_s", s)
            .select("query_id", reason.isNull().alias("passed"), reason.alias("reason"),
                    (reason.isNull() & ~F.contains(F.upper("_s"), F.lit("LIMIT"))).alias("uncapped")))


def lint_sql(log: DataFrame, sql_col: str = "sql") -> DataFrame:
    """Pitfall warnings; one row per query with its messages in rule order."""
    u = F.upper(F.col(sql_col))
    has_group = F.contains(u, F.lit("GROUP BY"))
    select_clause = F.regexp_extract(u, r"(?s)SELECT\s+(.*?)\s+FROM", 1)
    has_agg = u.rlike(r"\b(COUNT|SUM|AVG|MAX|MIN)\s*\(")
    # a JOIN counts only when its table is followed by whitespace, as in the reference
    # the per-table pattern is built per row, so it is only evaluated where the rule can fire
    candidate = F.contains(u, F.lit("JOIN")) & ~F.contains(u, F.lit("ON"))
    tables = F.when(candidate, F.regexp_extract_all(
        u, F.lit(r"\bJOIN\s+(\w+)\s*(?:\w+\s*)?(?=JOIN|WHERE|GROUP|ORDER|LIMIT|$)"), 1))
    hit_tables = F.coalesce(F.filter(tables, lambda t: F.regexp_like(u, F.concat(F.lit(r"JOIN\s+"), t, F.lit(r"\s+")))),
                            F.array().cast("array<string>"))

    def w(key: str, cond: Column) -> Column:
        sev, msg, fix = PITFALLS[key]
        return F.when(cond, F.struct(F.lit(sev).alias("severity"), F.lit(msg).alias("message"), F.lit(fix).alias("suggestion")))

    no_on = F.when((F.size(hit_tables) > 0) & ~F.contains(u, F.lit("ON")), F.struct(
        F.lit("error").alias("severity"),
        F.concat(F.lit("JOIN with "), F.element_at(hit_tables, 1), F.lit(" appears to be missing an ON clause."))
        .alias("message"),
        F.concat(F.lit("Add ON clause: JOIN "), F.element_at(hit_tables, 1), F.lit(" ON <condition>")).alias("suggestion")))
    found = F.array(
        w("not_in", u.rlike(r"NOT\s+IN\s*\(")),
        w("union", u.rlike(r"\bUNION\b(?!\s+ALL)")),
        w("agg_no_group", has_agg & ~has_group & F.contains(select_clause, F.lit(","))
          & u.rlike(r"(?s)SELECT\s+(.*?)\s+FROM")),
        no_on,
        w("select_star_join", F.contains(u, F.lit("SELECT *")) & F.contains(u, F.lit("JOIN"))),
        w("having_no_group", F.contains(u, F.lit("HAVING")) & ~has_group))
    def summary(kept: Column) -> Column:
        return F.struct(
            F.size(F.filter(kept, lambda x: x["severity"] == "error")).alias("errors"), F.size(kept).alias("warnings"),
            *[F.array_join(F.transform(kept, lambda x: x[part]), " | ").alias(name)
              for part, name in (("message", "messages"), ("severity", "severities"), ("suggestion", "suggestions"))])

    found_once = bound(F.filter(found, lambda x: x.isNotNull()), summary)  # the rules run once a row
    return log.select("query_id", found_once.alias("found")).select("query_id", "found.*")


def referenced_tables(sql: Column) -> Column:
    """Known tables after FROM / JOIN, lower-cased, first-seen order."""
    words = F.transform(F.regexp_extract_all(sql, F.lit(r"(?i)(?:FROM|JOIN)\s+(\w+)"), 1), lambda x: F.lower(x))
    known = F.array(*[F.lit(t) for t in KNOWN_TABLES])
    return F.array_distinct(F.filter(words, lambda x: F.array_contains(known, x)))


def scan_budget(log: DataFrame, row_counts: DataFrame, threshold: int = SETTINGS.full_scan_row_threshold) -> DataFrame:
    """(query, table) pairs that would scan a table above the row threshold.

    A text audit standing in for the reference's EXPLAIN check: a table is
    "searched" when the WHERE clause names its id or one of its indexed
    columns, otherwise "scanned". ``row_counts`` (A6) has one row per known
    table, so that join side is bounded by the catalogue.
    """
    idx = F.create_map(*[x for t, cols in INDEXED_COLUMNS.items()
                         for x in (F.lit(t), F.array(*[F.lit(c) for c in ["id", *cols]]))])
    refs = log.select("query_id", F.regexp_extract("sql", r"(?is)\bWHERE\b(.*)$", 1).alias("where_text"),
                      F.explode(referenced_tables(F.col("sql"))).alias("table_name"))
    searched = F.exists(F.element_at(idx, F.col("table_name")),
                        lambda c: F.regexp_like(F.col("where_text"), F.concat(F.lit(r"(?i)\b"), c, F.lit(r"\b"))))
    j = refs.join(row_counts, "table_name")
    return (j.filter((F.col("row_count") > threshold) & ~searched)
            .select("query_id", "table_name", "row_count"))


def ground_answers(answers: DataFrame) -> DataFrame:
    """An empty result with an answer that claims data fails."""
    claims = _matches(F.col("answer"), DATA_CLAIM_PATTERNS)
    failed = (F.col("result_rows") == 0) & (F.size(claims) > 0)
    return answers.select("answer_id", (~failed).alias("passed"),
                          F.when(failed, F.element_at(claims, 1)).alias("blocked_pattern"))


def with_intent(questions: DataFrame, text_col: str = "text") -> DataFrame:
    """Greeting -> general; shorter than 5 -> clarification; else sql_query."""
    q = F.lower(_strip(F.col(text_col)))
    intent = (F.when(q.isin(*GREETINGS), "general").when(F.length(q) < 5, "clarification")
              .otherwise("sql_query"))
    return questions.withColumn("intent", intent)


def rule_intent(questions: DataFrame, text_col: str = "text") -> DataFrame:
    return with_intent(questions, text_col).select("question_id", "intent")
