"""Model replies for the evaluation jobs: a fixture, derived from the questions
and the SQL log by key arithmetic (no model is called). Reply texts come as
bare, fenced, thought-prefixed and wrapped JSON, JSON with trailing text, JSON
of another type, and refusals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import screens as S

#: one is priced, one is unknown to the price table
MODELS = ["openrouter/qwen/qwen3-coder", "google/gemini-2.5-flash", "openrouter/deepseek/deepseek-chat",
          "openrouter/anthropic/claude-sonnet-4", "local/unpriced-model"]
CATEGORIES = ["simple_count", "two_table_join", "aggregation", "time_filter"]
BLOCKING = ["Input contains potentially dangerous SQL patterns.", "Input contains prompt injection patterns.",
            "This is a read-only analytics system. Data modification (drop, delete, update) is not supported."]


def model_replies(wh) -> DataFrame:
    """One row per (question, model), as ``score_replies`` takes them."""
    asked = S.screen_questions(S.with_intent(wh.questions.withColumn("question", F.col("text"))))
    n_log = wh.sql_log.count()
    q = (asked.withColumn("expected_behavior", F.when(F.col("reason").isin(*BLOCKING), "block")
                          .when(~F.col("passed") | (F.col("intent") != "sql_query"), "refuse").otherwise("answer"))
         .withColumn("category", F.when(F.col("expected_behavior") == "block", "injection")
                     .when(F.col("expected_behavior") == "refuse", "unanswerable")
                     .otherwise(F.element_at(F.array(*[F.lit(c) for c in CATEGORIES]),
                                             (F.col("question_id") % 4 + 1).cast("int"))))
         .select("question_id", F.col("question").alias("text"), "passed", "reason", "expected_behavior", "category",
                 F.posexplode(F.array(*[F.lit(m) for m in MODELS])).alias("m", "model")))
    log = wh.sql_log.select("query_id", "sql")
    answer = log.select(F.col("query_id").alias("answer_key"), F.col("sql").alias("model_sql"))
    truth = log.select(F.col("query_id").alias("truth_key"), F.col("sql").alias("truth_sql"))
    # a key without a log row keeps its question, with empty SQL
    r = (q.withColumn("answer_key", F.expr(f"try_mod(question_id * 7 + m * 13, {n_log}L)"))
         .withColumn("truth_key", F.expr(f"try_mod(question_id, {n_log}L)"))
         .join(answer, "answer_key", "left").join(truth, "truth_key", "left").fillna("", ["model_sql", "truth_sql"]))
    reply = F.to_json(F.struct(F.col("model_sql").alias("sql"), F.lit("generated").alias("explanation"),
                               S.referenced_tables(F.col("model_sql")).alias("tables_used")))
    style = (F.col("question_id") + F.col("m")) % 9
    raw = (F.when(~F.col("passed"), F.lit(""))
           .when(style == 0, reply)
           .when(style == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```")))
           .when(style == 2, F.concat(F.lit("<think>which tables?</think>\n"), reply))
           .when(style == 3, F.concat(F.lit("Here you go: "), reply, F.lit(" Hope it helps.")))
           .when(style == 4, F.lit('{"explanation": "I cannot answer this from the available tables."}'))
           .when(style == 5, F.concat(reply, F.lit(" Hope it helps.")))
           .when(style == 6, F.lit("[1, 2]"))
           .when(style == 7, F.lit(None).cast("string"))
           .otherwise(F.lit("Sorry, that is not available.")))
    took = F.when(F.col("passed"), 150 + (F.col("question_id") * 37 + F.col("m") * 101) % 4000).otherwise(0)
    prompt = F.when(F.col("passed"), F.length("text") + 1200).otherwise(0).cast("bigint")
    counted = F.col("passed") & ((F.col("question_id") + F.col("m")) % 3 != 0)  # the others report no tokens
    r = r.withColumn("raw_response", raw)
    return r.select("question_id", "text", "model", "category", "expected_behavior", F.col("reason").alias("guardrail_reason"),
                    "truth_sql", "raw_response", took.cast("double").alias("latency_ms"),
                    prompt.alias("prompt_chars"), F.when(counted, F.floor(prompt / 4) + 3).cast("bigint").alias("input_tokens"),
                    F.when(counted, F.floor(F.length(F.coalesce("raw_response", F.lit(""))) / 4) + 1).cast("bigint").alias("output_tokens"))
