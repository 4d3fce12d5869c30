"""Retrieval and evaluation jobs bound to the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import evaluation as E
from tidewater.sources.replies import model_replies


def _collection(wh) -> DataFrame:
    return wh.memo("knowledge_collection", lambda: E.knowledge_collection(wh.embeddings))


def _hits(wh) -> DataFrame:
    return wh.memo("retrieval_hits", lambda: E.nearest_documents(wh.embeddings, _collection(wh)))


def _scores(wh) -> DataFrame:
    return E.question_scores(E.retrieved_tables(_hits(wh)))


def prices(wh) -> DataFrame:
    return wh.spark.createDataFrame(E.MODEL_PRICES, "model string, input_per_mtok double, output_per_mtok double")


def costed(wh) -> DataFrame:
    return wh.memo("eval_results", lambda: E.with_cost(E.score_replies(model_replies(wh)), prices(wh)))


def k1_nearest_documents(wh) -> DataFrame:
    return _hits(wh).select("model", "vec_id", "rank", "doc_id")


def k1_nearest_examples(wh) -> DataFrame:
    """The second collection: three worked examples per question."""
    examples = wh.memo("example_collection", lambda: E.example_collection(wh.embeddings))
    return E.nearest_documents(wh.embeddings, examples, k=3).select("model", "vec_id", "rank", "doc_id")


def k1_similar_vectors(wh) -> DataFrame:
    """The vectors themselves as the collection: every twentieth is a question,
    its five nearest among all others and itself."""
    none = F.lit(None).cast("string")
    stored = wh.embeddings.select(F.concat(F.lit("vec_"), F.col("vec_id").cast("string")).alias("doc_id"), F.col("embedding").alias("vec"),
                                  F.col("label").cast("string").alias("table"), none.alias("from_table"), none.alias("to_table"))
    asked = wh.embeddings.filter("vec_id % 20 = 0")
    return E.nearest_documents(asked, stored).select("model", "vec_id", "rank", "doc_id")


def k2_retrieved_tables(wh) -> DataFrame:
    r = E.retrieved_tables(_hits(wh))
    return r.select("model", "vec_id", F.array_join("retrieved", ",").alias("retrieved"))


def k3_question_scores(wh) -> DataFrame:
    return _scores(wh).select("model", "vec_id", "hit", "precision", "reciprocal_rank")


def k4_k6_model_summary(wh) -> DataFrame:
    return E.model_retrieval_summary(_scores(wh))


def k5_category_recall(wh) -> DataFrame:
    return E.category_recall(_scores(wh))


def j9_normalise_responses(wh) -> DataFrame:
    c = costed(wh)
    p = E.normalise_model_response(F.col("raw_response"))
    return c.select("test_id", "model", p["json_parse_ok"].alias("json_parse_ok"), p["sql"].alias("sql"),
                    F.array_join(p["tables_used"], ",").alias("tables_used"), p["parse_error"].alias("parse_error"))


def j10_behaviour(wh) -> DataFrame:
    return costed(wh).select("test_id", "model", "expected_behavior", "correct_behavior")


def k7_k8_model_summary(wh) -> DataFrame:
    return E.model_summary(costed(wh))


def k9_costs(wh) -> DataFrame:
    return costed(wh).groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"),
                                            F.sum("output_tokens").alias("output_tokens"),
                                            F.round(F.sum("estimated_cost_usd"), 6).alias("cost_usd"))


def k10_category_matrix(wh) -> DataFrame:
    return E.category_matrix(costed(wh))


def k11_failed_cases(wh) -> DataFrame:
    return E.failed_cases(costed(wh))


def k12_winners(wh) -> DataFrame:
    return E.winners(E.model_summary(costed(wh)), prices(wh))


def a14_eval_cases(wh) -> DataFrame:
    return E.eval_cases(costed(wh))
