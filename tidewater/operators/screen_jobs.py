"""Screens and catalogue jobs bound to the warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.operators import screens as S
from tidewater.sources import catalog as C


def j1_question_screen(wh) -> DataFrame:
    return S.screen_questions(wh.questions).drop("sanitized_input")


def j2_readonly_sql(wh) -> DataFrame:
    return S.check_readonly_sql(wh.sql_log)


def j4_pitfall_lint(wh) -> DataFrame:
    return S.lint_sql(wh.sql_log)


def j5_referenced_tables(wh) -> DataFrame:
    return wh.sql_log.select("query_id", F.array_join(S.referenced_tables(F.col("sql")), ",").alias("tables"))


def j6_scan_budget(wh) -> DataFrame:
    return S.scan_budget(wh.sql_log, C.row_counts(wh))


def j7_answer_grounding(wh) -> DataFrame:
    return S.ground_answers(wh.answers)


def j8_rule_intent(wh) -> DataFrame:
    return S.rule_intent(wh.questions)


def a2_parameterised_select(wh, country: str = "NATION_7", min_delay: int = 5) -> DataFrame:
    """A2: a parameterised read; values are bound, never spliced into the text."""
    return wh.spark.sql(
        "SELECT shipment_id, status, delay_days FROM shipments "
        "WHERE origin_country = :country AND delay_days > :min_delay",
        args={"country": country, "min_delay": min_delay})


def a6_row_counts(wh) -> DataFrame:
    return C.row_counts(wh)


def a7_table_profile(wh) -> DataFrame:
    return C.table_profile(wh.spark, wh)


def a9_value_profile(wh) -> DataFrame:
    return C.value_profile(wh)
