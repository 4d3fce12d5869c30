"""Named queries: inventory id -> function of a Warehouse returning a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewater.operators import document_jobs as DJ
from tidewater.operators import evaluation_jobs as EJ
from tidewater.operators import quality as Q
from tidewater.operators import relational as R
from tidewater.operators import screen_jobs as SJ
from tidewater.operators import store_jobs as ST
from tidewater.sources.tables import Warehouse

QueryFn = Callable[[Warehouse], DataFrame]

RELATIONAL: dict[str, QueryFn] = {
    "b1_projection": R.b1_projection,
    "b2_eq_filter": R.b2_delayed_shipments,
    "b3_numeric_filter": R.b3_heavy_shipments,
    "b4_conjunction": R.b4_delivered_air,
    "b5_null_checks": R.b5_null_checks,
    "b6_not_equal": R.b6_invoices_not_cancelled,
    "b7_boolean_flag": R.b7_milestone_events,
    "b8_month_range": R.b8_booked_in_month,
    "b9_calendar_periods": R.b9_calendar_periods,
    "b10_relative_periods": R.b10_relative_periods,
    "b11_past_due": R.b11_past_due_pending,
    "b12_date_diff": R.b12_paid_within_30,
    "b13_column_compare": R.b13_early_arrivals,
    "b14_distinct": R.b14_distinct_routes,
    "b15_in_list": R.b15_in_list,
    "b16_in_subquery": R.b16_in_subquery,
    "b17_name_match": R.b17_name_match,
    "b18_point_hit": R.b18_point_hit,
    "b18_point_lookup": R.b18_point_lookup,
    "b19_json_filter": R.b19_json_field_filter,
    "c1_two_table_join": R.c1_shipments_per_carrier,
    "c2_three_table_join": R.c2_avg_freight_by_carrier,
    "c3_four_table_join": R.c3_four_table,
    "c4_carrier_performance": R.carrier_performance,
    "c5_without_events": R.c5_shipments_without_events,
    "c5_without_shipments": R.c5_customers_without_shipments,
    "c5_anti_join": R.c5_shipments_without_invoice,
    "c6_semi_join": R.c6_customers_with_cancellations,
    "c7_document_shipment_join": R.c7_documents_with_shipments,
    "c8_extracted_vs_actual": R.c8_extracted_vs_actual,
    "c9_document_timeline": R.c9_document_timeline,
    "c10_document_carrier": R.c10_document_carrier,
    "c11_documents_delayed": R.c11_documents_of_delayed,
    "c12_fanout_measures": R.c12_customer_fanout,
    "d1_count": R.d1_count_all,
    "d2_count_by_group": R.d2_count_by_status,
    "d3_global_aggregates": R.d3_invoice_stats,
    "d4_grouped_measures": R.d4_cost_breakdown,
    "d5_multi_key_group": R.d5_commodity_mode,
    "d6_count_distinct": R.d6_count_distinct,
    "d7_conditional_rate": R.d7_delay_rate_by_carrier,
    "d8_nullif_rate": R.d8_ontime_by_mode,
    "d9_ratio_of_sums": R.d9_cost_per_kg,
    "d10_having": R.d10_route_delay_having,
    "d11_group_by_alias": R.d11_monthly_and_quarterly,
    "d12_bare_columns": R.d12_bare_columns,
    "d13_two_level_aggregate": R.d13_two_level,
    "d14_percentage_of_total": R.d14_pct_delayed,
    "d15_rate_comparison": R.d15_cancellation_by_priority,
    "d16_two_group_comparison": R.d16_ocean_vs_air,
    "d17_year_over_year": R.d17_year_over_year,
    "d18_monthly_average": R.d18_monthly_avg_in_year,
    "d19_empty_aggregate": R.d19_empty_average,
    "d20_join_group": R.d20_spend_by_industry,
    "d21_three_join_filter": R.d21_gold_freight_by_carrier_type,
    "e1_latest_per_key": R.e1_latest_event,
    "e2_transit_time": R.e2_transit_hours,
    "e3_recent_turns": R.e3_recent_turns,
    "f1_top_n_groups": R.f1_top_carriers,
    "f2_top_n_rows": R.f2_heaviest,
    "f3_cheapest_carrier_type": R.f3_cheapest_carrier_type,
    "f3_arg_extremes": R.f3_arg_extremes,
    "f4_chronological": R.f4_monthly_trend,
    "f5_default_cap": R.f5_default_cap,
    "h6_json_extract": R.h6_json_extract,
    "h_scalar_functions": R.h_scalar_functions,
    "h12_cut_text": R.h12_cut_text,
}

DOCUMENTS: dict[str, QueryFn] = {
    "i1_i2_parse_status": DJ.i1_i2_parse_status,
    "i3_lenient_check": DJ.i3_lenient_check,
    "i4_long_fields": DJ.i4_long_fields,
    "i6_overall_confidence": DJ.i6_overall_confidence,
    "i9_review_summary": DJ.i9_review_summary,
    "i10_rule_warnings": DJ.i10_rule_warnings,
    "i15_completeness": DJ.i15_completeness,
    "i16_auto_link": DJ.i16_auto_link,
    "i17_notes": DJ.i17_notes,
    "i18_review_merge": DJ.i18_review_merge,
    "i18_unknown_reviews": DJ.i18_unknown_reviews,
    "i19_manual_link": DJ.i19_manual_link,
    "i19_unknown_links": DJ.i19_unknown_links,
    "i18_stored_reviews": ST.i18_stored_reviews,
    "i19_stored_links": ST.i19_stored_links,
    "i20_field_registry": DJ.i20_field_registry,
    "i21_confidence_bands": DJ.i21_confidence_bands,
    "i22_type_rollup": DJ.i22_type_rollup,
    "i23_bol_fields": DJ.i23_bol_fields,
    "i23_packing_fields": DJ.i23_packing_fields,
    "i23_customs_fields": DJ.i23_customs_fields,
    "i23_invoice_fields": DJ.i23_invoice_fields,
    "i23_parties": DJ.i23_parties,
    "i24_typed_threshold": DJ.i24_high_confidence_invoices,
    "m1_stream_ingest": DJ.m1_stream_ingest,
    "m1_field_registry": DJ.m1_field_registry,
}

SCREENS: dict[str, QueryFn] = {
    "j1_question_screen": SJ.j1_question_screen,
    "j2_j3_readonly_sql": SJ.j2_readonly_sql,
    "j4_pitfall_lint": SJ.j4_pitfall_lint,
    "j5_referenced_tables": SJ.j5_referenced_tables,
    "j6_scan_budget": SJ.j6_scan_budget,
    "j7_answer_grounding": SJ.j7_answer_grounding,
    "j8_rule_intent": SJ.j8_rule_intent,
}

CATALOG: dict[str, QueryFn] = {
    "a2_parameterised_select": SJ.a2_parameterised_select,
    "a13_upload_screening": ST.a13_upload_screening,
    "a3_table_names": ST.a3_table_names,
    "a4_column_metadata": ST.a4_column_metadata,
    "a5_foreign_keys": ST.a5_foreign_keys,
    "a7_schema_text": ST.a7_schema_text,
    "a10_append": ST.a10_append,
    "a11_list_documents": ST.a11_list_documents,
    "a12_get_document": ST.a12_get_document,
    "l5_quarantine": ST.l5_quarantine,
    "a15_result_sink": ST.a15_result_sink,
    "a6_row_counts": SJ.a6_row_counts,
    "a7_table_profile": SJ.a7_table_profile,
    "a9_value_profile": SJ.a9_value_profile,
}

QUALITY: dict[str, QueryFn] = {
    "l1_row_count_expectations": Q.l1_row_count_expectations,
    "l2_orphan_keys": Q.l2_orphan_keys,
    "l3_coverage": Q.l3_coverage,
    "l4_unique_keys": Q.l4_unique_keys,
    "l5_conditional_not_null": Q.l5_conditional_not_null,
    "l6_distribution_order": Q.l6_distribution_order,
    "l7_invoice_reconciliation": Q.l7_invoice_reconciliation,
}

EVALUATION: dict[str, QueryFn] = {
    "k1_nearest_examples": EJ.k1_nearest_examples,
    "k1_similar_vectors": EJ.k1_similar_vectors,
    "k1_nearest_documents": EJ.k1_nearest_documents,
    "k2_retrieved_tables": EJ.k2_retrieved_tables,
    "k3_question_scores": EJ.k3_question_scores,
    "k4_k6_retrieval_summary": EJ.k4_k6_model_summary,
    "k5_category_recall": EJ.k5_category_recall,
    "j9_normalise_responses": EJ.j9_normalise_responses,
    "j10_behaviour": EJ.j10_behaviour,
    "k7_k8_model_summary": EJ.k7_k8_model_summary,
    "k9_costs": EJ.k9_costs,
    "k10_category_matrix": EJ.k10_category_matrix,
    "k11_failed_cases": EJ.k11_failed_cases,
    "k12_winners": EJ.k12_winners,
    "a14_eval_cases": EJ.a14_eval_cases,
}

REGISTRY: dict[str, QueryFn] = {}
REGISTRY.update(RELATIONAL)
REGISTRY.update(DOCUMENTS)
REGISTRY.update(SCREENS)
REGISTRY.update(CATALOG)
REGISTRY.update(QUALITY)
REGISTRY.update(EVALUATION)


def bind(fn: QueryFn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Warehouse.of(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run
