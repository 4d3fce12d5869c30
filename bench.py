"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (full execution, no
rows pulled to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater.plans.registry import REGISTRY  # noqa: E402
from tidewater.session import build_session  # noqa: E402
from tidewater.sources.tables import Warehouse  # noqa: E402

HEADLINE = [
    "c4_carrier_performance", "c2_three_table_join", "c3_four_table_join", "c8_extracted_vs_actual",
    "c12_fanout_measures", "d4_grouped_measures", "d9_ratio_of_sums", "d13_two_level_aggregate",
    "d21_three_join_filter", "e1_latest_per_key", "e2_transit_time", "e3_recent_turns", "f1_top_n_groups",
    "i1_i2_parse_status", "i17_notes", "i16_auto_link", "j1_question_screen", "j4_pitfall_lint",
    "j6_scan_budget", "k1_nearest_documents", "k7_k8_model_summary", "l2_orphan_keys",
    "l7_invoice_reconciliation", "k1_similar_vectors", "k10_category_matrix", "i18_review_merge", "i18_stored_reviews", "m1_stream_ingest",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", "tidewater-bench", **{"spark.driver.memory": "16g"})
    wh = Warehouse.of(spark, sf_dir)
    t_load = time.time()
    if os.environ.get("BENCH_VIEWS", "stored") == "stored":
        wh.materialize()  # load step: logistics tables written once, as in production
    load = round(time.time() - t_load, 3)
    def one_pass() -> tuple[dict[str, float], float]:
        times: dict[str, float] = {}
        t_all = time.time()
        for name in names:
            t0 = time.time()
            REGISTRY[name](wh).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - t0, 3)
        return times, round(time.time() - t_all, 3)

    times, total = one_pass()          # cold: first run in this JVM (includes written job stages)
    warm, warm_total = one_pass()      # warm: same queries again
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
                      "sf": sf, "cpus": int(cpus), "load_sec": load, "warm_total": warm_total,
                      "warm": warm, "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
