"""Write PLANS.md: physical-plan shape of every registered query (stored tables).

Usage: python tools_plans.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

from tidewater.plans.registry import REGISTRY
from tidewater.session import build_session
from tidewater.sources.tables import Warehouse


HEAD = ["| query | shuffles | BHJ | SMJ | WGL | pushed / scans |", "|---|---|---|---|---|---|"]


def table(wh: Warehouse) -> list[str]:
    lines = list(HEAD)
    for name, fn in REGISTRY.items():
        df = fn(wh)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        shuffles = len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|SinglePartition|RoundRobin)", plan))
        bhj = plan.count("BroadcastHashJoin")
        smj = plan.count("SortMergeJoin")
        wgl = len(re.findall(r"WindowGroupLimit .* Partial", plan))
        scans = re.findall(r"FileScan parquet[^\n]*", plan)
        pushed = sum(1 for s in scans if re.search(r"PushedFilters: \[[^\]]", s))
        lines.append(f"| {name} | {shuffles} | {bhj} | {smj} | {wgl} | {pushed} / {len(scans)} |")
    return lines


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("local[8]", "tidewater-plans")
    wh = Warehouse.of(spark, sf)
    lines = ["# Physical plans", "",
             f"Executed plans of every registered query on `{sf}` after AQE (final plans). Shuffles = "
             "`Exchange hashpartitioning/rangepartitioning/SinglePartition`; BHJ / SMJ = broadcast-hash / sort-merge joins; "
             "WGL = partial window group limits; pushed = scans with pushed filters / all scans.", "",
             "## As `queries()` runs them: views over the driver tables", "", *table(wh)]
    wh.forget()
    wh.materialize()
    lines += ["", "## With the logistics tables stored as Parquet", "", *table(wh)]
    open("PLANS.md", "w").write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
