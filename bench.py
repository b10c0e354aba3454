"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the data folder, BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from studyloom.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "cohort_flow_counts", "required_eos", "visit_table", "visit_status_counts", "due_next_week", "open_queries",
    "deviation_table", "results_matrix", "lab_reconcile", "lab_range_check", "closure_summary", "treatment_dose_shares",
    "numbered_cases", "clean_medications", "lab_extract", "film_rdt_overlap", "cohort_waterfall", "crosstab_totals",
    "crosstab_pct", "join_many_to_one", "anti_two_keys", "reconcile_values", "full_outer_extract", "asof_last_before",
    "case_number", "value_pivot", "first_per_key", "facet_values",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        f"local[{cpus}]",
        "studyloom-bench",
        spark__sql__shuffle__partitions=cpus if cpus.isdigit() else "8",
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    # The first job pays for starting the engine, not for a query.
    spark.read.parquet(f"{folder}/lineitem.parquet").groupBy("l_returnflag").count().collect()
    seconds = {}
    for name in names:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline queries, best of two runs each, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1).rstrip(".")) if scale else folder,
            }
        )
    )


if __name__ == "__main__":
    main()
