"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: folder of input tables. BENCH_CPUS: local cores. BENCH_RUNS: runs per query, of which
the median counts. Every query is computed in full and its rows are discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from checks import catalog
from checks.workspace import Workspace
from tillflow.scratch import discard
from tillflow.session import local_session
from tillflow.sources.warehouse import drop_warehouse

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# Names of the narrow, refreshed, single-column and schema variants are left out.
HEADLINES = (
    "clean", "quality_report", "enriched_from_raw", "engineer_features", "table_stats", "filter_options",
    *catalog.ORDER_REPORTS,
    *(n for n in catalog.SELECTED_REPORTS if n not in ("month_label", "basket_pairs_all", "rfm_base", "rfm_scores")),
)


def run(build, workspace) -> float:
    begun = time.perf_counter()
    catalog.plain(build(workspace)).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begun


def main() -> None:
    spark = local_session(cores=CPUS, shuffle_partitions=CPUS)
    workspace, builds, seconds = Workspace(spark, FOLDER), catalog.builds(), {}

    for step in ("lines", "table", "raw_path"):  # tables that the queries read, each made once
        begun = time.perf_counter()
        getattr(workspace, step)
        seconds[f"prepare_{step}"] = round(time.perf_counter() - begun, 3)

    for name in HEADLINES:
        seconds[name] = round(statistics.median(run(builds[name], workspace) for _ in range(RUNS)), 3)

    drop_warehouse(spark, workspace.table)
    discard(spark)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({
        "metric": "sum of median query seconds", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(FOLDER.rstrip("/")), "cpus": CPUS, "runs": RUNS,
    }))


if __name__ == "__main__":
    main()
