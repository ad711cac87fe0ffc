"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR   folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated names (default: all)

After one query to warm the session up, every query runs BENCH_PASSES times
(default 1), to a sink that discards the rows on the executors; nothing stays
cached from one to the next.  ``queries`` holds the last pass, ``cold`` the first
of several.  Shuffle bytes and input rows are those of the last pass, summed over
its stages.

The root-cause queries read daily sums that are kept beside the sales.  They are
folded anew by every run of this script, which is timed as ``daily_rollup`` and
part of the total; the queries after it find them current.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from tillsight.plans.catalog import QUERIES  # noqa: E402
from tillsight.plans.daily_rollup import DailyRollup  # noqa: E402
from tillsight.session import build_session  # noqa: E402
from tillsight.sources.tpch_star import tpch_star  # noqa: E402

WARM_UP = "branch_revenue"
FOLD = "daily_rollup"


def stage_totals(spark, group: str) -> tuple[int, int]:
    """Input rows and shuffle bytes written by the jobs of a group."""
    store = spark.sparkContext._jsc.sc().statusStore()
    tracker = spark.sparkContext.statusTracker()
    rows = shuffled = 0
    for job in tracker.getJobIdsForGroup(group):
        info = tracker.getJobInfo(job)
        for stage in info.stageIds if info else ():
            try:
                data = store.lastStageAttempt(stage)
            except Exception:  # a stage that was skipped or already forgotten
                continue
            rows += data.inputRecords()
            shuffled += data.shuffleWriteBytes()
    return rows, shuffled


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else [FOLD, *QUERIES]
    spark = build_session(
        "tillsight-bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        # A folder of this run's own, so that kept sums are those it has folded itself.
        spark__checkpoint__dir=os.path.join(os.getcwd(), "spark-warehouse", f"bench-{uuid.uuid4().hex}"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    count = int(os.environ.get("BENCH_PASSES", "1"))
    passes, rows, shuffled = [], {}, {}

    def run(name: str) -> float:
        spark.catalog.clearCache()
        start = time.perf_counter()
        if name == FOLD:
            DailyRollup(tpch_star(spark, sf_dir)).refresh()
        else:
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(WARM_UP)
    for number in range(count):
        passes.append({})
        for name in names:
            group = f"{name}-{number}"
            spark.sparkContext.setJobGroup(group, name)
            passes[-1][name] = run(name)
            rows[name], shuffled[name] = stage_totals(spark, group)
    spark.stop()
    timed = passes[-1]
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                **({"cold": passes[0]} if count > 1 else {}),
                "input_rows": rows,
                "shuffle_bytes": shuffled,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
