"""Print the executed physical plans of the headline workloads (operator lines only).

Usage: python tools/show_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from logweave.operators.funnel import analyze_funnel  # noqa: E402
from logweave.operators.parse import parse_entries  # noqa: E402
from logweave.plans import workloads as W  # noqa: E402
from logweave.plans.derived import logcat_lines, write_lines  # noqa: E402
from logweave.session import Scratch, local_session  # noqa: E402
from logweave.sources.text import LINE_ORDER, SPLIT_CHUNK, read_log_lines  # noqa: E402

KEEP = ("Scan", "Exchange", "Generate", "MapInPandas", "Aggregate", "Sort", "Union", "Project", "Filter",
        "WholeStageCodegen", "Window", "BroadcastExchange")


def main():
    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    log = write_lines(logcat_lines(W.table(spark, d, "events")), Scratch(spark, "plans").path("log"))
    cases = {
        "count_patterns": W.q_count_patterns(spark, d),
        "funnel_steps (table source)": W.q_funnel_steps(spark, d),
        "funnel over a text log": analyze_funnel(
            parse_entries(read_log_lines(spark, log), W.LOGCAT_SPEC), W.funnel_of(W.MAIN_FUNNEL),
            order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK).progress,
        "count_payload (parse + JSON + count)": W.q_count_payload(spark, d),
    }
    for name, df in cases.items():
        df.write.format("noop").mode("overwrite").save()  # run once so AQE shows its final plan
        plan = df._jdf.queryExecution().executedPlan().toString()
        print(f"### {name}\n```")
        for line in plan.splitlines():
            if any(k in line for k in KEEP):
                print(line.rstrip()[:200])
        print("```\n")
    spark.stop()


if __name__ == "__main__":
    main()
