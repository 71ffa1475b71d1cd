"""Benchmark the headline workloads.

Runs each query once to warm up, then ``BENCH_RUNS`` times, and reports the median
wall time.  Setup, outside the timings, writes ``events`` as ``EVENT_FILES`` files (a table
of several row groups, as any large table is) and the text log read by ``funnel_text_log``.
The tables themselves are one row group each, so the queries with CPU-heavy work per row
(``SPREAD``) ask for their rows to be spread over the cores first; the others scan as stored.  Every
run executes the whole plan, jobs at plan-building time included, into Spark's ``noop`` sink, so
nothing is collected to the driver.  Prints one JSON line; ``ratio_r01`` compares each query
with the fixed round-1 numbers below.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_RUNS`` (default 5).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave.operators.count import count_patterns  # noqa: E402
from logweave.operators.funnel import analyze_funnel  # noqa: E402
from logweave.operators.parse import parse_entries  # noqa: E402
from logweave.plans import workloads as W  # noqa: E402
from logweave.plans.derived import logcat_lines, write_lines  # noqa: E402
from logweave.session import Scratch, local_session  # noqa: E402
from logweave.sources.table import entries_from_table  # noqa: E402
from logweave.sources.text import LINE_ORDER, SPLIT_CHUNK, read_log_lines  # noqa: E402

EVENT_FILES = 16
SPREAD = ("parse_logcat", "count_payload", "nonblank_lines", "count_documents", "count_deep_patterns")
# Median seconds of round 1 at sf0.1, the baseline of every later round.
ROUND_1 = {
    "count_patterns": 0.7367, "funnel_steps": 1.2534, "funnel_20_steps": 1.8236, "parse_logcat": 1.8667,
    "count_payload": 1.903, "funnel_text_log": 2.4478, "nonblank_lines": 1.0562, "count_documents": 2.3145,
}


def headline(spark, d, events, text_log, tasks):
    """name -> DataFrame factory."""
    many = lambda: entries_from_table(spark.read.parquet(events), message="event_type", ts="ts", keep=["event_id"])
    hundred = W.funnel_of(W.MAIN_FUNNEL * 33 + ["signup"])
    return {
        "count_patterns": lambda: count_patterns(W.event_entries(spark, d), W.EVENT_PATTERNS),
        "funnel_steps": lambda: W.q_funnel_steps(spark, d),
        "funnel_20_steps": lambda: W.q_funnel_20_steps(spark, d),
        "parse_logcat": lambda: W.q_parse_logcat(spark, d, tasks),
        "count_payload": lambda: W.q_count_payload(spark, d, tasks),
        "funnel_text_log": lambda: analyze_funnel(
            parse_entries(read_log_lines(spark, text_log), W.LOGCAT_SPEC), W.funnel_of(W.MAIN_FUNNEL),
            order_by=LINE_ORDER, chunk_by=SPLIT_CHUNK,
        ).steps(),
        "nonblank_lines": lambda: W.q_nonblank_lines(spark, d, tasks),
        "count_documents": lambda: W.q_count_documents(spark, d, tasks),
        "funnel_many_files": lambda: analyze_funnel(many(), W.funnel_of(W.MAIN_FUNNEL), order_by=W.EVENT_ORDER).steps(),
        "funnel_100_steps": lambda: analyze_funnel(many(), hundred, order_by=W.EVENT_ORDER).steps(),
        "count_deep_patterns": lambda: W.q_count_deep_patterns(spark, d, tasks),
    }


def run_once(make) -> float:
    t0 = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main():
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="logweave-bench")
    setup = Scratch(spark, "bench")  # not timed
    W.table(spark, d, "events").repartition(EVENT_FILES).write.parquet(setup.path("events"))
    text_log = write_lines(logcat_lines(W.table(spark, d, "events")), setup.path("log"))
    qs = headline(spark, d, setup.path("events"), text_log, spark.sparkContext.defaultParallelism)
    times = {}
    for name, make in qs.items():
        run_once(make)  # warm-up
        times[name] = round(statistics.median(run_once(make) for _ in range(runs)), 4)
    events = W.table(spark, d, "events").count()
    lines = W.document_lines(spark, d).count()
    sf = os.path.basename(d.rstrip("/")).removeprefix("sf")
    out = {
        "metric": "total_median_seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "ratio_r01": {k: round(times[k] / v, 3) for k, v in ROUND_1.items()},
        "event_files": EVENT_FILES,
        "spread": {q: spark.sparkContext.defaultParallelism for q in SPREAD},
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "rows_per_sec": {
            "count_patterns": round(events / times["count_patterns"]),
            "funnel_steps": round(events / times["funnel_steps"]),
            "funnel_20_steps": round(events / times["funnel_20_steps"]),
            "parse_logcat": round(events / times["parse_logcat"]),
            "nonblank_lines": round(lines / times["nonblank_lines"]),
        },
        "cpus": cpus,
        "spark": spark.version,
    }
    print(json.dumps(out))
    setup.close()
    spark.stop()


if __name__ == "__main__":
    main()
