"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``.

Prints one JSON line.  ``prepare`` builds the normalised tables that every
analysis reads (the work a trace engine does while it loads a recording); each
query then runs on a trace of its own over those tables, so no query profits
from frames of another.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = ("capture_occupancy", "turns", "model_cohorts", "capture_hierarchy")
ALSO = ("capture_activity_bins", "activity_summary", "tool_summary", "root_sessions", "inventory", "context_changes", "turn_owners", "script_children")


def main() -> None:
    from checks import ingest_queries
    from spanloom.plans.trace import AgentTrace
    from spanloom.session import local_session
    from spanloom.sources.binding import bind_events
    from spanloom.sources.tables import read_trace_tables, write_trace_tables
    from spanloom.session import shared_folder

    spark = local_session("bench", cores=CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    spark.read.parquet(f"{SF_DIR}/events.parquet").count()  # start the JVM and the file system

    def timed(run) -> float:
        began = time.perf_counter()
        run()
        return round(time.perf_counter() - began, 3)

    store = f"{shared_folder(spark)}/bench"
    times: dict[str, float] = {}
    times["ingest"] = timed(lambda: write_trace_tables(bind_events(spark, SF_DIR), f"{store}/raw", mode="overwrite"))

    def normalise() -> None:
        t = AgentTrace(read_trace_tables(spark, f"{store}/raw"), store=f"{store}/silver")
        for name in BASE:
            t[name]

    times["prepare"] = timed(normalise)

    def fresh(i: int) -> AgentTrace:
        """A trace that knows the base tables only."""
        t = AgentTrace(read_trace_tables(spark, f"{store}/raw"), store=f"{store}/q{i}")
        return t.override(**{n: spark.read.parquet(f"{store}/silver/{n}") for n in BASE})

    for i, name in enumerate(HEADLINE + ALSO):
        times[name] = timed(lambda: fresh(i)[name].write.format("noop").mode("overwrite").save())
    for name in ("privacy_findings", "failure_history_audit", "compare_runs", "context_diff", "match_prompt_log", "flatten_otlp_spans"):
        times[name] = timed(lambda: ingest_queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save())
    total = round(sum(times[q] for q in HEADLINE), 3)
    print(
        json.dumps(
            {"metric": "headline queries, total time", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"), "cpus": CPUS}
        )
    )


#: Tables of the normalised trace.
BASE = ("track_process", "capture_markers", "slice_capture", "slices", "counter_tracks", "counter_totals", "capture_runs")

if __name__ == "__main__":
    main()
