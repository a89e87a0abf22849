"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all) choose data and parallelism.
Every query runs once to warm up and then BENCH_RUNS times (default 1); the best time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "candidate_dedupe_merge", "candidate_filter", "trend_topn", "rank_multi_query", "phrase_expand", "phrase_search",
    "source_errors", "url_canonical", "page_anchors", "json_line_candidates", "job_latest", "job_history_join", "job_stage_report",
    "interval_merge", "chunk_pack", "cue_segment_match", "context_batches", "caption_segments", "caption_segments_similar",
    "consensus_vote", "region_quantiles", "persistent_region", "stream_pick", "stage_plan", "rendition_plan", "untranslated_guard",
    "st_trend_windows",
]


def main() -> None:
    from clipmetrics.plans import catalogue
    from clipmetrics.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    parts = str(os.cpu_count() if cpus == "*" else cpus)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": parts, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalogue.queries()
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = None
        for run in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
