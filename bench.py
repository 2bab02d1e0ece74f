"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
Each query runs once to warm up and then BENCH_RUNS times (default 1); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from markwell.plans import load_catalog  # noqa: E402
from markwell.session import get_session  # noqa: E402

HEADLINE = (
    "flagship_assessment", "segment_submissions", "clean_tasks", "embed_text", "top_similar", "incremental_similarity",
    "knn_lsh", "analyze_text", "llm_likelihood", "criteria_match", "evaluate_answers", "average_score", "organizer_report",
    "keyword_frequency", "tfidf_keywords", "statistics", "leaderboard", "select_winners", "ingest_dedup",
    "exact_duplicates", "list_numbering", "pipe_table_rows", "stream_latest_stage", "stream_pipeline",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = get_session(
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "128k",
            "spark.driver.memory": "12g",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_catalog()
    times = {}
    for name in names:
        taken = []
        for run in range(runs + 1):
            start = time.perf_counter()
            catalog[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if run:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": scale}
        )
    )


if __name__ == "__main__":
    main()
