"""Times the headline queries and prints one JSON line.

Reads ``BENCH_SF_DIR`` and ``BENCH_CPUS``; each query runs ``BENCH_RUNS`` times
and counts with its median. Results go to Spark's no-op sink, so every row and
column is computed and none is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from standin.queries import queries  # noqa: E402

HEADLINE = [
    "scan_postings",
    "csv_roundtrip_documents",
    "dedupe_postings",
    "level_totals",
    "distinct_texts",
    "html_to_text",
    "token_cleanup",
    "word_chunks",
    "dictionary_extract",
    "model_extract",
    "attach_entities",
    "similarity_pairs",
    "fuzzy_groups",
    "apply_spelling_map",
    "skill_posting_counts",
    "share_by_level",
    "evolution_matrix",
    "matrix_all_levels",
    "mention_share",
    "skill_trajectory",
    "evidence_rows",
    "evidence_search",
    "top_emerging",
    "dedupe_copies",
    "entity_references",
    "long_phrases",
    "evidence_full",
    "full_analysis",
]
# Queries that run many jobs of their own are timed once.
SLOW = {"similarity_pairs", "fuzzy_groups", "apply_spelling_map", "full_analysis"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("skilltrend-bench")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Small files: let tasks stay smaller than a cluster would want them.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found, seconds = queries(), {}
    spark.range(1000).selectExpr("sum(id)").collect()
    for name in names:
        laps = []
        for _ in range(1 if name in SLOW else runs):
            start = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            laps.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(laps), 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries (median per query)",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
