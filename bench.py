"""Time the headline queries over whole tables and print one JSON line.

BENCH_SF_DIR names the data, BENCH_CPUS the number of cores. Every query is written to a
sink that discards rows, so the time is that of the work and not of collecting results.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "found_by_type",
    "document_spans",
    "page_spans",
    "scan_rows",
    "counts_by_type",
    "daily_stats",
    "assign_placeholders",
    "anonymize_rows",
    "anonymize",
    "vote",
    "evaluate",
    "announced_free_text",
    "keyed_secrets",
    "user_messages",
    "assembled_answers",
    "chunk_text",
)


def main() -> None:
    from maskwell.plans import catalog

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.session.timeZone", "UTC")
        # Small files still get one task per core.
        .config("spark.sql.files.minPartitionNum", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # Load classes and compile the hot paths on the smallest data first.
    catalog.found_by_type(spark, catalog.SMALL_DIR if os.path.isdir(catalog.SMALL_DIR) else sf_dir).collect()

    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    count, chars = docs.selectExpr("count(*)", "sum(length(text))").first()
    flagship = times["found_by_type"]
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": int(cpus),
                "documents_per_sec": round(count / flagship, 1),
                "megachars_per_sec": round(chars / flagship / 1e6, 2),
            }
        )
    )


if __name__ == "__main__":
    main()
