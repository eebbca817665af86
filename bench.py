"""Times the headline queries: python bench.py prints one JSON line.

Each query runs once to warm up and then RUNS times; the median counts. BENCH_SF_DIR and BENCH_CPUS choose the data and
the cores. Results go to Spark's noop sink, so that all rows and columns are computed but none is gathered."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from stratavec.plans import registry

RUNS = 5
HEADLINE = [
    "filter_eq_count_u32", "filter_eq_count_u64", "filter_eq_count_f64", "filter_oneof_count", "multi_filter_count", "multi_filter_join",
    "filter_oneof_positions", "section_masks", "section_minmax", "section_bytes", "vector_stats", "densify_sparse", "delta_successive",
    "xor_f64_encode", "xor_f32_roundtrip", "hist_2d_diff",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline queries, total of warm medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
