"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from gneiss.plans.catalog import QUERIES

HEADLINE = [
    "g1_summary", "g2_callers", "g4_reachability", "g6_impact", "g7_dead_code", "g8_cycles", "g9_layer_violations", "g11_hubs", "g14_diff", "g18_degrees", "g19_overview",
    "b1_bm25_idf", "b3_bm25_search", "b6_nearest", "f9_tokenize", "k2_cache_hits", "k4_eviction", "l9_missing_pairs", "l11_taint", "c1_contradictions", "c6_counterexamples", "j1_imports", "j2_suffix_index",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["g18_degrees"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and reads once
    took = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
