"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.plans import suite

HEADLINES = (
    "p2_point_lookup", "p3_between", "o2_top_k", "a2_sum_group_by", "a3_avg_join", "a5_two_keys", "a6_two_levels", "a7_distinct_join", "a8_aggregate_top_k",
    "j1_inner_join", "j3_multi_join", "j3_multi_join_window", "j4_semi_join", "p10_case_exists", "u1_union_all", "w1_row_number", "w2_top_per_group",
    "c6_node_anchor", "c7_expand", "c7_expand_reverse", "c10_type_alternation", "c12_edge_properties", "o3_order_limit", "o5_offset_limit",
    "x1_cosine_top_k", "x2_dot_top_k", "x3_l2_top_k", "x4_candidates", "x5_int8_top_k", "s7_import_table", "s8_import_nodes",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINES:
        best = float("inf")
        for _ in range(3):  # the first run compiles code
            start = time.perf_counter()
            suite.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        took[name] = round(best, 4)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
