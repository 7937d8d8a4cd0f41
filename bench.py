"""Times the headline queries and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from lodestone.plans import registry

HEADLINE = ["dedup_representatives", "conflict_merge", "pair_candidates_range", "stats_pack", "correlation_pairs", "weighted_mean_std", "entropy_by_group", "gap_sessions", "borda_votes", "shared_neighbour_pairs", "nearest_anchor_distance", "pool_vectors"]

#: Dearer queries, timed beside the others (one run each); ``value`` leaves them out, so that it stays comparable.
MORE = ["mad_outliers", "spearman_by_group", "drop_ledger", "wide_correlations", "robustness_grades", "stability_selection"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE + MORE:
        each = []
        for _ in range(2 if name in HEADLINE else 1):
            began = time.perf_counter()
            registry.queries()[name](spark, folder).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name] = round(min(each), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[n] for n in HEADLINE), 3), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
