"""Time the headline queries; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "label_items", "range_category", "encounter_info", "first_labs", "first_vitals", "labs_window_6h",
    "vitals_window_6h", "first_value_unit", "numeric_features", "drug_normalise", "drug_classify",
    "multi_hot_drugs", "drug_cumulative", "evidence_full_right", "outcome_exists", "stay_gaps", "multistay",
    "merge_close_stays", "build_dataset", "histogram_by_class", "correlations", "grouped_describe",
    "frame_describe", "balance_orders", "split_orders", "impute_median", "standardise", "roc_auc", "what_if",
]
RUNS = int(os.environ.get("BENCH_RUNS", "1"))  # after one warm-up


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from clinfeat.plans.catalogue import QUERIES
    import clinfeat.plans.model_queries  # noqa: F401

    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    seconds = {}
    for name in names:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(sorted(times[1:])[RUNS // 2], 3)
    print(json.dumps({
        "metric": f"sum of query seconds, median of {RUNS} after one warm-up", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
