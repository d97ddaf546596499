"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "resample_weekly_mean", "resample_linear", "as_of_join", "full_join_linear", "interval_join", "segment", "segment_by_time_sliding",
    "segment_by_anchor", "segment_by_changepoint", "dynamic_threshold", "describe", "auto_correlation", "adf", "fft", "ema", "decompose",
    "detect_anomalies", "distance_correlation", "dtw", "matcher_subseq", "frequent_item_sets", "frequent_sub_sequences", "feature_vectors",
    "kshape_fit", "forecast_hws", "forecast_arma", "skip_read_minmax", "map_count", "stream_segment_by_time", "stream_resample",
]


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus)))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from tideframe.catalog import QUERIES

    names = sys.argv[1:] or HEADLINE
    QUERIES["count_where"](spark, sf).collect()
    took = {}
    for name in names:
        times = []
        for _ in range(2):  # the first run warms up
            start = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
        took[name] = round(min(times), 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
