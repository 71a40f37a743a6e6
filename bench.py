"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from millrace import queries as core

NAMES = ["flagship", "filter_and_or_not", "groupby_multi", "multi_join_5", "left_join", "not_exists", "correlated_scalar", "not_in_subquery_nulls", "gt_all", "intersect_all", "window_row_number", "bare_column_max", "setop_precedence", "cte_chain", "builder_chain"]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    every, took = core.queries(), {}
    every["flagship"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    for name in NAMES:
        start = time.perf_counter()
        every[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
