"""Times the engine's queries: one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from veilframe import benchmarks


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    benchmarks.QUERIES["global_count"](spark, sf_dir).collect()
    took = {}
    for name, query in benchmarks.QUERIES.items():
        began = time.time()
        query(spark, sf_dir).collect()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "private_sql_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf_dir.rstrip("/").rpartition("sf")[2] or 0)}))


if __name__ == "__main__":
    main()
