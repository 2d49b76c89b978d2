"""Time every registered query and print one JSON line.

Each query is run twice on $BENCH_SF_DIR with local[$BENCH_CPUS]; the second run
counts, so that it does not include the compilation of its plan's code.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from checks.queries import QUERIES


def seconds(spark: SparkSession, key: str, sf_dir: str) -> float:
    began = time.perf_counter()
    QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("estatescope-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for key in QUERIES:
        seconds(spark, key, sf_dir)
        took[key] = round(seconds(spark, key, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "all registered queries, second run",
                "value": round(sum(took.values()), 3),
                "unit": "sec",
                "queries": took,
                "sf": float(os.path.basename(sf_dir).removeprefix("sf")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
