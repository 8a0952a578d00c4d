"""Times the engine's headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessera.queries import HEADLINE, QUERIES

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        took = []
        for i in range(RUNS + 1):  # the first run compiles and is not counted
            start = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline queries, sum of medians of 3 warm runs", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
