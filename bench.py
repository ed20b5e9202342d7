"""Times every query and the whole report bundle; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harness.queries import QUERIES  # noqa: E402
from harness.views import table  # noqa: E402
from tablelens import analyze  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def bundle(spark: SparkSession, sf_dir: str):
    """All reports of lineitem, the figure to compare with a single-machine run."""
    return analyze(table(spark, sf_dir, "lineitem"), key=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
                   keep=True, partitions=int(CPUS))[0]


def small_bundle(spark: SparkSession, sf_dir: str):
    """All reports of 200 rows: what jobs cost when there is next to nothing to read."""
    return analyze(table(spark, sf_dir, "customer").orderBy("c_custkey").limit(200).coalesce(1), key=("c_custkey",), keep=True)[0]


def default_bundle(spark: SparkSession, sf_dir: str):
    """The bundle as a user calls it, without a cache."""
    return analyze(table(spark, sf_dir, "lineitem"), key=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))[0]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        # The bundle's plans have more generated classes than the default cache of 100 holds.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    table(spark, SF_DIR, "region").count()
    runs = {**QUERIES, "report_bundle_lineitem": bundle, "report_bundle_default": default_bundle,
            "report_bundle_200_rows_first": small_bundle, "report_bundle_200_rows_warm": small_bundle}
    only = sys.argv[1:]
    times = {}
    for name, run in runs.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "all_queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
