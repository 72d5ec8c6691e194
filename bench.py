"""Seconds of the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = ("tw_spread_bins", "level_profile", "ofi_calendar", "ofi_event_clock", "lifecycle_orders", "km_curve", "lee_ready", "taq_summary", "decay", "validation_streaks", "clean_replay_stats", "lobster_repair_replay")


def main() -> None:
    from tickloom.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    found: dict[str, float] = {}
    for name in HEADLINE:
        times = []
        for _ in range(2 if name == "decay" else 3):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        found[name] = round(statistics.median(times), 3)
    print(json.dumps({"metric": "market_queries_total", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
