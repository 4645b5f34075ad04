"""Time of the headline queries on one machine; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from joblattice.plans import QUERIES

HEADLINE = ["skill_market_ranks", "daily_live_series", "market_risers_fallers", "skill_market_value", "half_window_change", "skill_index_groupingsets", "archive_upsert", "vacancy_rate_asof", "locf_series", "cohort_retention", "source_unique", "skill_remap", "mention_index", "global_search", "group_totals_to_cities", "priced_market"]


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):  # the first run also compiles
            begun = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - begun)
        times[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
