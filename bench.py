"""Times headline queries at BENCH_SF_DIR on local[BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from lamina import plans

#: One query of each group of operators; every one is read to its last row.
HEADLINE = (
    "q01_list_communications", "q02_get_communications", "q03_tag_vocabulary", "q07_my_bulletins", "q10_lookup", "c04_resolved_models", "w04_vehicle_bulletins",
    "q04_retrieve", "q23_retrieval_evaluation", "q13_usage_summary", "t06_rolling_24h", "t07_sliding_limiter", "q12_preview", "q14_access", "q16_alerts", "d05_state_machine", "j18_difference", "q22_strata",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    plans.QUERIES[HEADLINE[0]](spark, sf_dir).count()  # compiles and opens files once
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        plans.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
