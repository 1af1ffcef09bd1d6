"""Times the headline queries and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from sparkatlas.plans import catalogue

DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
NAMES = ("content_hash", "line_windows", "incremental_dedup", "module_stats", "symbol_importance", "resolve_relationships", "references", "hierarchy_both", "fuzzy_lookup", "dense_topk", "sparse_topk", "hybrid_rrf", "precision_mrr", "debounce_sessions", "digest_markdown")


def main() -> None:
    conf = {"spark.sql.shuffle.partitions": CPUS, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{CPUS}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    catalogue.line_windows(spark, DIR).write.format("noop").mode("overwrite").save()  # starts the JVM's compilers
    took = {}
    for name in NAMES:
        began = time.time()
        catalogue.QUERIES[name](spark, DIR).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total wall-clock of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(DIR).removeprefix("sf")}))


if __name__ == "__main__":
    main()
