"""Times the headline queries and prints one JSON line.  BENCH_SF_DIR: the tables; BENCH_CPUS: local cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from paperloom.plans import catalog

HEADLINE = (
    "h03_phrase_count", "j06_bm25", "j10_exact", "j02_postings", "c02_dossiers", "d02_dashboard", "d07_dossier_rollup", "d10_threshold_sweep", "d27_retrieval", "e01_segments",
    "e03_starts", "g01_instance_ids", "g10_label_spans", "g17_page_boxes", "h02_tokens", "h11_sliding_words", "h12_chunks", "i14_split", "k07_cascade_delete", "k14_validated",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["d01_counters"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the workers
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
