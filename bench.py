"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: folder of the standard tables; BENCH_CPUS: cores. Each query runs once unmeasured
(that compiles its code), then once measured, into a sink that keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

from plumbline.plans.queries import QUERIES
from plumbline.session import build_session

HEADLINE = (
    "column_profile_lineitem", "column_profile_orders", "missing_profile", "histogram_lineitem", "histogram_quantiles", "exact_quantiles", "refined_quantiles",
    "width_bucket_histogram", "value_sample", "infer_types_events", "document_profile", "top_words", "stop_words", "tfidf_keywords", "detect_language", "chunk_documents",
    "chunk_offsets", "file_inventory", "profile_records", "file_set_sizes", "flat_profile", "primary_keys", "foreign_keys", "merged_state_profile", "running_profile", "latest_profile_per_dataset",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session(f"local[{cpus}]", cpus, **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g")})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
