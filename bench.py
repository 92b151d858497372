"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from quarry.plans import registry
from quarry.sources.store import documents_index

HEADLINE = ["bm25_topk", "vector_topk", "hybrid_weighted", "rrf_fusion", "tfidf_topk", "enhanced_search", "chunk_parts", "clean_text_lines", "html_sections", "sessionize"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    began = time.perf_counter()
    documents_index(spark, sf_dir)  # made once, then searched by all queries
    took["keyword_index_build"] = round(time.perf_counter() - began, 3)
    for name in HEADLINE:
        runs = []
        while len(runs) < 3 and (not runs or sum(runs) < 15):  # the first also compiles; long ones run once
            began = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:] or runs), 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(os.path.normpath(sf_dir))}))
    spark.stop()


if __name__ == "__main__":
    main()
