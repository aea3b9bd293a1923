"""Times the headline queries: ``BENCH_SF_DIR`` (default sf0.1) on ``local[BENCH_CPUS]``; prints one JSON line.

"cold" queries build the index within the query; "warm" ones search an index that is stored as
Parquet, which is written once before.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import SparkSession

from quernel import DiskProvider
from quernel import queries as search

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
COLD = ["tokenize_text", "postings_build", "field_norm", "terms_single", "match_and", "bool_full", "search_text_all_fields", "match_benchmark_items"]
WARM = {
    "warm_terms": {"query": {"terms": {"text": "licensed"}}},
    "warm_match": {"query": {"match": {"text": "the work is licensed"}}},
    "warm_expand": {"query": {"terms": {"text": {"value": "licen", "expand": True}}}},
    "warm_bool": {"query": {"bool": {"must": {"match": {"text": "the"}}, "filter": {"terms": {"lang": "en"}}, "should": {"match": {"text": "licensed"}}}}},
    "warm_not": {"query": {"not": {"match": {"text": "licensed"}}}},
}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    work = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"{work}/shared")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(search.QUERIES["match_all_boost"](spark, SF_DIR))  # starts the executors
    took: dict[str, float] = {}

    def timed(name: str, job) -> None:
        began = time.perf_counter()
        job()
        took[name] = round(time.perf_counter() - began, 3)

    for name in COLD:
        timed(name, lambda name=name: run(search.QUERIES[name](spark, SF_DIR)))
    store = DiskProvider(spark, f"{work}/store")
    timed("store_index", lambda: store.write(search.documents_index(spark, SF_DIR)))
    index = store.read("documents")
    for name, query in WARM.items():
        timed(name, lambda query=query: run(index.search(query)))
    stats = {r.field: r for r in index.field_stats().collect()}
    notes = {"postings": index.postings.count(), "terms": sum(r.n_terms for r in stats.values()), "documents": stats["text"].n_docs, "spark": spark.version, "master": f"local[{CPUS}]", "shuffle_partitions": int(CPUS)}
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")), **notes}))


if __name__ == "__main__":
    main()
