"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pagequarry.plans.registry import CATALOG  # noqa: E402
from pagequarry.session import local_session  # noqa: E402

HEADLINE = [
    "clean_text", "near_duplicates", "sentiment_counts", "entity_edges", "term_weights", "cloud_terms",
    "page_topics", "takeaways", "nearest_texts", "silhouette", "site_similarity", "latest_report",
    "time_series", "subscriptions", "filter_takeaway", "page_segments", "page_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, "bench")
    spark.read.parquet(f"{folder}/documents.parquet").count()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        CATALOG[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
