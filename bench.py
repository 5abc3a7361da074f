"""Times the headline queries and prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query runs once to warm the JVM and the Python workers, then is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from topicgauge.plans import catalog
from topicgauge.session import local_session

HEADLINE = [
    "drift_detect", "drift_coverage", "latency_histogram", "sample_every_nth",
    "cluster_cf", "knn_centroids", "birch_snapshot_assign", "birch_absorb_merge",
    "golden_admit", "evaluate_quality", "split_two_means",
    "embed_documents", "document_topics", "grow_clusters",
    "normalize_openai", "sse_openai", "sse_anthropic", "unclustered_recovery", "stream_drift",
    "knn_centroids_cells", "assign_batch", "stream_cluster",
]


def timed(query, spark, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spent = {}
    for name in names or HEADLINE:
        query = catalog.QUERIES[name]
        timed(query, spark, folder)
        spent[name] = round(timed(query, spark, folder), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
