"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores. Every result is
read to its end by a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "search_code_text",
    "search_by_name",
    "find_symbol",
    "knn_batch",
    "vector_topk_multi_collection",
    "parse_python",
    "parse_typescript",
    "build_graph_edges",
    "discover_filter",
    "snapshot_diff",
    "stale_report",
    "neighbors_1hop",
    "khop_dependencies",
    "edge_upsert",
    "usage_grouping_sets",
    "debounce_sessions_by_user",
    "domain_overlap",
    "advise",
)


def main() -> None:
    from loomgraph.catalog import REGISTERED
    from loomgraph.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        shuffle_partitions=int(cpus),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1).count()
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    times = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        begin = time.perf_counter()
        REGISTERED[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
