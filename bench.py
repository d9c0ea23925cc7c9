"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (table folder), BENCH_CPUS (local cores).
Every query is run to completion over the whole tables with a sink that discards rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "product_detail",
    "products_by_category",
    "category_product_pages",
    "related_totals",
    "related_pages",
    "category_flat_tree",
    "category_tree",
    "global_search",
    "search_bulk",
    "fastrp_embedding",
    "knn_topk",
    "similar_to_build",
    "recommendations",
    "recommendation_pages",
    "page_cache_lookup",
    "recent_items",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from shelfgraph.session import build_session
    from shelfgraph.verification import registry

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    # The suggestion queries read stored edges, as the service does; building
    # them is timed on its own as similar_to_build.
    registry.QUERIES["scan_products"](spark, folder).write.format("noop").mode("overwrite").save()
    started = time.time()
    registry.stored_similar_to(spark, folder)
    setup = time.time() - started
    timings = {}
    for name in names:
        started = time.time()
        registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "setup_sec": round(setup, 3),
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
