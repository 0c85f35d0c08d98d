"""Time the headline queries; print one JSON line.

BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default *)
"""

from __future__ import annotations

import json
import os
import re
import time

from wareloom.plans import QUERIES
from wareloom.session import local_session

HEADLINE = [
    "canonical_pages",
    "skip_histogram",
    "html_link_edges",
    "discover",
    "page_text",
    "site_signals",
    "nav_links",
    "recommend_flow",
    "keyword_hits",
    "classify_balanced",
    "strictness_sweep",
    "classify_rules",
    "apply_decisions",
    "price_facts",
    "base_price",
    "spec_pairs",
    "section_specs",
    "merge_options",
    "configurator_options",
    "configurator_signals",
    "match_option_images",
    "best_swatch",
    "dominant_colors",
    "build_catalog",
    "dedupe_catalog",
    "near_duplicate_texts",
    "merge_catalogs",
    "priced_rows",
    "transitions",
    "no_change_runs",
    "stream_transitions",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = local_session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([\d.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
