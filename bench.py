"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice after a session warm-up and the better time counts; the first run, and the parts of the
better one spent on building the query (eager stages included) and on running it, are given beside it.  Results are
written to a sink that reads every row and column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from hostlens.session import build_session  # noqa: E402

HEADLINE = (
    "clean_class_distribution", "canonical_urls", "stage_stats", "url_dataset", "domain_dataset",
    "domain_features", "url_features", "keep_first_lines", "undersample_lines", "temporal_split",
    "ranking_metrics_lines", "group_summaries", "orders_profile", "event_summary", "category_of_text",
    "score_table", "extract_links", "addon_urls", "news_url_filter", "sitemap_entries",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "hostlens-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
            "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["event_summary"](spark, folder).collect()
    times: dict[str, float] = {}
    parts: dict[str, dict[str, float]] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            df = QUERIES[name](spark, folder)
            built = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            end = time.perf_counter()
            runs.append((end - start, built - start, end - built))
        total, build, run = min(runs)
        times[name] = round(total, 3)
        parts[name] = {"first": round(runs[0][0], 3), "build": round(build, 3), "run": round(run, 3)}
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "parts": parts, "sf": os.path.basename(folder).removeprefix("sf")}))


if __name__ == "__main__":
    main()
