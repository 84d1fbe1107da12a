"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``BENCH_QUERIES`` (comma separated keys, or ``all``) overrides the headline set.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "w02_trailing_alert", "w02_url_alert", "w03_count_reset_alert", "w04_health", "w05_last_errors", "w06_running_totals",
    "w07_tracebacks", "w01_context_ring", "s03_line_numbers", "f02_first_pattern", "a01_exception_counts", "a05_retry_collapse",
    "s13_split_lines", "f28_grep", "f29_definition_search", "f25_path_exclusion", "x05_html_text", "x07_markdown_to_chat",
    "w09_newest_per_conversation", "u02_from_or_to", "x02_coercion", "j02_containing_function", "j05_changed_line_issues",
    "j06_hotspots", "a11_degrees", "g02_call_chain", "j07_induced_edges", "e01_functions", "e02_calls", "e03_line_edits",
    "e04_replace_all", "w11_hunk_numbers", "w10_diff_pairs", "t09_first_per_file",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from traceframe.plans.all_plans import QUERIES
    from traceframe.session import local_session

    spark = local_session("bench", cpus)
    spark.sparkContext.setLogLevel("OFF")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    # one warm-up for the JVM and the Python workers; it is not timed
    for warm in ("f28_grep", "x05_html_text"):
        QUERIES[warm](spark, sf_dir.replace("sf0.1", "sf0.01") if os.path.isdir(sf_dir.replace("sf0.1", "sf0.01")) else sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
