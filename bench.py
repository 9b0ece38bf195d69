"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import contextlib
import io
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from webtables.catalog import load  # noqa: E402

HEADLINE = [
    "parse_dom", "scope_items", "resolve_url", "field_regex_all", "sel_predicates", "format_record",
    "classify_outcome", "plan_requests", "lookup_one", "lookup_left_replace", "lookup_in_list",
    "json_wildcard", "json_layers", "flatten_image_tree", "snapshot_with_ttl", "merge_dedupe", "build_index",
    "kb_profile", "kb_attach", "wiki_clean", "wiki_text_record", "stream_extract",
    "task_list_page", "task_header_and_items", "task_json_search",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("webtables-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    times: dict[str, float] = {}
    with contextlib.redirect_stdout(io.StringIO()):
        queries["scope_items"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM and the workers
        for name in only or HEADLINE:
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
