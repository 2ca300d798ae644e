"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully materialised with the ``noop`` sink (every row and
column computed, nothing collected to the driver). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "articles",
    "reading_rollup",
    "main_content_density",
    "page_markdown",
    "page_links",
    "url_gate",
    "resolved_gate",
    "gate_order",
    "header_request_clean",
    "tracker_antijoin",
    "final_outcome",
    "merge_fallback",
    "outcome_rollup",
    "in_flight",
    "resolve_redirects",
    "chunk_limit",
    "assemble_chunks",
    "stream_request_state",
    "stream_blocklist",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("webtide-bench")
        .config("spark.sql.shuffle.partitions", str(max(8, cpus * 2)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="webtide-bench-ckpt-"))
    from webtide.plans.registry import all_queries
    from webtide.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    qs = all_queries()
    # warm-up on the smallest scale: JVM JIT, generated-code cache, Python
    # workers — the timed runs then measure execution, not compilation
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(small):
        small = sf_dir
    for name in HEADLINE:
        qs[name](spark, small).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    planning: dict[str, float] = {}
    for name in HEADLINE:
        samples, plans = [], []
        for _ in range(runs):
            t0 = time.perf_counter()
            df = qs[name](spark, sf_dir)
            df._jdf.queryExecution().executedPlan()
            plans.append(time.perf_counter() - t0)
            df.write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(samples), 3)
        planning[name] = round(statistics.median(plans), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        # of the times above: building and planning (with the jobs that a
        # query runs while it is built, such as checkpoints and streams)
        "planning": planning,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
