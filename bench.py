"""Benchmark: run the headline queries over one scale factor and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS``
(default 8), ``BENCH_QUERIES`` (comma list, default the headline set).
Each query is forced end to end with the ``noop`` sink (every row computed,
nothing collected to the driver).  One warm-up query runs first so JVM start
and first-use compilation are not charged to a query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "parse_ssh", "parse_access", "parse_windows", "parse_jsonl", "union_sources",
    "bf_bursts", "it_pairs", "cs_alerts", "sp_alerts", "wa_alerts", "wa_pages",
    "alerts_union", "legacy_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from secspark.plans.queries import QUERIES
    from secspark.session import get_spark

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=cpus, app="secspark-bench")
    QUERIES["severity_from_score"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up

    times: dict[str, float] = {}
    errors: dict[str, str] = {}
    rows = 0
    for name in names:
        t0 = time.perf_counter()
        try:
            df = QUERIES[name](spark, sf_dir)
            df.write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - t0, 3)
        except Exception as exc:  # keep measuring the others; report the failure
            errors[name] = f"{type(exc).__name__}: {str(exc)[:200]}"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rows = events
    total = round(sum(times.values()), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times,
        "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus, "events_rows": rows,
        "spark": spark.version, **({"errors": errors} if errors else {}),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
