"""Time the registered queries on one machine and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 1; the median counts, after one warm-up run) and
BENCH_QUERIES (comma list, default all) steer it.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from docspark.plans.queries import QUERIES
from docspark.session import local_session

HEADLINE = "effective_merchant_totals"
ROW_RATES = {
    "normalize_rows": "lineitem",
    "enrich_rows": "lineitem",
    "aggregate_by_merchant": "lineitem",
    "decode_rows": "lineitem",
}


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = local_session(cpus, "16g", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        run_once(spark, name, sf_dir)
        times[name] = round(statistics.median(run_once(spark, name, sf_dir) for _ in range(runs)), 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    rates = {}
    for name, table in ROW_RATES.items():
        if name in times:
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
            rates[name] = round(rows / times[name])
    print(
        json.dumps(
            {
                "metric": HEADLINE if HEADLINE in times else "total",
                "value": times.get(HEADLINE, round(sum(times.values()), 3)),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
