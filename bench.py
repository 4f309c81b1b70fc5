"""Time the registered headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 3, median after one warm-up). Results are forced with a
``noop`` write, which computes every row and column and keeps nothing.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from catalog.registry import ALL_QUERIES
from ratewright.session import local_session


def seconds(run, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def scale(sf_dir: str) -> float | str:
    name = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    try:
        return float(name)
    except ValueError:
        return name


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or list(ALL_QUERIES)
    spark = local_session("bench")
    timed = {}
    for name in names:
        run = ALL_QUERIES[name][0]
        seconds(run, spark, sf_dir)
        timed[name] = round(statistics.median(seconds(run, spark, sf_dir) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timed.values()), 3),
                "unit": "sec",
                "queries": timed,
                "sf": scale(sf_dir),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
