"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the number of cores, ``BENCH_QUERIES`` an optional list of ids.
"""

from __future__ import annotations

import json
import os
import re
import time

from heliotab.catalog import all_queries
from heliotab.session import local_session

HEADLINE = (
    "Q1", "Q1_features", "Q2", "Q3", "Q4", "Q5", "S6", "S4", "S8", "S10", "K1", "J1", "J3", "J4", "J6", "J10", "J11", "J11_large",
    "A1", "A2", "A5", "A9", "A12", "A13", "W2", "W3", "W5", "W6", "W7", "W8", "W9", "P8", "P20", "P23", "P25", "P27",
    "F1", "T1", "T3", "U1", "U3",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES", "").replace(",", " ").split() or HEADLINE
    queries, _ = all_queries()
    spark = local_session(cpus, "bench")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds = {}
    for key in wanted:
        start = time.perf_counter()
        queries[key](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
