"""Time every registered job on one scale factor and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each job is executed to completion with the ``noop`` sink (the whole plan runs,
nothing is collected to the driver).  After one warm-up job (JVM start-up,
file listing), every job is timed ``BENCH_REPEAT`` times (default 3) and its
median is reported, which also absorbs the first run's code generation;
``value`` is the sum of the medians.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillroll.plans.catalog import QUERIES  # noqa: E402
from tillroll.session import build_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "3")))
    only = [p for p in os.environ.get("BENCH_ONLY", "").split(",") if p]
    scratch = tempfile.mkdtemp(prefix="tillroll-bench-")
    spark = build_session(
        master=f"local[{cpus}]", app="tillroll-bench", shuffle_partitions=cpus * 2,
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
               "spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
               "spark.local.dir": os.path.join(scratch, "local")})
    names = [n for n in QUERIES if not only or any(n.startswith(p) for p in only)]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run(names[0])               # warm-up: JVM, file listing, parquet footers
    timings = {}
    for name in names:
        timings[name] = round(statistics.median(run(name) for _ in range(repeat)), 4)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum of per-job median wall time",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf.group(1)) if sf else sf_dir,
        "cpus": cpus,
        "repeat": repeat,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
