"""Time every registered query and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default: all). Each query first runs once on
the sf0.001 data beside it, to warm up the JVM, then once on the data measured, results written to
Spark's no-op sink. The tables the reports read (closure, roll-ups) are built once beforehand and
timed as `prepare`.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dirgauge.plans.registry import queries  # noqa: E402
from dirgauge.sources.order_tree import OrderTree  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    partitions = cpus if cpus.isdigit() else str(os.cpu_count())
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("dirgauge-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
    )
    spark = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp")).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    wanted = sys.argv[1:] or list(queries())
    warm_dir = str(Path(sf_dir).parent / "sf0.001")

    def run(name: str, data: str) -> float:
        began = time.perf_counter()
        queries()[name](spark, data).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    def prepare(data: str) -> float:
        began = time.perf_counter()
        tables = OrderTree.of(spark, data)
        for name in tables:
            tables[name]
        return time.perf_counter() - began

    times: dict[str, float] = {}
    if Path(warm_dir).exists():
        prepare(warm_dir)
        for name in wanted:
            run(name, warm_dir)
    prepared = prepare(sf_dir)
    for name in wanted:
        times[name] = round(run(name, sf_dir), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over all queries and the derivation of their tables, warm JVM",
                "value": round(sum(times.values()) + prepared, 3),
                "unit": "sec",
                "queries": times,
                "prepare": round(prepared, 3),
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
