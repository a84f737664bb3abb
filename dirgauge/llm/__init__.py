"""Operators for preparing training text. Nothing else in the library imports this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: Most of a task's rows that go to Python at once. Tasks work on pieces of a megabyte (`words.PIECE_BYTES`), so more only fills memory,
#: in the executor, on the way and in the worker.
BATCH_BYTES = 4 << 20
#: Workers are reused, and one that keeps what it freed holds the most any earlier task needed: memory goes back when it is freed.
WORKER_MEMORY = {
    "ARROW_DEFAULT_MEMORY_POOL": "system",
    "MALLOC_ARENA_MAX": "2",
    "MALLOC_MMAP_THRESHOLD_": str(4 << 20),
    "MALLOC_TRIM_THRESHOLD_": str(16 << 20),
}


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers that share this machine's files import the library from where it lies, and keep them small.

    On a cluster the library is installed or sent with `--py-files`; there the path changes nothing. Settings of
    memory that are there stay, and so does a smaller size of batches.
    """
    here = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(p for p in [here, *paths] if p)
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) > BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))
    return spark
