"""Session settings, the shared scratch folder and `as_of` literals."""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Most that one task reads of stored files or of a shuffle, as stored. Ids and lists of ids compress by ten and more, so that a
#: task's sort or hash table is many times that.
TASK_BYTES = {"spark.sql.files.maxPartitionBytes": 32 << 20, "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20}


def configure(spark: SparkSession) -> SparkSession:
    """Pin what results depend on, and let the ids of a point lookup reach the Parquet filters one by
    one. Tables stored by a column of few values are written without sorting whole rows by it first; a task that
    meets more than 8 values sorts the rest. Tasks are kept small; a smaller size that is set stays. Everything else
    (memory, number of partitions) is the cluster's choice."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.parquet.pushdown.inFilterThreshold", "256")
    spark.conf.set("spark.sql.maxConcurrentOutputFileWriters", "8")
    for setting, most in TASK_BYTES.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(setting)) > most:
            spark.conf.set(setting, str(most))
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`.

    Where the setting is absent, a local session gets a fresh temporary folder. A cluster must name
    one: a folder on one machine would vanish with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; never reused."""
    return f"{scratch_root(spark)}/dirgauge/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors, and fixes values (such as generated ids) that a
    recomputed task could otherwise change.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_of_literal(as_of: str | datetime, kind: T.DataType = T.TimestampType()) -> Column:
    """`as_of` (UTC) as a literal of the same timestamp type as the column it is compared with,
    so that the comparison needs no cast on the column and can be pushed to the scan."""
    if isinstance(as_of, datetime):
        if as_of.tzinfo is not None:
            as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
        as_of = as_of.isoformat(sep=" ")
    return F.lit(as_of).cast(kind)
