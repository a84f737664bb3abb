"""Streaming ingest of listings.

Entries are staged as they arrive, each micro-batch in a folder named by its id, so a replayed batch
replaces itself. Parents may arrive in another batch than their entries: ids are given to the staged
whole when the scan is complete. A failed write fails the stream; it resumes from its checkpoint.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dirgauge.operators import tables
from dirgauge.operators.versions import names_in
from dirgauge.plans.build import ledger_rows, take_in
from dirgauge.schemas import LISTING
from dirgauge.session import materialise

def read_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", files_per_trigger: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(LISTING).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def stage_listing(stream: DataFrame, staging: str, checkpoint: str) -> StreamingQuery:
    """Store everything that has arrived, batch by batch."""

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{staging}/batch_id={batch_id}")

    return (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _staged_files(spark: SparkSession, staging: str) -> DataFrame:
    """batch_id, folder and a fingerprint of the names and sizes of its files, per staged batch. The
    files are listed as a job; none is opened."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(staging)
    folder = F.regexp_extract("path", r"\A(.*/batch_id=(\d+))/[^/]+\z", 1)
    batch = F.regexp_extract("path", r"/batch_id=(\d+)/[^/]+\z", 1)
    files = listed.select(batch.alias("batch_id"), folder.alias("folder"), F.xxhash64("path", "length").alias("hash"))
    # a sum that cannot overflow
    return files.groupBy(F.col("batch_id").cast("bigint").alias("batch_id"), "folder").agg(F.sum(F.shiftright("hash", 24)).alias("now"))


def finish_ingest(spark: SparkSession, staging: str, root: str, as_of: str | datetime) -> DataFrame:
    """Resolve what was staged since the last call, append it to the tables, return the failed entries.

    The batches come into the ledger in the same version as their rows, so each is taken in once, wherever a
    run is interrupted. A batch of the ledger whose files have changed since, because its checkpoint was
    lost, is an error: stage into a new folder then. Only names of new batches come to the driver. Nothing
    staged, or nothing new, is no error.
    """
    staging, run = staging.rstrip("/"), f"staging:{staging.rstrip('/')}"
    nothing = spark.range(0).select(F.lit("").alias("path"), F.lit("").alias("error_kind"))
    if not any(n.startswith("batch_id=") for n in names_in(spark, staging)):
        return nothing
    with tables.commit(spark, root, run) as changes:
        done = changes.read("ingest_ledger").where(F.col("run") == run).select("batch_id", "fingerprint")
        found = materialise(_staged_files(spark, staging).join(done, "batch_id", "left"), "staged")
        changed = found.where("fingerprint <> now").agg(F.count("*").alias("n"), F.min("batch_id").alias("first")).first()
        if changed["n"]:
            raise ValueError(f"{changed['n']} batches of {staging}, from {changed['first']} on, were ingested before with other rows")
        fresh = found.where("fingerprint IS NULL").orderBy("batch_id").collect()  # what arrived since the last call
        if not fresh:
            return nothing
        listing = spark.read.schema(LISTING).parquet(*[r["folder"] for r in fresh])
        failed, counts = take_in(changes, listing, as_of, (), run)
        marks = [{"run": run, "batch_id": r["batch_id"], "fingerprint": r["now"]} for r in fresh]
        changes.append(ledger_rows(spark, [marks[0] | counts, *marks[1:]]), "ingest_ledger")
    return failed.select("path", "error_kind")


def stream_totals(stream: DataFrame) -> DataFrame:
    """Running files, bytes and errors (output mode "complete"); the state is one row."""
    good = F.col("error_kind").isNull()
    regular = good & (F.col("entry_type") == "f")
    return stream.groupBy().agg(
        F.count_if(regular).alias("files"),
        F.coalesce(F.sum(F.when(regular, F.col("size_bytes"))), F.lit(0)).alias("bytes"),
        F.count_if(~good).alias("errors"),
    )
