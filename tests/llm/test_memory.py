"""What Python workers get at once, and what they keep."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from dirgauge import llm
from dirgauge.llm import near_dups, sharding


def test_workers_get_small_batches_and_give_memory_back(spark):
    def seen(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([pa.default_memory_pool().backend_name])], names=["bytes", "pool"])

    llm.reach(spark)
    wide = spark.range(4_000).select(F.repeat(F.lit("x"), 5_000).alias("text")).coalesce(1)
    rows = wide.mapInArrow(seen, "bytes bigint, pool string").collect()
    assert len(rows) > 1 and max(r.bytes for r in rows) < 1.2 * llm.BATCH_BYTES
    assert {r.pool for r in rows} == {"system"}


def test_smaller_batches_stay_and_do_not_change_components(spark):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda i: F.concat(F.lit("w"), (F.pmod("doc_id", F.lit(40)) * 100 + i).cast("string"))))
    docs = spark.range(400).select(F.col("id").alias("doc_id")).withColumn("text", F.concat_ws(" ", text, F.pmod("doc_id", F.lit(3)).cast("string")))
    llm.reach(spark)
    before, found = spark.conf.get(setting), []
    try:
        for size in (before, "4096"):
            spark.conf.set(setting, size)
            found.append({tuple(r) for r in near_dups.near_duplicates(docs).collect()})
            assert spark.conf.get(setting) == size
    finally:
        spark.conf.set(setting, before)
    assert found[0] == found[1] and len({r[2] for r in found[0]}) == 40


def test_a_bucket_is_no_more_than_a_batch(spark):
    assert sharding.BUCKET_BYTES <= llm.BATCH_BYTES
    docs = spark.range(12).select(F.col("id").alias("doc_id"), F.repeat(F.lit("y"), 1 << 20).alias("text"))
    out = sharding.shard(docs, 1).select("doc_id", "slot").collect()
    assert sorted(r.slot for r in out) == sorted(r.doc_id for r in out) == list(range(12))
