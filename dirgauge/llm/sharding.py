"""Shuffled shards by two passes: scatter into buckets that fit in memory, then shuffle each bucket."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from dirgauge.llm import reach
from dirgauge.operators.joins import broadcast_if_small
from dirgauge.session import materialise

SEED = 11
#: What one bucket holds, about.
BUCKET_ROWS, BUCKET_BYTES = 20_000, 4 << 20


def shard_of(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard with the highest hash of key and shard: one shard more takes rows only into itself."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    drawn = [F.struct(F.xxhash64(F.lit(seed), name, F.lit(s)).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)]
    return drawn[0]["shard"] if shards == 1 else F.greatest(*drawn)["shard"]


def _fisher_yates(n: int, *seed: int) -> np.ndarray:
    """A uniform order of n rows; numpy's permutation is the Fisher-Yates shuffle."""
    return np.random.Generator(np.random.PCG64(list(seed))).permutation(n)


def shuffle(docs: DataFrame, size: Column, content: Column, shards: int = 8, seed: int = SEED) -> DataFrame:
    """`row` (a struct of all columns), shard, slot for every row of `docs` (doc_id; any others).

    The shard follows from doc_id and the number of shards; slots run from 0 without gaps within a
    shard. `size` is a row's bytes, `content` a hash of what tells rows of one doc_id apart. The first
    pass scatters a shard's rows over buckets by a seeded hash of doc_id and content, the second puts a
    bucket's rows in the order of that hash and shuffles them with the bucket's own seed, so that the
    result does not depend on how rows arrived. Rows alike in both that are more than a bucket holds are
    spread by their place in the input; they are interchangeable. A NULL doc_id is a key like any.
    """
    spark = reach(docs.sparkSession)
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    draw = F.xxhash64(F.lit(seed), name, content)
    rows = docs.select(F.struct("*").alias("row"), shard_of(F.col("doc_id"), shards, seed).alias("shard"), draw.alias("draw"), size.cast("bigint").alias("bytes"))
    narrow = rows.select("shard", "draw", "bytes")
    totals = narrow.groupBy("shard").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes")).collect()  # a row per shard
    buckets = [1] * shards
    for t in totals:
        buckets[t["shard"]] = max(1, math.ceil(t["rows"] / BUCKET_ROWS), math.ceil((t["bytes"] or 0) / BUCKET_BYTES))
    alike = materialise(narrow.groupBy("draw").count().where(F.col("count") > BUCKET_ROWS), "alike")
    if not alike.isEmpty():
        rows = rows.withColumn("place", F.monotonically_increasing_id())
        rows = rows.join(broadcast_if_small(alike), "draw", "left").withColumn(
            "scatter", F.when(F.col("count").isNotNull(), F.xxhash64("draw", "place")).otherwise(F.xxhash64("draw"))
        )
    else:
        rows = rows.withColumn("scatter", F.xxhash64("draw"))
    share = F.element_at(F.array(*[F.lit(b) for b in buckets]), F.col("shard") + 1)
    rows = rows.select("row", "shard", "draw", F.pmod("scatter", share).cast("int").alias("bucket"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "bucket").count()
    offsets = offsets.select("shard", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    rows = rows.join(offsets, ["shard", "bucket"])  # before the groups are made, which then need no second shuffle

    def arrange(table: pa.Table) -> pa.Table:
        n = table.num_rows
        shard, bucket = table.column("shard")[0].as_py(), table.column("bucket")[0].as_py()
        order = np.argsort(table.column("draw").to_numpy(), kind="stable")
        order = order[_fisher_yates(n, seed, shard, bucket)]
        slots = table.column("offset")[0].as_py() + np.arange(n)
        return table.take(pa.array(order)).select(["row", "shard"]).append_column("slot", pa.array(slots))

    schema = T.StructType([rows.schema["row"], T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    return rows.groupBy("shard", "bucket").applyInArrow(arrange, schema)


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (NULL: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """`docs` (doc_id, text) with shard and slot; columns that already have these names are replaced."""
    placed = shuffle(docs, text_bytes(F.col("text")), F.xxhash64("text"), shards, seed)
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*kept, "shard", "slot")


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard, its rows in the order of their slots within and across the files."""
    ordered = sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    ordered.write.partitionBy("shard").parquet(path)
