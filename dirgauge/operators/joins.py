"""Joins that stay even when one key holds a large part of the rows, and checked broadcasts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.session import materialise

# Rows of a few narrow columns that any executor can hold.
MAX_BROADCAST_ROWS = 200_000
# Most ids of one lookup that are pushed to a scan one by one (`configure` sets the scan's own limit).
MAX_PUSHED_IDS = 256


def heavy_keys(df: DataFrame, key: str) -> dict:
    """{key: splits} for each value of `key` with more rows than an even task; NULL may be one.

    Counts are summed before they are shuffled, so a hot key is no single task. The total is observed in the
    same pass. Fewer keys than there are tasks can exceed an even share, so only that many come to the driver.
    """
    parts, seen = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), Observation()
    counts = df.groupBy(key).agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n")).limit(2 * parts).collect()
    even = max((seen.get["total"] or 0) // parts, 1)
    return {row[0]: -(-row["n"] // even) for row in top if row["n"] > even}


def lookup_join(
    facts: DataFrame, lookup: DataFrame, key: str, heavy: dict, how: str, spread_by: str
) -> DataFrame:
    """Join `facts` to `lookup`, which has at most one row per `key`.

    Rows of a heavy key are spread over `splits` tasks by a hash of their own `spread_by` column,
    and its single lookup row is repeated once per split; rows without a key, which match nothing,
    are spread too. The result is exactly that of the plain join. `heavy` has at most two entries per
    shuffle task, so its broadcast is bounded by that.
    """
    if not heavy:
        return facts.join(lookup, key, how)
    schema = T.StructType(
        [T.StructField(key, facts.schema[key].dataType), T.StructField("_splits", T.LongType())]
    )
    known = [(k, n) for k, n in heavy.items() if k is not None]
    hot = F.broadcast(facts.sparkSession.createDataFrame(known, schema))
    splits = F.when(F.col(key).isNull(), F.lit(heavy.get(None, 1))).otherwise(
        F.coalesce(F.col("_splits"), F.lit(1))
    )
    salted = facts.join(hot, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), splits.cast("bigint"))
    )
    repeated = lookup.join(hot, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_splits", F.lit(1)) - 1))
    )
    return salted.drop("_splits").join(repeated.drop("_splits"), [key, "_salt"], how).drop("_salt")


def broadcast_if_small(df: DataFrame, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `max_rows` rows, else unchanged.

    For the answer to a point filter: the optimizer cannot tell that it is small, and would shuffle
    the large table it is joined to. The count stops at the limit.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def if_few(df: DataFrame, max_rows: int = MAX_PUSHED_IDS) -> pa.Table | None:
    """The rows of `df` if there are at most `max_rows`, else None. The read stops at the limit."""
    found = df.limit(max_rows + 1).toArrow()
    return found if found.num_rows <= max_rows else None


def having_ids(df: DataFrame, key: str, few: pa.Table) -> DataFrame:
    """The rows of `df` whose `key` is among those of `few`: pushed to the scan, where Bloom filters
    and statistics skip the row groups without one."""
    return df.where(F.col(key).isin(few.column(key).to_pylist()))


def _bit(name: str) -> tuple[Column, Column, Column]:
    """Block, number of the word in it and number of the bit in that, of a column of ids."""
    return F.shiftright(name, 9), F.expr(f"cast(shiftright({name}, 6) & 7 AS int)"), F.expr(f"cast({name} & 63 AS int)")


def id_blocks(ids: DataFrame) -> DataFrame:
    """(_block, _words): the ids of `ids` (one bigint column) as bits, 512 consecutive ones a row; NULL is left out."""
    name = ids.columns[0]
    block, word, bit = _bit(name)
    dealt = ids.where(F.col(name).isNotNull()).select(block.alias("_block"), word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("_mask"))
    words = [F.bit_or(F.when(F.col("_word") == i, F.col("_mask")).otherwise(F.lit(0).cast("bigint"))) for i in range(8)]
    # dealt out first: ids of one block are in all tasks, and partial words are longer than ids
    return dealt.repartition("_block").groupBy("_block").agg(F.array(*words).alias("_words"))


class Keys:
    """Keys that rows of stored tables are chosen by (distinct; one or more columns), in the smallest form that tells them apart.

    Few keys are broadcast as they are. More ids are broadcast as bits, if they lie so close together that this takes no more
    rows, as the ids of an inventory do. Rows are moved only for what is left: keys of several columns are compared where
    the first one, an id, is among the bits.
    """

    def __init__(self, keys: DataFrame, max_rows: int | None = None):
        most = MAX_BROADCAST_ROWS if max_rows is None else max_rows
        self.on, self.keys, self.blocks = keys.columns, keys.distinct(), None
        self.is_small = self.keys.limit(most + 1).count() <= most
        if self.is_small:
            self.keys = F.broadcast(self.keys)
        elif isinstance(keys.schema[self.on[0]].dataType, T.LongType):
            blocks = materialise(id_blocks(keys.select(self.on[0])), "blocks")
            if blocks.count() <= most:
                self.blocks = F.broadcast(blocks)

    def _marked(self, df: DataFrame) -> tuple[DataFrame, Column]:
        """`df` with the words of its blocks, and whether a row's id is among the bits."""
        block, word, bit = _bit(self.on[0])
        marked = df.withColumn("_block", block).join(self.blocks, "_block", "left")
        return marked, F.coalesce(F.bit_get(F.get("_words", word), bit) == 1, F.lit(False))

    def having(self, df: DataFrame) -> DataFrame:
        """The rows of `df` that have one of the keys."""
        if self.blocks is None:
            return df.join(self.keys, self.on, "left_semi").select(*df.columns)
        marked, found = self._marked(df)
        maybe = marked.where(found).select(*df.columns)
        return maybe if len(self.on) == 1 else maybe.join(self.keys, self.on, "left_semi").select(*df.columns)

    def without(self, df: DataFrame) -> DataFrame:
        """The rows of `df` that have none of the keys."""
        if self.blocks is None:
            return df.join(self.keys, self.on, "left_anti").select(*df.columns)
        marked, found = self._marked(df)
        rest = marked.where(~found).select(*df.columns)
        if len(self.on) == 1:
            return rest
        maybe = marked.where(found).select(*df.columns)
        return rest.unionByName(maybe.join(self.keys, self.on, "left_anti").select(*df.columns))

    def flagged(self, df: DataFrame, name: str) -> DataFrame:
        """`df` with a boolean column: whether a row has one of the keys."""
        if self.blocks is None or len(self.on) > 1:
            known = self.keys.withColumn(name, F.lit(True))
            return df.join(known, self.on, "left").withColumn(name, F.coalesce(name, F.lit(False))).select(*df.columns, name)
        marked, found = self._marked(df)
        return marked.select(*df.columns, found.alias(name))


def rows_having(df: DataFrame, key: str, keys: DataFrame | Keys) -> DataFrame:
    """The rows of `df` whose `key` is in `keys` (one column of that name). A few keys are pushed to the scan,
    more are broadcast to it, as they are or as bits; only beyond that are rows moved."""
    few = if_few((keys.keys if isinstance(keys, Keys) else keys).select(key))
    if few is None:
        return (keys if isinstance(keys, Keys) else Keys(keys.select(key))).having(df)
    return having_ids(df, key, few) if few.num_rows else df.limit(0)
