"""Directories numbered so that every subtree is a range of numbers.

In the order of the root-first ancestor lists a directory comes right before all that is below it. `pre` is its
number in that order, `last` that of the last directory at or below it. With running sums of the files of
all directories in that order, what a subtree holds is a difference of two of them, and its directories are
those with `pre` in a range; pairs of an ancestor and a descendant are not needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirgauge.operators.joins import broadcast_if_small
from dirgauge.operators.tree import assign_ids
from dirgauge.session import materialise

#: Directories that are numbered through in one piece.
BLOCK = 1 << 16


def build_intervals(lineage: DataFrame) -> DataFrame:
    """dir_id, pre, last, depth, parent_id (the next in the lineage), and bytes and files before the directory and through its subtree, from the lineage
    with its direct totals. Directories without a stored parent are tops, like roots.

    Rows are sorted in ranges and numbered by an offset per task; sums run within blocks of numbers and are
    moved by an offset per block. Where the next directory in order is not below, all that end here are a
    beginning of the ancestor list: each directory ends once, so that gives a row per directory.
    """
    path = F.reverse("ancestors")
    totals = [F.coalesce("direct_bytes", F.lit(0)).alias("bytes"), F.coalesce("file_count", F.lit(0)).alias("files")]
    rows = lineage.select("dir_id", "ancestors", F.size("ancestors").alias("depth"), *totals)
    numbered = assign_ids(rows.repartitionByRange(path).sortWithinPartitions(path), "pre", 0)
    numbered = numbered.withColumn("block", F.expr(f"(pre - 1) div {BLOCK}"))

    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    sums = numbered.groupBy("block").agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    sums = sums.select("block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_so_far") for c in ("bytes", "files")])
    following = numbered.where(f"(pre - 1) % {BLOCK} = 0").select((F.col("block") - 1).alias("block"), F.col("depth").alias("edge"))
    blocks = materialise(sums.join(following, "block", "left"), "blocks")

    inside = Window.partitionBy("block").orderBy("pre")
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = numbered.join(broadcast_if_small(blocks), "block")
    through = [(F.col(f"{c}_so_far") + F.sum(c).over(running)).alias(f"{c}_through") for c in ("bytes", "files")]
    below = F.coalesce(F.lead("depth").over(inside), "edge", F.lit(1)).alias("next")
    placed = materialise(placed.select("dir_id", "pre", "depth", "ancestors", "bytes", "files", below, *through), "placed")

    ending = F.slice("ancestors", F.lit(1), F.col("depth") - F.col("next") + 1)
    ends = placed.select(F.explode(ending).alias("dir_id"), F.col("pre").alias("last"), "bytes_through", "files_through")
    starts = placed.select(
        "dir_id", "pre", "depth", F.try_element_at("ancestors", F.lit(2)).alias("parent_id"), (F.col("bytes_through") - F.col("bytes")).alias("bytes_before"), (F.col("files_through") - F.col("files")).alias("files_before")
    )
    return starts.join(ends, "dir_id").select("dir_id", "pre", "last", "depth", "parent_id", "bytes_before", "bytes_through", "files_before", "files_through")


def subtree_sums(intervals: DataFrame) -> DataFrame:
    """Bytes and files at or below each directory that has any."""
    return intervals.where("files_through > files_before").select("dir_id", *_differences())


def _differences() -> list[Column]:
    return [
        (F.col("bytes_through") - F.col("bytes_before")).alias("subtree_bytes"),
        (F.col("files_through") - F.col("files_before")).alias("subtree_count"),
    ]


def child_totals(intervals: DataFrame) -> DataFrame:
    """parent_id, dir_id and the totals of every directory, 0 where there are none. Directories without a
    stored parent have none here."""
    return intervals.select("parent_id", "dir_id", *_differences())
