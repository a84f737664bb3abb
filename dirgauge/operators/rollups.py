"""Users and the per-directory and per-user size roll-ups.

All of them start from the usage: `files` summed to one row per (directory, owner). Sums, counts and
maxima over files are then sums, counts and maxima over that much smaller table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def build_usage(files: DataFrame) -> DataFrame:
    return files.groupBy("dir_id", "owner_uid").agg(
        F.sum("size_bytes").alias("bytes"),
        F.count("*").alias("files"),
        F.max("mtime").alias("last_mtime"),
    )


def build_access(files: DataFrame) -> DataFrame:
    """Files and bytes per owner and exact time of last access; files without one are left out."""
    return files.where("atime IS NOT NULL").groupBy("owner_uid", "atime").agg(
        F.count("*").alias("files"), F.sum("size_bytes").alias("bytes")
    )


def access_times(access: DataFrame) -> DataFrame:
    """The access usage of all owners together."""
    return access.groupBy("atime").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def access_hours(times: DataFrame) -> DataFrame:
    """Access times summed per hour."""
    hour = F.date_trunc("hour", "atime").cast(times.schema["atime"].dataType).alias("hour")
    return times.groupBy(hour).agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))


def build_users(files: DataFrame, directories: DataFrame) -> DataFrame:
    """Every uid that owns a file or a directory. `files` may also be the usage."""
    owners = files.select("owner_uid").unionByName(directories.select("owner_uid"))
    return owners.where("owner_uid IS NOT NULL").select(F.col("owner_uid").alias("uid")).distinct()


def direct_stats(usage: DataFrame) -> DataFrame:
    """Bytes and files directly in each directory that has any."""
    return usage.groupBy("dir_id").agg(
        F.sum("bytes").alias("direct_bytes"), F.sum("files").alias("file_count")
    )


def locate_usage(usage: DataFrame, lineage: DataFrame) -> DataFrame:
    """The usage with each directory's ancestors and root, NULL where the directory has no row."""
    return usage.join(lineage.select("dir_id", "ancestors", "root_id"), "dir_id", "left")


def with_direct_stats(lineage: DataFrame, usage: DataFrame) -> DataFrame:
    """The lineage with the totals of each directory's own files, NULL where there are none."""
    return lineage.select("dir_id", "ancestors", "root_id").join(direct_stats(usage), "dir_id", "left")


def in_tree_order(lineage: DataFrame) -> DataFrame:
    """Rows of one subtree in one task, or in neighbouring ones, without splitting by hot keys.

    Read in this order, the rows that reach an ancestor sit together: summing per ancestor is mostly
    done before the shuffle, and each stored file covers few subtrees.
    """
    return lineage.repartitionByRange(F.reverse("ancestors")).sortWithinPartitions("dir_id")


def subtree_stats(lineage: DataFrame, usage: DataFrame) -> DataFrame:
    """Bytes and files at or below each directory that has any.

    One row per directory with files is joined to its ancestor list; only then is it repeated per
    ancestor, so the join moves directories, not (directory, ancestor) pairs. The partial sums
    before the shuffle absorb the roots, which every row reaches.
    """
    return (
        direct_stats(usage)
        .join(lineage.select("dir_id", "ancestors"), "dir_id")
        .select(F.explode("ancestors").alias("dir_id"), "direct_bytes", "file_count")
        .groupBy("dir_id")
        .agg(F.sum("direct_bytes").alias("subtree_bytes"), F.sum("file_count").alias("subtree_count"))
    )


def directory_stats(lineage: DataFrame, as_of: Column) -> DataFrame:
    """Direct and subtree totals for every directory, 0 where there are none.

    `lineage` carries the direct totals. It holds every directory, so one aggregation does: the
    directory's own row (position 0 of its list) gives its direct totals and creates the row of an
    empty one.
    """
    reached = F.when(F.col("file_count").isNull(), F.slice("ancestors", 1, 1)).otherwise(
        F.col("ancestors")
    )
    at_self = F.col("pos") == 0
    return (
        lineage.select("direct_bytes", "file_count", F.posexplode(reached).alias("pos", "dir_id"))
        .groupBy("dir_id")
        .agg(
            F.coalesce(F.sum(F.when(at_self, F.col("direct_bytes"))), F.lit(0)).alias("direct_bytes"),
            F.coalesce(F.sum("direct_bytes"), F.lit(0)).alias("subtree_bytes"),
            F.coalesce(F.sum(F.when(at_self, F.col("file_count"))), F.lit(0)).alias("file_count"),
            F.coalesce(F.sum("file_count"), F.lit(0)).alias("subtree_count"),
        )
        .withColumn("last_computed", as_of)
    )


def user_stats(located: DataFrame) -> DataFrame:
    """Bytes and files per (owner, filesystem root), from the located usage. Files without an owner
    form a NULL uid row, which the audit reports and the full build refuses."""
    return (
        located.where("root_id IS NOT NULL")
        .groupBy(F.col("owner_uid").alias("uid"), F.col("root_id").alias("dir_id"))
        .agg(F.sum("bytes").alias("total_bytes"), F.sum("files").alias("file_count"))
    )
