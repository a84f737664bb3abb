"""From listing to finished inventory."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirgauge.operators import rollups, tables
from dirgauge.operators.intervals import build_intervals, child_totals
from dirgauge.operators.tree import build_lineage, closure_of, max_id, number_rows, resolve_tree
from dirgauge.operators.versions import Commit
from dirgauge.schemas import INGEST_LEDGER
from dirgauge.session import as_of_literal, materialise, scratch_path
from dirgauge.sources.listing import split_repeated, split_repeated_files, stage_entries


def ingest(
    spark: SparkSession,
    root: str,
    listing: DataFrame,
    as_of: str | datetime,
    roots: Iterable[str] = (),
    run: str | None = None,
) -> DataFrame:
    """Resolve a listing, append it to the tables and return the entries that are not stored.

    Their kinds are those of the scan, and NoPath, BadType, NoSize, Repeated (listed before) and NoParent (a
    file whose directory is neither listed nor stored). They are kept in `ingest_errors`, the numbers of
    entries in `ingest_ledger`, both in the same version as the rows: listed = directories + files + failed
    + skipped. A `run` that the ledger has is not taken in again.
    """
    if run is not None:
        stored = tables.open_tables(spark, root)
        if not stored["ingest_ledger"].where(F.col("run") == run).isEmpty():
            return stored["ingest_errors"].where(F.col("run") == run).select("path", "error_kind")
    with tables.commit(spark, root, run) as changes:
        failed, counts = take_in(changes, listing, as_of, roots, run)
        changes.append(ledger_rows(spark, [{"run": run, **counts}]), "ingest_ledger")
    return failed.select("path", "error_kind")


def ledger_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    fields = INGEST_LEDGER.fields
    return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in rows], INGEST_LEDGER).coalesce(1)


def take_in(
    changes: Commit, listing: DataFrame, as_of: str | datetime, roots: Iterable[str], run: str | None
) -> tuple[DataFrame, dict]:
    """Add a listing to a commit; returns the entries that are not stored and the numbers of all."""
    spark = changes.spark
    entries, seen = stage_entries(listing, scratch_path(spark, "entries"))

    def part(name: str) -> DataFrame:
        return entries.where(F.col("part") == name).drop("part", "kind")

    dirs, repeated = split_repeated(part("d"))
    files = number_rows(part("f"), "file_id", max_id(changes.read("files"), "file_id"))
    files, again = split_repeated_files(files)
    paths = changes.read("directory_paths")
    directories, resolved = resolve_tree(dirs, files, max_id(changes.read("directories"), "dir_id"), 0, paths, roots)
    lost = resolved.where("dir_id IS NULL").select("path", F.lit("NoParent").alias("error_kind"))
    known, found = tables.append_inventory(changes, directories, resolved.where("dir_id IS NOT NULL"), as_of)
    bad = entries.where("part = 'failed'").select("path", F.col("kind").alias("error_kind"))
    failed = reduce(DataFrame.unionByName, [bad, repeated, again, lost]).withColumn("run", F.lit(run).cast("string"))
    failed = changes.append(failed, "ingest_errors")
    counts = {"listed": seen["listed"], "directories": known.count(), "files": found.count(), "failed": failed.count(), "skipped": seen["skipped"]}
    return failed, counts


def usage_layout(files: DataFrame, lineage: DataFrame) -> DataFrame:
    """`directory_usage`, stored by owner: a question about one user reads that user's rows only."""
    usage = rollups.locate_usage(rollups.build_usage(files), lineage)
    return usage.repartitionByRange("owner_uid", "dir_id").sortWithinPartitions("owner_uid", "dir_id")


def access_layout(files: DataFrame) -> DataFrame:
    """`access_usage`, stored by owner and time, so that one user's ages read that user's rows only."""
    access = rollups.build_access(files).repartitionByRange("owner_uid", "atime")
    return access.sortWithinPartitions("owner_uid", "atime")


def times_layout(access: DataFrame) -> DataFrame:
    """`access_times`, stored by time, so that an hour is in few row groups."""
    return rollups.access_times(access).repartitionByRange("atime").sortWithinPartitions("atime")


def intervals_layout(lineage: DataFrame) -> DataFrame:
    """`directory_intervals`, stored by number: a subtree is a run of rows."""
    return build_intervals(lineage).repartitionByRange("pre").sortWithinPartitions("pre")


def children_layout(intervals: DataFrame) -> DataFrame:
    """`child_totals`, stored by parent: the children of a directory are in few row groups."""
    return child_totals(intervals).repartitionByRange("parent_id", "dir_id").sortWithinPartitions("parent_id", "dir_id")


def stats_layout(stats: DataFrame) -> DataFrame:
    """`directory_stats`, largest totals first in each file, so that they share a row group."""
    return stats.sortWithinPartitions(F.desc("subtree_bytes"))


def lineage_layout(lineage: DataFrame, usage: DataFrame) -> DataFrame:
    """`directory_lineage`, stored in tree order."""
    return rollups.in_tree_order(rollups.with_direct_stats(lineage, usage))


def closure_layout(lineage: DataFrame) -> DataFrame:
    """`directory_closure`. The pairs of a subtree lie in the few tasks that hold it in the stored
    lineage, so they are only sorted there, not shuffled."""
    return closure_of(lineage).sortWithinPartitions("ancestor_id", "descendant_id")


def finish(spark: SparkSession, root: str, as_of: str | datetime) -> None:
    """Users, closure, directory statistics, user statistics, run log, in this order.

    Closure and statistics are recomputed from the files and directories, so a second run changes
    nothing but the run log. A failing step leaves the later ones undone.
    """

    def stored(table: str) -> DataFrame:
        return tables.read_table(spark, root, table)

    lineage = build_lineage(stored("directories"))
    tables.overwrite_table(usage_layout(stored("files"), lineage), root, "directory_usage")
    tables.overwrite_table(access_layout(stored("files")), root, "access_usage")

    with tables.commit(spark, root) as changes:
        changes.overwrite(times_layout(changes.read("access_usage")), "access_times")
        changes.overwrite(rollups.access_hours(changes.read("access_times")), "access_hours")

    owners = rollups.build_users(stored("directory_usage"), stored("directories"))
    # Known users keep their rows: the new ones are appended, nothing is rewritten.
    tables.append_table(tables.absent_rows(stored("users"), owners, ["uid"]), root, "users")

    tables.overwrite_table(
        lineage_layout(lineage, stored("directory_usage")), root, "directory_lineage"
    )
    tables.overwrite_table(closure_layout(stored("directory_lineage")), root, "directory_closure")
    tables.overwrite_table(intervals_layout(stored("directory_lineage")), root, "directory_intervals")

    stats = rollups.directory_stats(stored("directory_lineage"), as_of_literal(as_of))
    with tables.commit(spark, root) as changes:
        changes.overwrite(stats_layout(stats), "directory_stats")
        tables.note_maxima(changes)
        changes.overwrite(children_layout(changes.read("directory_intervals")), "child_totals")

    totals = materialise(rollups.user_stats(stored("directory_usage")), "user-stats")
    if not totals.where(F.col("uid").isNull()).isEmpty():
        raise ValueError("files without owner: user_stats.uid must not be NULL")
    merged = tables.upsert(stored("user_stats"), totals, ["uid", "dir_id"])
    tables.replace_from_itself(merged, root, "user_stats")

    tables.log_run(spark, root, as_of)
