"""A scan of part of the tree as changes to the inventory: totals are maintained, not recomputed.

The scan is compared with what is stored for the directories it covers. Files and directories are inserted,
changed or removed; what that adds to or takes from each directory is carried up its list of ancestors as
signed sums. Only covered directories, their ancestors and their owners are read, and only the files
of the tables that hold them are written anew.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dirgauge.functions import file_name
from dirgauge.operators import rollups, tables
from dirgauge.operators.joins import Keys, broadcast_if_small, heavy_keys, lookup_join, rows_having
from dirgauge.operators.tree import assign_ids, build_lineage, closure_of, max_id, number_rows, parents_of, with_parent
from dirgauge.operators.versions import Commit
from dirgauge.plans.build import ledger_rows
from dirgauge.session import as_of_literal, materialise, scratch_path
from dirgauge.sources.listing import split_repeated, split_repeated_files, stage_entries

_STAT = ["size_bytes", "owner_uid", "atime", "mtime", "ctime", "inode", "hardlink_count"]


def _named(entries: DataFrame) -> DataFrame:
    return entries if "filesystem" in entries.columns else entries.withColumn("filesystem", F.lit(""))


def _scanned_directories(changes: Commit, dirs: DataFrame) -> DataFrame:
    """The listed directories with the ids they have, or new ones; `parent_id` of new ones; `known`."""
    keys = dirs.select("filesystem", "path")
    index = rows_having(changes.read("directory_paths"), "path", keys.select("path").distinct())
    ids = index.join(broadcast_if_small(keys), ["filesystem", "path"], "left_semi")
    ids = materialise(ids.groupBy("filesystem", "path").agg(F.max("dir_id").alias("dir_id")), "known-paths")
    found = dirs.join(ids, ["filesystem", "path"], "left")
    known = found.where("dir_id IS NOT NULL").withColumn("known", F.lit(True))
    fresh = assign_ids(found.where("dir_id IS NULL").drop("dir_id"), "dir_id", max_id(changes.read("directories"), "dir_id"))
    return materialise(known.unionByName(fresh.withColumn("known", F.lit(False))), "scanned")


def _placed(entries: DataFrame, scanned: DataFrame, changes: Commit) -> DataFrame:
    """Entries with the id of their directory, listed or stored, as `_parent_id`."""
    entries = with_parent(entries)
    by_path = parents_of([entries], scanned, changes.read("directory_paths"))
    return lookup_join(entries, by_path, "_parent", heavy_keys(entries, "_parent"), "left", "path").drop("_parent", "_above")


def _gone(changes: Commit, scanned: DataFrame, failed: DataFrame) -> DataFrame:
    """dir_id of every stored directory at or below one that a covered directory does not list any more."""
    covered = scanned.where("known").select(F.col("dir_id").alias("parent_id"))
    children = rows_having(changes.read("directories"), "parent_id", covered).select("dir_id", "path")
    tops = Keys(scanned.select("dir_id")).without(children)
    tops = tops.join(broadcast_if_small(failed.select("path").distinct()), "path", "left_anti")
    tops = materialise(tops.select("dir_id"), "tops")
    if tops.isEmpty():
        return tops
    # only those with something below them are looked for in the lists of ancestors
    parents = rows_having(changes.read("directories"), "parent_id", tops.select(F.col("dir_id").alias("parent_id")))
    inner = materialise(parents.select(F.col("parent_id").alias("above")).distinct(), "inner-tops")
    if inner.isEmpty():
        return tops
    below = changes.read("directory_lineage").select("dir_id", F.explode("ancestors").alias("above"))
    return materialise(Keys(inner).having(below).select("dir_id").unionByName(tops).distinct(), "gone")


def file_changes(stored: DataFrame, listed: DataFrame, covered: DataFrame, failed: DataFrame) -> DataFrame:
    """op ('insert', 'change', 'remove', 'same'), file_id, dir_id, filename, was (the stored attributes) and
    now (the listed ones) for the files of the directories concerned.

    A stored file that is not listed is removed if its directory is among `covered` (dir_id, gone) and
    the file is not among `failed` (dir_id, filename). Both sides have one row per (dir_id, filename).
    """
    sides = [df.select("dir_id", "filename", F.col("file_id").alias(f"{name}_id"), F.struct(*_STAT).alias(name)) for df, name in ((stored, "was"), (listed, "now"))]
    # what decides on a file that is not listed is looked up for the stored ones, before the sides are joined
    was = Keys(covered.where("gone").select("dir_id")).flagged(sides[0], "gone")
    was = Keys(covered.select("dir_id")).flagged(was, "covered")
    was = Keys(failed).flagged(was, "failed")
    both = was.join(sides[1], ["dir_id", "filename"], "full")
    op = (
        F.when(F.col("was").isNull(), "insert")
        .when(F.col("now").isNull(), F.when(F.expr("gone OR covered AND NOT failed"), "remove").otherwise("same"))
        .when(F.col("was").eqNullSafe(F.col("now")), "same")
        .otherwise("change")
    )
    return both.select(op.alias("op"), F.coalesce("was_id", "now_id").alias("file_id"), "dir_id", "filename", "was", "now")


def signed_sums(changed: DataFrame, *keys: str) -> DataFrame:
    """What the changed files add per key: `bytes` and `files`, negative for what they take."""
    kept = [k for k in keys if k == "dir_id"]
    parts = []
    for side, sign in (("was", -1), ("now", 1)):
        columns = [F.col(k) if k in kept else F.col(f"{side}.{k}").alias(k) for k in keys]
        parts.append(changed.where(F.col(side).isNotNull()).select(*columns, (F.col(f"{side}.size_bytes") * sign).alias("bytes"), F.lit(sign).cast("bigint").alias("files")))
    return parts[0].unionByName(parts[1]).groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))


def _new_lineage(changes: Commit, scanned: DataFrame) -> DataFrame:
    """dir_id, ancestors, root_id of the new directories: their list among the new ones, then that of the
    stored directory it ends below."""
    fresh = scanned.where("NOT known").select("dir_id", "parent_id")
    lists = build_lineage(fresh)
    top = fresh.select(F.col("dir_id").alias("top"), "parent_id")
    lists = materialise(lists.withColumn("top", F.element_at("ancestors", -1)).join(top, "top"), "new-lineage")
    above = rows_having(changes.read("directory_lineage"), "dir_id", lists.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("dir_id")).distinct())
    above = above.select(F.col("dir_id").alias("parent_id"), F.col("ancestors").alias("more"), F.col("root_id").alias("stored_root"))
    whole = F.concat("ancestors", F.coalesce("more", F.array().cast("array<bigint>")))
    root = F.coalesce("stored_root", "root_id")
    return materialise(lists.join(broadcast_if_small(above), "parent_id", "left").select("dir_id", whole.alias("ancestors"), root.alias("root_id")), "new-lineage")


def _replace_sums(changes: Commit, table: str, keys: list[str], names: dict[str, str], more: DataFrame) -> None:
    """Add signed sums to the rows of a table; rows that come to no files go. More sums than are broadcast are added to all rows
    of the table at once: to find the rows that have them would move as many, and more than once."""
    def summed(old: DataFrame) -> DataFrame:
        old = old.select(*keys, *[F.col(c).alias(n) for n, c in names.items()])
        sums = old.unionByName(more.select(*keys, *names)).groupBy(*keys).agg(*[F.sum(n).alias(c) for n, c in names.items()])
        return sums.where(F.col(names["files"]) > 0)

    changed = Keys(more.select(*keys))
    if changed.is_small:
        stored = rows_having(changes.read(table), keys[0], more.select(keys[0]).distinct())
        changes.replace(table, changed, summed(changed.having(stored)))
    else:
        changes.overwrite(summed(changes.read(table)).sortWithinPartitions(*keys), table)


def apply_delta(spark: SparkSession, root: str, listing: DataFrame, as_of: str | datetime, run: str | None = None) -> DataFrame:
    """Apply a scan of some directories to a finished inventory; returns what the scan could not store.

    Every listed directory was read anew: its stored entries that are not listed are removed, directories with
    all below them. What failed keeps its stored state. Files of directories that are not listed are
    added or changed only. The numbers of directories in tree order are left to the next `finish`. Known paths keep their ids, and a known directory its parent; unchanged rows keep
    their `last_seen`. The result is that of a full build on the merged listing, in one version. A `run` that
    the ledger has is not applied again. Files without owner are an error, as in `finish`.
    """
    if run is not None and not tables.read_table(spark, root, "ingest_ledger").where(F.col("run") == run).isEmpty():
        return tables.read_table(spark, root, "ingest_errors").where(F.col("run") == run).select("path", "error_kind")
    with tables.commit(spark, root, run) as changes:
        failed, counts = _apply(changes, listing, as_of_literal(as_of))
        failed = changes.append(failed.withColumn("run", F.lit(run).cast("string")), "ingest_errors")
        changes.append(ledger_rows(spark, [{"run": run, **counts, "failed": failed.count()}]), "ingest_ledger")
        last = max_id(changes.read("crawl_runs"), "id")
        changes.append(spark.range(1).select(F.lit(last + 1).alias("id"), as_of_literal(as_of).alias("finished_at")), "crawl_runs")
    return failed.select("path", "error_kind")


def _apply(changes: Commit, listing: DataFrame, seen: Column) -> tuple[DataFrame, dict]:
    spark = changes.spark
    entries, counted = stage_entries(listing, scratch_path(spark, "entries"))

    def part(name: str) -> DataFrame:
        return _named(entries.where(F.col("part") == name).drop("part", "kind"))

    dirs, repeated = split_repeated(part("d"))
    scanned = _scanned_directories(changes, dirs)
    scanned = materialise(_placed(scanned, scanned, changes).withColumnRenamed("_parent_id", "parent_id"), "scanned")
    files, again = split_repeated_files(number_rows(part("f"), "file_id", max_id(changes.read("files"), "file_id")))
    files = materialise(_placed(files, scanned, changes).withColumnRenamed("_parent_id", "dir_id"), "files")
    lost = files.where("dir_id IS NULL").select("path", F.lit("NoParent").alias("error_kind"))
    files = files.where("dir_id IS NOT NULL")
    bad = entries.where("part = 'failed'").select("path", F.col("kind").alias("error_kind"))

    # which files were inserted, changed, removed
    gone = _gone(changes, scanned, bad)
    covered = scanned.where("known").select("dir_id", F.lit(False).alias("gone")).unionByName(gone.withColumn("gone", F.lit(True)))
    touched = Keys(materialise(covered.select("dir_id").unionByName(files.select("dir_id")).distinct(), "touched"))
    listed = files.withColumn("filename", file_name(F.col("path"))).withColumnsRenamed({"uid": "owner_uid", "nlink": "hardlink_count"})
    unread = _placed(_named(entries.where("part = 'failed' AND path IS NOT NULL").select("path")), scanned, changes)
    unread = unread.where("_parent_id IS NOT NULL").select(F.col("_parent_id").alias("dir_id"), file_name(F.col("path")).alias("filename")).distinct()
    all_files = materialise(file_changes(rows_having(changes.read("files"), "dir_id", touched), listed, covered, unread), "file-changes")
    changed = all_files.where("op <> 'same'")
    if not changed.where("op <> 'remove' AND now.owner_uid IS NULL").isEmpty():
        raise ValueError("files without owner: user_stats.uid must not be NULL")
    written = changed.where("op <> 'remove'").select("file_id", "dir_id", "filename", "now.*", seen.alias("last_seen"))
    changes.replace("files", changed.where("op <> 'insert'").select("dir_id", "file_id"), written)

    # directories and their places
    stored = rows_having(changes.read("directories"), "dir_id", scanned.where("known").select("dir_id"))
    stored = stored.select("dir_id", F.struct("owner_uid", "mtime").alias("was"), F.col("parent_id").alias("stored_parent"))
    now = scanned.withColumnRenamed("uid", "owner_uid").join(broadcast_if_small(stored), "dir_id", "left")
    now = now.where(~F.col("known") | ~F.col("was").eqNullSafe(F.struct("owner_uid", "mtime")))
    now = now.withColumn("parent_id", F.when(F.col("known"), F.col("stored_parent")).otherwise(F.col("parent_id"))).withColumn("last_seen", seen)
    now = materialise(now, "directory-changes")
    removed = gone.select("dir_id")
    changes.replace("directories", removed.unionByName(now.where("known").select("dir_id")), now)
    fresh = scanned.where("NOT known")
    changes.replace("directory_paths", removed, tables.paths_of(fresh))
    new_lists = _new_lineage(changes, scanned)

    # signed sums up the ancestors, before the lists of removed directories go
    more = materialise(signed_sums(changed, "dir_id", "owner_uid"), "signed")
    lists = rows_having(changes.read("directory_lineage"), "dir_id", more.select("dir_id").distinct()).select("dir_id", "ancestors", "root_id")
    located = materialise(more.join(broadcast_if_small(lists.unionByName(new_lists)), "dir_id"), "located")
    at_self = F.col("pos") == 0
    reached = located.select("bytes", "files", "ancestors", F.posexplode("ancestors").alias("pos", "dir_id"))
    reached = reached.withColumn("parent_id", F.try_element_at("ancestors", F.col("pos") + 2))
    sums = reached.groupBy("dir_id").agg(
        F.max("parent_id").alias("parent_id"),
        F.sum(F.when(at_self, F.col("bytes")).otherwise(0)).alias("direct_bytes"),
        F.sum("bytes").alias("subtree_bytes"),
        F.sum(F.when(at_self, F.col("files")).otherwise(0)).alias("file_count"),
        F.sum("files").alias("subtree_count"),
    )
    totals = ["direct_bytes", "subtree_bytes", "file_count", "subtree_count"]
    zero = [F.lit(0).cast("bigint").alias(c) for c in totals]
    known = sums.unionByName(fresh.select("dir_id", "parent_id", *zero)).unionByName(removed.select("dir_id", F.lit(None).cast("bigint").alias("parent_id"), *zero))
    added = [F.max("parent_id").alias("parent_id"), *[F.sum(c).alias(c) for c in totals]]
    sums = materialise(known.groupBy("dir_id").agg(*added), "sums")
    summed, left_out = Keys(sums.select("dir_id")), Keys(removed)
    stats = rows_having(changes.read("directory_stats"), "dir_id", summed)
    stats = stats.select("dir_id", *totals).unionByName(sums, allowMissingColumns=True).groupBy("dir_id").agg(*added)
    stats = materialise(left_out.without(stats).withColumn("last_computed", seen), "stats")
    changes.replace("directory_stats", summed, stats)
    tables.note_maxima(changes)
    if changes.tables.get("child_totals"):  # none in an inventory that was finished before this table was there
        changes.replace("child_totals", summed, stats)

    owners = located.where("root_id IS NOT NULL").groupBy(F.col("owner_uid").alias("uid"), F.col("root_id").alias("dir_id")).agg(F.sum("bytes").alias("bytes"), F.sum("files").alias("files"))
    _replace_sums(changes, "user_stats", ["uid", "dir_id"], {"bytes": "total_bytes", "files": "file_count"}, materialise(owners, "owners"))
    access = materialise(signed_sums(changed, "owner_uid", "atime").where("atime IS NOT NULL AND (bytes <> 0 OR files <> 0)"), "access")
    _replace_sums(changes, "access_usage", ["owner_uid", "atime"], {"files": "files", "bytes": "bytes"}, access)

    times = materialise(rollups.access_times(access), "times")
    _replace_sums(changes, "access_times", ["atime"], {"files": "files", "bytes": "bytes"}, times)
    _replace_sums(changes, "access_hours", ["hour"], {"files": "files", "bytes": "bytes"}, materialise(rollups.access_hours(times), "hours"))

    # the rows of the directories concerned: usage from their files, lists with their own totals
    left = all_files.where("op <> 'remove'").select("dir_id", F.coalesce("now", "was").alias("f")).select("dir_id", "f.*")
    usage = materialise(rollups.build_usage(left), "usage")
    own = rows_having(changes.read("directory_lineage"), "dir_id", touched).select("dir_id", "ancestors", "root_id")
    own = materialise(left_out.without(own).unionByName(new_lists), "own-lineage")
    changes.replace("directory_usage", touched, rollups.locate_usage(usage, own))
    changes.replace("directory_lineage", touched, rollups.with_direct_stats(own, usage))
    changes.clear("directory_intervals")  # numbers of all later directories move: `finish` makes them anew
    changes.replace("directory_closure", removed.select(F.col("dir_id").alias("descendant_id")), closure_of(new_lists))
    uids = rollups.build_users(usage, now)
    changes.append(tables.absent_rows(changes.read("users"), uids, ["uid"]), "users")

    errors = bad.unionByName(repeated).unionByName(again).unionByName(lost)
    counts = {"listed": counted["listed"], "directories": scanned.count(), "files": files.count(), "skipped": counted["skipped"]}
    return errors, counts
