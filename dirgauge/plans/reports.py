"""Disk-usage questions over a finished inventory `t` (table name to DataFrame)."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirgauge.functions import (
    base_name,
    file_line,
    fmt_bytes,
    fmt_count,
    fmt_mtime,
    gigabytes,
    last_segment,
    path_order,
    quarter_label,
    report_line,
    size_in_unit,
)
from dirgauge.functions.formats import local_time, report_header
from dirgauge.operators.joins import MAX_PUSHED_IDS, broadcast_if_small, having_ids, if_few
from dirgauge.operators.tree import assign_ids
from dirgauge.session import as_of_literal

Tables = Mapping[str, DataFrame]

# Row limit of the user tree, default of the largest-directories report, and the
# earliest access time that counts.
TREE_LIMIT = 200
TOP_LIMIT = 20
EARLIEST_ATIME = "2000-01-01 00:00:00"


def _display_name() -> Column:
    return F.coalesce("username", F.col("uid").cast("string"))


def _with_subtree(t: Tables, of_parent: Column) -> DataFrame:
    """The directories whose parent fulfils `of_parent`, with their totals.

    The ids of a few directories are pushed to the scan of the statistics. The totals of more come from the
    table sorted by parent, with the same filter. Where it has none (an older inventory, a parent that is not
    stored) the statistics are reduced to these directories: only the outer side of the join is known to be
    few, and only the inner side of it can be broadcast.
    """
    directories, stats = t["directories"].where(of_parent), t["directory_stats"]
    chosen = directories.select("dir_id", "path")
    totals = stats.select("dir_id", "subtree_bytes", "subtree_count")
    few = if_few(chosen.select("dir_id"))
    if few is not None:
        # `dir_id` is unique: no more rows than ids.
        totals = F.broadcast(having_ids(totals, "dir_id", few))
    elif (by_parent := t.get("child_totals")) is not None and not by_parent.where(of_parent).isEmpty():
        totals = broadcast_if_small(by_parent.where(of_parent).drop("parent_id"))
    else:
        totals = totals.join(broadcast_if_small(chosen.select("dir_id")), "dir_id", "left_semi")
    return chosen.join(totals, "dir_id", "left").select(
        "dir_id",
        "path",
        F.coalesce("subtree_bytes", F.lit(0)).alias("subtree_bytes"),
        F.coalesce("subtree_count", F.lit(0)).alias("subtree_count"),
    )


def _with_path(directories: DataFrame, chosen: DataFrame) -> DataFrame:
    """`chosen` (dir_id and more) with the paths of its directories; rows without a directory go.

    The ids of a few rows are read first and pushed to the scan of the directories.
    """
    paths = directories.select("dir_id", "path")
    few = if_few(chosen.select("dir_id"))
    if few is None:
        return paths.join(broadcast_if_small(chosen), "dir_id")
    return having_ids(paths, "dir_id", few).join(F.broadcast(chosen), "dir_id")


def filesystems(t: Tables) -> DataFrame:
    """Every root with its totals, by path."""
    return _with_subtree(t, F.col("parent_id").isNull()).orderBy("path")


def dir_children(t: Tables, dir_id: int) -> DataFrame:
    """Subdirectories with their totals, largest first; empty ones are kept."""
    return _with_subtree(t, F.col("parent_id") == dir_id).orderBy(F.desc("subtree_bytes"), "path")


def users(t: Tables) -> DataFrame:
    """All users with their totals, largest first; users without files are kept."""
    owned = (
        t["directory_usage"]
        .groupBy(F.col("owner_uid").alias("uid"))
        .agg(F.sum("bytes").alias("total_bytes"), F.sum("files").alias("file_count"))
    )
    return (
        t["users"]
        .join(owned, "uid", "left")
        .select(
            "uid",
            _display_name().alias("display_name"),
            F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
        )
        .orderBy(F.desc("total_bytes"), "uid")
    )


def user_breakdown(t: Tables, uid: int) -> DataFrame:
    """One user's totals per filesystem; filesystems without the user's files are absent."""
    roots = t["directories"].where("parent_id IS NULL").select("dir_id", F.col("path").alias("filesystem"))
    return (
        t["user_stats"]
        .where(F.col("uid") == uid)
        .join(broadcast_if_small(roots), "dir_id")
        .select("dir_id", "filesystem", F.col("total_bytes").alias("bytes"), "file_count")
        .orderBy(F.desc("bytes"), "dir_id")
    )


def user_dir_children(t: Tables, uid: int, dir_id: int) -> DataFrame:
    """Subdirectories of `dir_id` holding the user's files, with the user's totals below each.

    The child that leads to a file is the entry before `dir_id` in the ancestor list of the file's
    directory, so only the user's own rows are read, and no closure pairs.
    """
    at = F.array_position("ancestors", dir_id).cast("int")
    mine = (
        t["directory_usage"]
        .where((F.col("owner_uid") == uid) & (at > 1))
        .groupBy(F.element_at("ancestors", at - 1).alias("dir_id"))
        .agg(
            F.sum("bytes").alias("user_bytes"),
            F.sum("files").alias("user_files"),
            F.max("last_mtime").alias("last_mtime"),
        )
    )
    return (
        t["directories"]
        .where(F.col("parent_id") == dir_id)
        .select("dir_id", "path")
        .join(mine, "dir_id")
        .orderBy(F.desc("user_bytes"), "dir_id")
    )


def user_tree(t: Tables, uid: int) -> DataFrame:
    """Directories in which the user owns files directly, latest change first, at most 200.

    A usage row has ancestors exactly if its directory has a row, so the 200 are chosen before their
    paths are looked up.
    """
    newest = [F.desc_nulls_last("last_mtime"), F.asc("dir_id")]
    chosen = (
        t["directory_usage"]
        .where((F.col("owner_uid") == uid) & F.col("ancestors").isNotNull())
        .select(
            "dir_id",
            F.col("bytes").alias("user_bytes"),
            F.col("files").alias("user_files"),
            "last_mtime",
        )
        .orderBy(*newest)
        .limit(TREE_LIMIT)
    )
    return (
        _with_path(t["directories"], chosen)
        .select("dir_id", "path", "user_bytes", "user_files", "last_mtime")
        .orderBy(*newest)
        .limit(TREE_LIMIT)
    )


def last_crawled(t: Tables) -> DataFrame:
    """Time of the last finished run and its text; the text is empty if there was none."""
    return t["crawl_runs"].agg(F.max("finished_at").alias("finished_at")).select(
        "finished_at",
        F.coalesce(
            F.concat(F.lit("data as of "), local_time(F.col("finished_at"), "yyyy-MM-dd")), F.lit("")
        ).alias("label"),
    )


def _by_quarter(access: DataFrame, as_of: str | datetime) -> DataFrame:
    """Rows (atime, files, bytes) after the earliest time and up to a day after `as_of`, per quarter."""
    kind = access.schema["atime"].dataType
    latest = as_of_literal(as_of, kind) + F.expr("INTERVAL 1 DAY")
    return (
        access.where(
            F.col("atime").isNotNull()
            & (F.col("atime") > as_of_literal(EARLIEST_ATIME, kind))
            & (F.col("atime") <= latest)
        )
        .groupBy(F.year("atime").alias("year"), F.quarter("atime").alias("quarter"))
        .agg(F.sum("files").alias("file_count"), F.sum("bytes").alias("total_bytes"))
        .orderBy("year", "quarter")
        .select(quarter_label(F.col("year"), F.col("quarter")).alias("label"), "file_count", "total_bytes")
    )


def staleness(t: Tables, as_of: str | datetime, uid: int | None = None) -> DataFrame:
    """Files and bytes per quarter of last access, oldest first; of one user if `uid` is given.

    As of the last `finish` or delta. One user: the user's rows of `access_usage`, whose times are exact. All
    users: sums per hour, and exact times for the two hours that the bounds lie in; quarters begin with an hour.
    """
    if uid is not None:
        return _by_quarter(t["access_usage"].where(F.col("owner_uid") == uid), as_of)
    kind = t["access_times"].schema["atime"].dataType
    first = F.date_trunc("hour", as_of_literal(EARLIEST_ATIME, kind)).cast(kind)
    last = F.date_trunc("hour", as_of_literal(as_of, kind) + F.expr("INTERVAL 1 DAY")).cast(kind)
    inside = t["access_hours"].where((F.col("hour") > first) & (F.col("hour") < last))
    at_edge = (F.col("atime") < first + F.expr("INTERVAL 1 HOUR")) | (F.col("atime") >= last)
    return _by_quarter(inside.withColumnRenamed("hour", "atime").unionByName(t["access_times"].where(at_edge)), as_of)


def chart(points: DataFrame) -> DataFrame:
    """Staleness points as chart values: gigabytes with one decimal, and the number of files as
    text."""
    return points.select(
        "label",
        gigabytes(F.col("total_bytes")).alias("gigabytes"),
        F.concat(fmt_count(F.col("file_count")), F.lit(" files")).alias("files"),
    )


def user_summary(t: Tables, uid: int) -> DataFrame:
    """Name and totals of one user over all filesystems; no row for an unknown user."""
    totals = (
        t["user_stats"]
        .where(F.col("uid") == uid)
        .groupBy("uid")
        .agg(F.sum("total_bytes").alias("total_bytes"), F.sum("file_count").alias("file_count"))
    )
    return (
        t["users"]
        .where(F.col("uid") == uid)
        .join(totals, "uid", "left")
        .select(
            _display_name().alias("display_name"),
            F.coalesce("total_bytes", F.lit(0)).alias("total_bytes"),
            F.coalesce("file_count", F.lit(0)).alias("file_count"),
        )
    )


def descendants(t: Tables, dir_id: int) -> DataFrame:
    """Every directory at or below `dir_id` with its depth there: a range of the directories in tree order. Where
    they are not numbered (after a delta), the closure pairs of `dir_id`."""
    numbered = t["directory_intervals"]
    own = numbered.where(F.col("dir_id") == dir_id).select("pre", "last", "depth").toArrow().to_pylist()  # one row or none
    if own:
        row = own[0]
        below = numbered.where((F.col("pre") >= row["pre"]) & (F.col("pre") <= row["last"]))
        return below.select("dir_id", (F.col("depth") - row["depth"]).cast("int").alias("depth"))
    return t["directory_closure"].where(F.col("ancestor_id") == dir_id).select(
        F.col("descendant_id").alias("dir_id"), "depth"
    )


def cumulative_size(t: Tables, dir_id: int) -> DataFrame:
    """Bytes at or below a directory; NULL if there are no files. One row of the statistics of the last
    `finish` holds the answer; `dir_id` is pushed to the scan."""
    own = t["directory_stats"].where((F.col("dir_id") == dir_id) & (F.col("subtree_count") > 0))
    return own.agg(F.max("subtree_bytes").cast("bigint").alias("total_bytes"))


def usage_by_username(t: Tables) -> DataFrame:
    """Bytes per user name, largest first; all users without a name count as one."""
    owned = t["directory_usage"].groupBy(F.col("owner_uid").alias("uid")).agg(
        F.sum("bytes").alias("bytes")
    )
    return (
        t["users"]
        .join(owned, "uid")
        .groupBy("username")
        .agg(F.sum("bytes").alias("total_bytes"))
        .orderBy(F.desc("total_bytes"), F.asc_nulls_last("username"))
    )


def holding_largest(t: Tables, n: int) -> DataFrame:
    """The statistics, without files that cannot hold one of the `n` largest totals.

    The files' maxima, largest first: the n-th is reached by n rows at least, so only files whose maximum is
    no less are read, and only their row groups that reach it. All files stay where they are few, where ties
    leave many, or where the maxima are not those of the stored files. File names come to the driver as in any scan.
    """
    stats, noted = t["directory_stats"], t.get("stats_maxima")
    if noted is None or not (files := {f.rsplit("/", 1)[1] for f in stats.inputFiles()}):
        return stats
    most = {r["file"]: r["most"] for r in noted.collect() if r["file"] in files}
    if len(most) < len(files):
        return stats
    order = sorted((m for m in most.values() if m is not None), reverse=True)
    if not 0 < n < len(order):
        return stats
    chosen = [f for f, m in most.items() if m is not None and m >= order[n - 1]]
    if len(chosen) > MAX_PUSHED_IDS:
        return stats.where(F.col("subtree_bytes") >= order[n - 1])
    return stats.where(F.col("_metadata.file_name").isin(chosen) & (F.col("subtree_bytes") >= order[n - 1]))


def top_dirs(t: Tables, n: int = TOP_LIMIT) -> DataFrame:
    """The `n` directories with most bytes below them.

    Files of the statistics that cannot hold one are not read. Only directories that reach the n-th largest size (ties included) are joined to their paths.
    Statistics without a directory do not count towards the n: where that leaves fewer than n, those
    with a directory are looked for first.
    """
    stats = t["directory_stats"].select("dir_id", "subtree_bytes", "subtree_count")

    def largest(of: DataFrame) -> DataFrame:
        sizes = of.select("subtree_bytes").orderBy(F.desc("subtree_bytes")).limit(n)
        least = sizes.agg(F.min("subtree_bytes")).first()[0]
        return (
            _with_path(t["directories"], of.where(F.col("subtree_bytes") >= F.lit(least)))
            .select("path", "subtree_bytes", "subtree_count")
            .orderBy(F.desc("subtree_bytes"), "path")
            .limit(n)
        )

    found = largest(holding_largest(t, n).select(*stats.columns))
    if found.count() == n:
        return found
    return largest(stats.join(t["directories"].select("dir_id"), "dir_id", "left_semi"))


def grand_totals(t: Tables) -> DataFrame:
    """Bytes and files over all filesystems."""
    return filesystems(t).agg(
        F.sum("subtree_bytes").alias("total_bytes"), F.sum("subtree_count").alias("total_files")
    )


def size_share(df: DataFrame, size: str) -> DataFrame:
    """`df` with `pct`: size in percent of the largest, one decimal, 0 where the largest is 0."""
    wide, largest = F.col(size).cast("decimal(19,0)"), F.col("_largest")
    # Whole-number division: the last digit is exact for sizes of any magnitude.
    tenths = F.call_function("div", wide * 2000 + largest, 2 * largest)
    return (
        df.withColumn("_largest", df.agg(F.max(wide)).scalar())
        .withColumn("pct", F.when(largest > 0, tenths / 10.0).otherwise(F.lit(0.0)))
        .drop("_largest")
    )


def sorted_listing(df: DataFrame, column: str, ascending: bool, tie: str) -> DataFrame:
    """`df` in order of `column`: text without regard to case, times with NULL as earliest."""
    kind = df.schema[column].dataType.typeName()
    key = F.lower(column) if kind == "string" else F.col(column)
    return df.orderBy(key.asc_nulls_first() if ascending else key.desc_nulls_last(), tie)


def breadcrumb(t: Tables, dir_id: int) -> DataFrame:
    """The chain of directories from the root (level 0) down to `dir_id`."""
    chain = t["directory_lineage"].where(F.col("dir_id") == dir_id).select(
        F.posexplode(F.reverse("ancestors")).alias("level", "dir_id")
    )
    name = F.when(F.col("level") == 0, base_name(F.col("path"))).otherwise(last_segment(F.col("path")))
    return (
        _with_path(t["directories"], chain)
        .select("dir_id", name.alias("name"), "level")
        .orderBy("level")
    )


def labelled(df: DataFrame, size: str, path: str | None = None, mtime: str | None = None) -> DataFrame:
    """A report with the texts shown for it: `size`, and where asked for `name` (last segment of the
    path) and `modified` (local time)."""
    texts = {"size": fmt_bytes(F.col(size))}
    if path:
        texts["name"] = last_segment(F.col(path))
    if mtime:
        texts["modified"] = fmt_mtime(F.col(mtime))
    return df.withColumns(texts)


def table_count_lines(t: Tables) -> DataFrame:
    """The table counts as text lines."""
    return table_counts(t).select(F.format_string("%-25s %d", "table", "n").alias("line"))


def table_counts(t: Tables) -> DataFrame:
    """Rows per table, in the fixed order of the report."""
    report = None
    for place, table in enumerate(
        ["files", "directories", "directory_stats", "directory_closure", "users"]
    ):
        counted = t[table].agg(F.count("*").alias("n")).select(
            F.lit(place).alias("place"), F.lit(table).alias("table"), "n"
        )
        report = counted if report is None else report.unionByName(counted)
    return report.orderBy("place").drop("place")


def file_report(files: DataFrame, order: str = "path", unit: str = "KB") -> DataFrame:
    """All files as report rows, by path component, size (largest first) or owner."""
    keys = {
        "path": [path_order(F.col("path"))],
        "size": [F.desc("size_bytes"), path_order(F.col("path"))],
        "owner": [F.asc("owner_uid"), path_order(F.col("path"))],
    }[order]
    size = size_in_unit(F.col("size_bytes"), unit)
    return files.orderBy(*keys).select(
        "path",
        size.alias("size"),
        F.col("owner_uid").alias("uid"),
        report_line(F.col("path"), size, F.col("owner_uid")).alias("line"),
    )


def text_report(files: DataFrame, errors: DataFrame, order: str = "path", unit: str = "KB") -> DataFrame:
    """The finished report as lines in order of `position`, from 1: titles, a rule, one line per file as
    in `file_report`, a rule, and the totals of the scan."""
    title, rule = report_header(unit).split("\n")
    lines = assign_ids(file_report(files, order, unit).select("line"), "position", 2)

    def at(position: Column, line: Column) -> Column:
        return F.struct(position.cast("bigint").alias("position"), line.alias("line"))

    last = F.col("files") + 2
    around = scan_totals(files, errors).select(
        F.inline(
            F.array(
                at(F.lit(1), F.lit(title)),
                at(F.lit(2), F.lit(rule)),
                at(last + 1, F.lit(rule)),
                at(last + 2, F.format_string("files:  %d", "files")),
                at(last + 3, F.format_string("bytes:  %d", "bytes")),
                at(last + 4, F.format_string("errors: %d", "errors")),
            )
        )
    )
    return around.unionByName(lines.select("position", "line")).orderBy("position")


def file_lines(files: DataFrame) -> DataFrame:
    """One text line per file."""
    return files.select(file_line(F.col("path"), F.col("size_bytes"), F.col("owner_uid")).alias("line"))


def scan_totals(files: DataFrame, errors: DataFrame) -> DataFrame:
    """Files, bytes and errors of a scan, in one row."""
    seen = files.select(F.lit(1).alias("file"), "size_bytes", F.lit(0).alias("error"))
    failed = errors.select(F.lit(0).alias("file"), F.lit(0).cast("bigint").alias("size_bytes"), F.lit(1).alias("error"))
    return seen.unionByName(failed).agg(
        F.coalesce(F.sum("file"), F.lit(0)).alias("files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("bytes"),
        F.coalesce(F.sum("error"), F.lit(0)).alias("errors"),
    )
