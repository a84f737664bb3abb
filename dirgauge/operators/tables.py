"""Inventory tables on a shared filesystem: create, clear, read, append, merge. Changes are versions."""

from __future__ import annotations

from contextlib import AbstractContextManager
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirgauge.functions import file_name
from dirgauge.operators import versions
from dirgauge.operators.tree import max_id
from dirgauge.schemas import DERIVED_TABLES, FILE_INDEXES, TABLES
from dirgauge.session import as_of_literal

ALL_TABLES = {**TABLES, **DERIVED_TABLES}
_STORED = {**ALL_TABLES, **FILE_INDEXES}

# Columns looked up by value get a Parquet Bloom filter, so that a point filter skips row groups.
LOOKUP_COLUMNS = {
    "directories": ["dir_id", "parent_id"],
    "directory_stats": ["dir_id"],
    "directory_lineage": ["dir_id"],
    "directory_closure": ["ancestor_id"],
    "directory_paths": ["path"],
    "directory_intervals": ["dir_id"],
    "child_totals": ["parent_id", "dir_id"],
}


def commit(spark: SparkSession, root: str, run: str | None = None) -> AbstractContextManager[versions.Commit]:
    """Changes to several tables that become visible together, at the end of the block."""
    return versions.commit(spark, root, _STORED, lambda df, table, path: write_parquet(df, table, path, "error"), run)


def clear_tables(spark: SparkSession, root: str) -> None:
    """Empty every table."""
    with commit(spark, root) as changes:
        for table in _STORED:
            changes.clear(table)


def create_tables(spark: SparkSession, root: str) -> None:
    """Create the tables that do not exist yet; leave the others as they are. The tables of an inventory
    from before versions are taken over from their folders."""
    with commit(spark, root) as changes:
        for table in _STORED:
            if table not in changes.tables:
                changes.clear(table)
                if versions.names_in(spark, f"{changes.root}/{table}"):
                    changes.tables[table] = [{"folder": f"{changes.root}/{table}", "without": []}]


def read_table(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table as of a version, the latest if none is given."""
    return versions.read_parts(spark, _STORED[table], versions.version(spark, root, version)["tables"].get(table, []))


def open_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame]:
    """All tables as of one version, the latest if none is given."""
    found = versions.version(spark, root, version)["tables"]
    return {table: versions.read_parts(spark, schema, found.get(table, [])) for table, schema in _STORED.items()}


def write_parquet(df: DataFrame, table: str, path: str, mode: str) -> None:
    writer = df.write.mode(mode).option("compression", "zstd").option("parquet.bloom.filter.adaptive.enabled", "true")
    for column in LOOKUP_COLUMNS.get(table, []):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    writer.parquet(path)


def overwrite_table(df: DataFrame, root: str, table: str) -> None:
    """Replace a table, also with rows computed from itself: its folders stay until then."""
    with commit(df.sparkSession, root) as changes:
        changes.overwrite(df, table)


replace_from_itself = overwrite_table


def append_table(df: DataFrame, root: str, table: str) -> None:
    with commit(df.sparkSession, root) as changes:
        changes.append(df, table)


def file_maxima(stats: DataFrame) -> DataFrame:
    """file (its name) and most, the largest subtree total in it, for each stored file of `stats`; NULL if it has no rows."""
    names = [(f.rsplit("/", 1)[1],) for f in stats.inputFiles()]
    held = stats.groupBy(F.col("_metadata.file_name").alias("file")) if names else None
    every = stats.sparkSession.createDataFrame(names, "file string")
    return every.withColumn("most", F.lit(None).cast("bigint")) if held is None else every.join(held.agg(F.max("subtree_bytes").alias("most")), "file", "left")


def note_maxima(changes: versions.Commit) -> None:
    """Bring `stats_maxima` in step with `directory_stats`: files that it has are not read again."""
    schema, parts = _STORED["directory_stats"], changes.tables.get("directory_stats", [])
    noted = {r["file"] for r in changes.read("stats_maxima").select("file").collect()}  # a row per stored file
    present = {f.rsplit("/", 1)[1] for f in versions.read_parts(changes.spark, schema, parts).inputFiles()}
    unread = [p for p in parts if not set(versions.names_in(changes.spark, p["folder"])) & noted]
    new = file_maxima(versions.read_parts(changes.spark, schema, unread))
    kept = changes.spark.createDataFrame([(f,) for f in sorted(noted & present)], "file string")
    changes.overwrite(changes.read("stats_maxima").join(kept, "file", "left_semi").unionByName(new).coalesce(1), "stats_maxima")


def append_inventory(
    changes: versions.Commit, directories: DataFrame, files: DataFrame, as_of: str | datetime
) -> tuple[DataFrame, DataFrame]:
    """Append resolved directories, then files, all stamped with one `last_seen`, and the paths of the
    directories. The file's path is reduced to its last component. Returns both as stored."""
    seen = as_of_literal(as_of)
    # Children of one parent come out of the parent lookup together: sorted, they are also stored so.
    stamped = directories.withColumn("last_seen", seen).sortWithinPartitions("parent_id")
    known = changes.append(stamped, "directories")
    # without filesystems the rows as stored say all, and parents are not looked up again
    changes.append(paths_of(directories if "filesystem" in directories.columns else known), "directory_paths")
    named = files.withColumn("filename", file_name(F.col("path")))
    return known, changes.append(named.withColumn("last_seen", seen), "files")


def paths_of(directories: DataFrame) -> DataFrame:
    """The path index of directories, by hash of the path so that one path lies in few row groups."""
    of = F.col("filesystem") if "filesystem" in directories.columns else F.lit("")
    return directories.select(of.alias("filesystem"), "path", "dir_id").sortWithinPartitions(F.xxhash64("path"))


def log_run(spark: SparkSession, root: str, as_of: str | datetime) -> None:
    """Append one finished run."""
    last = max_id(read_table(spark, root, "crawl_runs"), "id")
    row = spark.range(1).select(F.lit(last + 1).alias("id"), as_of_literal(as_of).alias("finished_at"))
    append_table(row, root, "crawl_runs")


def absent_rows(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `source` whose key `target` lacks, one per key, with the columns of `target`."""
    fresh = source.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return fresh.select(
        *[
            F.col(f.name) if f.name in fresh.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )


def insert_absent(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """`target` plus the rows of `source` whose key it lacks (one per key)."""
    return target.unionByName(absent_rows(target, source, keys))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """`source`, plus the rows of `target` whose key it lacks. `source` has unique keys."""
    return target.join(source.select(*keys), keys, "left_anti").select(target.columns).unionByName(source)


def enrich_users(users: DataFrame, accounts: DataFrame) -> DataFrame:
    """Set username and gid of users that have an account, the last account line winning. Other
    users stay as they are; accounts of unknown users are ignored."""
    latest = accounts.groupBy("uid").agg(
        F.max_by(F.struct("username", "gid"), "line_order").alias("account")
    )
    known = F.col("account").isNotNull()
    return users.join(latest, "uid", "left").select(
        "uid",
        F.when(known, F.col("account.username")).otherwise(F.col("username")).alias("username"),
        F.when(known, F.col("account.gid")).otherwise(F.col("gid")).alias("gid"),
    )
