"""Directory trees: ids, parents, ancestor lists and their closure."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.functions import parent_path
from dirgauge.operators.joins import broadcast_if_small, heavy_keys, lookup_join, rows_having
from dirgauge.session import materialise, scratch_path


class CycleError(ValueError):
    """Following parent_id from some directory leads back to it."""


def max_id(df: DataFrame | None, column: str) -> int:
    """Highest id in use; 0 for an empty or missing table."""
    if df is None:
        return 0
    return df.agg(F.coalesce(F.max(column), F.lit(0)).alias("m")).first()["m"]


def assign_ids(df: DataFrame, column: str, max_seen: int) -> DataFrame:
    """Number the rows max_seen+1, max_seen+2, ... without gaps: a sorted table in its order, any other
    in no promised one.

    Each task numbers its own rows; a table with one row per task (not per data row) then gives the
    offset to add. Rows are stored in between, since a recomputed task may see them in another
    order: the ids can be joined to and read again.
    """
    slots = materialise(df.withColumn("_slot", F.monotonically_increasing_id()), "ids")
    task = F.shiftright("_slot", 33)
    per_task = slots.groupBy(task.alias("_task")).agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    offsets = materialise(per_task.select("_task", before), "offsets")
    within = F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        slots.withColumn("_task", task)
        .join(F.broadcast(offsets), "_task")
        .withColumn(column, F.lit(max_seen + 1) + F.col("_before") + within)
        .drop("_task", "_before", "_slot")
    )


def next_ids(max_seen: int) -> Column:
    """Unique ids above `max_seen`, with gaps between tasks, in one pass.

    For rows written once and not referred to: every task numbers from its own range and only one
    attempt of it is committed, so nothing needs to be stored first.
    """
    return F.lit(max_seen + 1) + F.monotonically_increasing_id()


def _key(df: DataFrame, path: Column) -> Column:
    """What a path is known by: itself, or with its filesystem where the listing names one."""
    if not _is_named(df):
        return path
    return F.concat(F.coalesce("filesystem", F.lit("")), F.lit("\0"), path)


def with_parent(entries: DataFrame) -> DataFrame:
    """Entries with the path of their parent, and what it is known by."""
    above = parent_path(F.col("path"))
    return entries.withColumn("_above", above).withColumn("_parent", _key(entries, above))


def number_rows(stored: DataFrame, column: str, max_seen: int) -> DataFrame:
    """Number the rows of a stored Parquet table max_seen+1, max_seen+2, ... without gaps, in one pass.

    A row's place in its file is known to the scan; a table with one row per file gives the offset of the file.
    """
    rows = stored.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    per_file = rows.groupBy("_file").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    offsets = materialise(per_file.select("_file", before), "offsets")
    numbered = rows.join(F.broadcast(offsets), "_file")
    return numbered.withColumn(column, F.lit(max_seen + 1) + F.col("_before") + F.col("_index")).drop("_file", "_before", "_index")


def _stored_parents(entries: list[DataFrame], listed: DataFrame | None, stored: DataFrame) -> DataFrame:
    """(_parent, _parent_id) of parents that are not listed but stored, the latest row of a path. Without `listed`, no parent is.

    `stored` is the path index (filesystem, path, dir_id). It is read for the missing paths only: a few
    are pushed to its scan, more are broadcast to it, and only a number beyond that moves it.
    """
    wanted = reduce(DataFrame.unionByName, [e.select("_parent", "_above") for e in entries])
    missing = wanted.where("_parent IS NOT NULL").distinct()
    missing = materialise(missing if listed is None else missing.join(listed, "_parent", "left_anti"), "missing-parents")
    key = _key(stored, F.col("path")) if _is_named(entries[0]) else F.col("path")
    if not _is_named(entries[0]):
        stored = stored.where("filesystem = ''")
    stored = rows_having(stored, "path", missing.select(F.col("_above").alias("path")).distinct())
    found = stored.select(key.alias("_parent"), "dir_id").join(broadcast_if_small(missing.select("_parent")), "_parent", "left_semi")
    return materialise(found.groupBy("_parent").agg(F.max("dir_id").alias("_parent_id")), "parents")


def parents_of(entries: list[DataFrame], listed: DataFrame, stored: DataFrame | None) -> DataFrame:
    """(_parent, _parent_id): the listed directories, and what the path index has of the other parents."""
    by_path = listed.select(_key(listed, F.col("path")).alias("_parent"), F.col("dir_id").alias("_parent_id"))
    if stored is None:
        return by_path
    return by_path.unionByName(_stored_parents(entries, by_path, stored))


def _with_stored_parents(resolved: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose directory is listed as they are, the others with what the path index has; all of them stored."""
    resolved = materialise(resolved, "resolved")
    rest = with_parent(resolved.where("dir_id IS NULL"))
    if rest.isEmpty():
        return resolved
    found = _stored_parents([rest], None, stored)
    late = lookup_join(rest.drop("dir_id"), found, "_parent", heavy_keys(rest, "_parent"), "left", "path")
    late = materialise(late.withColumnRenamed("_parent_id", "dir_id").select(*resolved.columns), "resolved-late")
    return resolved.where("dir_id IS NOT NULL").unionByName(late)


def _is_named(entries: DataFrame) -> bool:
    return "filesystem" in entries.columns


def resolve_tree(
    dirs: DataFrame,
    files: DataFrame,
    max_dir_id: int = 0,
    max_file_id: int = 0,
    stored: DataFrame | None = None,
    roots: Iterable[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """Give every listed directory an id and its parent's id, every file an id and its directory's.

    Parents are looked up among the listed directories, which have one row per path, and then in the path
    index `stored` (filesystem, path, dir_id). A directory whose parent is in neither is a root (parent NULL), and so is one
    given in `roots` wherever it lies; a file without parent has dir_id NULL. With a `filesystem`
    column, paths are told apart by it; without one they belong to the filesystem ''. Files may have
    their ids already. A directory may hold any share of all entries: such
    parents are split over tasks. With `stored`, files are resolved once, as a stored table: only those whose directory
    is not listed look for it in the index.
    """
    ids = with_parent(assign_ids(dirs, "dir_id", max_dir_id))
    if given := [r.rstrip("/") or "/" for r in roots]:
        inner = ~F.col("path").isin(given)
        ids = ids.withColumn("_parent", F.when(inner, F.col("_parent")))
    placed = with_parent(files)
    by_path = parents_of([ids], ids, stored)

    directories = lookup_join(ids, by_path, "_parent", heavy_keys(ids, "_parent"), "left", "path").select(
        "dir_id",
        "path",
        F.col("_parent_id").alias("parent_id"),
        F.col("uid").alias("owner_uid"),
        "mtime",
        *(["filesystem"] if _is_named(dirs) else []),
    )

    heavy = heavy_keys(placed, "_parent")
    resolved = lookup_join(placed, parents_of([placed], ids, None), "_parent", heavy, "left", "path").select(
        F.col("file_id") if "file_id" in files.columns else next_ids(max_file_id).alias("file_id"),
        F.col("_parent_id").alias("dir_id"),
        "path",
        "size_bytes",
        F.col("uid").alias("owner_uid"),
        "atime",
        "mtime",
        "ctime",
        "inode",
        F.col("nlink").alias("hardlink_count"),
        *(["filesystem"] if _is_named(files) and stored is not None else []),
    )
    return directories, resolved if stored is None else _with_stored_parents(resolved, stored).drop("filesystem")


# Lineage under construction: `ancestors` is complete up to, not including, `next_id`. `inner` marks
# directories that have children.
_STATE = T.StructType(
    [
        T.StructField("dir_id", T.LongType()),
        T.StructField("ancestors", T.ArrayType(T.LongType())),
        T.StructField("next_id", T.LongType()),
        T.StructField("rooted", T.BooleanType()),
        T.StructField("inner", T.BooleanType()),
        T.StructField("round", T.IntegerType()),
        T.StructField("open", T.BooleanType()),
    ]
)


def build_lineage(directories: DataFrame) -> DataFrame:
    """(dir_id, ancestors, root_id) for every directory.

    `ancestors` runs from the directory itself up to the topmost one with a row. `root_id` is that
    topmost one if it is a filesystem root (no parent), else NULL.

    Pointer doubling: each round appends to every unfinished list the list of the directory it
    points to, so a tree of depth d takes log2(d) rounds. Only directories with children are looked
    up. Finished lists are written once. Each round is a stored table, so a lost executor repeats at
    most one round.
    """
    spark = directories.sparkSession
    root = scratch_path(spark, "lineage")

    def store(lists: DataFrame, step: int) -> Row:
        """Write one round; return what the next one must know, observed on the way."""
        seen = Observation()
        (
            lists.withColumn("open", F.col("next_id").isNotNull())
            .observe(
                seen,
                F.count_if("open").alias("n"),
                F.coalesce(
                    F.bool_or(F.expr("open AND array_contains(ancestors, next_id)")), F.lit(False)
                ).alias("cycle"),
            )
            .write.partitionBy("open")
            .parquet(f"{root}/round={step}")
        )
        return Row(**seen.get)

    parents = directories.select(F.col("parent_id").alias("dir_id")).distinct()
    start = directories.select("dir_id", "parent_id").join(
        parents.withColumn("inner", F.lit(True)), "dir_id", "left"
    )
    step = 0
    state = store(
        start.select(
            "dir_id",
            F.array("dir_id").alias("ancestors"),
            F.col("parent_id").alias("next_id"),
            F.col("parent_id").isNull().alias("rooted"),
            F.coalesce("inner", F.lit(False)).alias("inner"),
        ),
        step,
    )
    while state.n:
        if state.cycle:
            raise CycleError("parent_id forms a cycle")
        stored = spark.read.schema(_STATE).parquet(root)
        unfinished = stored.where((F.col("round") == step) & F.col("open"))
        known = stored.where(F.col("inner") & (~F.col("open") | (F.col("round") == step))).select(
            F.col("dir_id").alias("next_id"),
            F.col("ancestors").alias("more"),
            F.col("next_id").alias("after"),
            F.col("rooted").alias("more_rooted"),
        )
        heavy = heavy_keys(unfinished, "next_id")
        joined = lookup_join(unfinished, known, "next_id", heavy, "left", "dir_id")
        step += 1
        state = store(
            joined.select(
                "dir_id",
                F.concat("ancestors", F.coalesce("more", F.array().cast("array<bigint>"))).alias(
                    "ancestors"
                ),
                F.col("after").alias("next_id"),
                F.coalesce("more_rooted", F.lit(False)).alias("rooted"),
                "inner",
            ),
            step,
        )

    finished = spark.read.schema(_STATE).parquet(root).where(~F.col("open"))
    return finished.select(
        "dir_id",
        "ancestors",
        F.when(F.col("rooted"), F.element_at("ancestors", -1)).alias("root_id"),
    )


def closure_of(lineage: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, depth), each directory being its own ancestor at depth 0."""
    return lineage.select(
        F.col("dir_id").alias("descendant_id"),
        F.posexplode("ancestors").alias("depth", "ancestor_id"),
    ).select("ancestor_id", "descendant_id", "depth")


def build_closure(directories: DataFrame) -> DataFrame:
    return closure_of(build_lineage(directories))
