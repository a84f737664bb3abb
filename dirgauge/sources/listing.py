"""Raw listings: one row per directory entry, as scanned."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.functions import normal_path, parent_path
from dirgauge.operators.joins import broadcast_if_small, heavy_keys, lookup_join
from dirgauge.schemas import LISTING
from dirgauge.session import as_of_literal, materialise


def load_listing(spark: SparkSession, paths: str | list[str], fmt: str = "parquet") -> DataFrame:
    """Read listings in any file format Spark reads, with the fixed schema (nothing is inferred)."""
    reader = spark.read.schema(LISTING).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')  # quotes are doubled
    return reader.load(paths)


def implied_directories(listing: DataFrame) -> DataFrame:
    """Directory rows for every proper prefix of the listed paths, for sources that list only
    files."""
    prefixes = F.expr(
        "transform(sequence(1, size(split(path, '/')) - 1),"
        " i -> concat_ws('/', slice(split(path, '/'), 1, i)))"
    )
    # Siblings share all prefixes: reduce to distinct parents before taking them apart.
    parents = listing.select(F.concat(parent_path(F.col("path")), F.lit("/x")).alias("path"))
    paths = (
        parents.where("path IS NOT NULL")
        .distinct()
        .select(F.explode(prefixes).alias("path"))
        .where("path <> ''")
        .distinct()
    )
    known = {"path": F.col("path"), "entry_type": F.lit("d")}
    return paths.select(
        *[known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LISTING.fields]
    )


def load_roots(spark: SparkSession, roots: list[tuple[str, str]], fmt: str = "parquet") -> DataFrame:
    """Listings of several filesystems, given as (name, path), with a `filesystem` column."""
    parts = [
        load_listing(spark, path, fmt).withColumn("filesystem", F.lit(name)) for name, path in roots
    ]
    return reduce(DataFrame.unionByName, parts)


def split_errors(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries that could be read, failed entries with path and kind)."""
    failed = F.col("error_kind").isNotNull()
    return (
        listing.where(~failed).drop("error_kind"),
        listing.where(failed).select("path", "error_kind"),
    )


def error_counts(errors: DataFrame) -> DataFrame:
    return errors.groupBy("error_kind").agg(F.count("*").alias("n"))


#: Entry types: directories and regular files are stored, links and special files are not.
ENTRY_TYPES = ("d", "f", "l", "s")


def failure(listing: DataFrame) -> Column:
    """Why an entry cannot be stored, NULL if it can: the scan's error, or NoPath, BadType (not one of
    ENTRY_TYPES), NoSize (a regular file without a size, such as one in CSV that is no number)."""
    kind = F.col("entry_type")
    return (
        F.when(F.col("error_kind").isNotNull(), F.col("error_kind"))
        .when(F.col("path").isNull(), "NoPath")
        .when(kind.isNull() | ~kind.isin(*ENTRY_TYPES), "BadType")
        .when((kind == "f") & F.col("size_bytes").isNull(), "NoSize")
    )


def _is_self(path: Column) -> Column:
    """Whether a path is the '.' or '..' entry of a directory; a root may be given by such a name."""
    return path.endswith("/.") | path.endswith("/..")


def stage_entries(listing: DataFrame, path: str) -> tuple[DataFrame, Row]:
    """Store a listing in one pass and return it with the numbers of its entries.

    `part` is 'd' or 'f' for what goes on, 'failed' (`kind` says why) or 'skipped' (links, special files, '.'
    and '..'); it is a partition of the stored table, so that each part is read alone.
    """
    tidy = normal_path(F.col("path"))
    part = F.when(F.col("kind").isNotNull(), "failed").when(F.col("entry_type").isin("l", "s") | _is_self(tidy), "skipped")
    parts = ("d", "f", "failed", "skipped")
    rows = listing.withColumn("kind", failure(listing)).withColumn("part", part.otherwise(F.col("entry_type")))
    rows = rows.withColumn("path", F.when(F.col("kind").isNull(), tidy).otherwise(F.col("path"))).drop("error_kind")
    rows.write.option("compression", "zstd").partitionBy("part").parquet(path)
    stored = listing.sparkSession.read.schema(T.StructType(rows.schema.fields)).parquet(path)
    # rows are counted as stored: file footers tell, no column is read
    held = {r["part"]: r["count"] for r in stored.groupBy("part").count().collect()}
    return stored, Row(listed=sum(held.values()), **{p: held.get(p, 0) for p in parts})


def split_repeated_files(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per file, an error for each further row of the same path and filesystem), from files with
    unique file_id; the least file_id stays. Only hashes of paths are shuffled unless some repeat."""
    keys = [c for c in ("filesystem", "path") if c in files.columns]
    hashed = F.xxhash64(*keys).alias("_hash")
    twice = materialise(files.groupBy(hashed).agg(F.count("*").alias("n")).where("n > 1").select("_hash"), "repeated")
    if twice.isEmpty():
        return files, files.sparkSession.range(0).select(F.lit("").alias("path"), F.lit("").alias("error_kind"))
    some = files.select(*keys, "file_id", hashed).join(broadcast_if_small(twice), "_hash", "left_semi")
    first = some.groupBy(*keys).agg(F.min("file_id").alias("file_id"))
    again = materialise(some.select("path", "file_id").join(first.select("file_id"), "file_id", "left_anti"), "repeated-files")
    once = files.join(broadcast_if_small(again.select("file_id")), "file_id", "left_anti")
    return once, again.select("path", F.lit("Repeated").alias("error_kind"))


def split_repeated(dirs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row per directory, an error for each further row of the same path and filesystem). The least
    of the rows stays."""
    keys = [c for c in ("filesystem", "path") if c in dirs.columns]
    row = F.struct(*[c for c in dirs.columns if c not in keys])
    found = dirs.groupBy(*keys).agg(F.min(row).alias("row"), F.count("*").alias("n"))
    once = found.select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c) for c in dirs.columns])
    further = F.explode(F.sequence(F.lit(2).cast("bigint"), "n"))
    again = found.where("n > 1").select("path", F.lit("Repeated").alias("error_kind"), further)
    return once, again.select("path", "error_kind")


def classify(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(directories, regular files). Symlinks, special files and the '.' and '..' entries of a
    directory go; a root may be given by such a name. Paths lose repeated and trailing slashes."""
    entries = entries.withColumn("path", normal_path(F.col("path")))
    real = entries.where(~_is_self(F.col("path")))
    return real.where("entry_type = 'd'"), real.where("entry_type = 'f'")


def delta(listing: DataFrame, last_seen: str | datetime) -> DataFrame:
    """Entries not older than `last_seen`; those without a time are kept."""
    mtime = F.col("mtime")
    return listing.where(mtime.isNull() | (mtime >= as_of_literal(last_seen, listing.schema["mtime"].dataType)))


def delta_by_directory(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Entries not older than the last scan of their own directory, `seen` being
    (path, last_seen_mtime), one row per path. Entries of directories never seen are all kept."""
    marks = seen.select(F.col("path").alias("_parent"), "last_seen_mtime")
    entries = listing.withColumn("_parent", parent_path(F.col("path")))
    heavy = heavy_keys(entries, "_parent")
    return (
        lookup_join(entries, marks, "_parent", heavy, "left", "path")
        .where("last_seen_mtime IS NULL OR mtime IS NULL OR mtime >= last_seen_mtime")
        .drop("_parent", "last_seen_mtime")
    )
