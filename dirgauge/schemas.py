"""Table schemas, keys and references of a filesystem inventory."""

from pyspark.sql import types as T

LONG, INT, STR, TS = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampType()


def _schema(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, not required) for name, kind, required in fields])


# Raw scan output: one row per directory entry. ``entry_type`` is 'd', 'f', 'l' or 's'.
LISTING = _schema(
    ("path", STR, True),
    ("entry_type", STR, False),
    ("size_bytes", LONG, False),
    ("inode", LONG, False),
    ("uid", LONG, False),
    ("gid", LONG, False),
    ("nlink", INT, False),
    ("atime", TS, False),
    ("mtime", TS, False),
    ("ctime", TS, False),
    ("error_kind", STR, False),
)

USERS = _schema(("uid", LONG, True), ("username", STR, False), ("gid", LONG, False))

DIRECTORIES = _schema(
    ("dir_id", LONG, True),
    ("path", STR, True),
    ("parent_id", LONG, False),
    ("owner_uid", LONG, False),
    ("mtime", TS, False),
    ("last_seen", TS, True),
)

FILES = _schema(
    ("file_id", LONG, True),
    ("dir_id", LONG, False),
    ("filename", STR, True),
    ("size_bytes", LONG, True),
    ("owner_uid", LONG, False),
    ("atime", TS, False),
    ("mtime", TS, False),
    ("ctime", TS, False),
    ("inode", LONG, False),
    ("hardlink_count", INT, False),
    ("last_seen", TS, True),
)

DIRECTORY_STATS = _schema(
    ("dir_id", LONG, True),
    ("direct_bytes", LONG, False),
    ("subtree_bytes", LONG, False),
    ("file_count", LONG, False),
    ("subtree_count", LONG, False),
    ("last_computed", TS, True),
)

USER_STATS = _schema(
    ("uid", LONG, True),
    ("dir_id", LONG, True),
    ("total_bytes", LONG, True),
    ("file_count", LONG, True),
)

DIRECTORY_CLOSURE = _schema(
    ("ancestor_id", LONG, True), ("descendant_id", LONG, True), ("depth", INT, True)
)

CRAWL_RUNS = _schema(("id", LONG, True), ("finished_at", TS, True))

# The seven public tables.
TABLES = {
    "users": USERS,
    "directories": DIRECTORIES,
    "files": FILES,
    "directory_stats": DIRECTORY_STATS,
    "user_stats": USER_STATS,
    "directory_closure": DIRECTORY_CLOSURE,
    "crawl_runs": CRAWL_RUNS,
}

# Derived tables kept beside them. The lineage is the closure with one row per directory: its
# ancestors from itself up to the top, its root, and the totals of its own files (NULL if none). The
# usage is `files` pre-aggregated to (directory, owner), with the directory's ancestors and root. The
# access usage is `files` pre-aggregated to (owner, time of last access).
DIRECTORY_LINEAGE = T.StructType(
    [
        T.StructField("dir_id", LONG),
        T.StructField("ancestors", T.ArrayType(LONG)),
        T.StructField("root_id", LONG),
        T.StructField("direct_bytes", LONG),
        T.StructField("file_count", LONG),
    ]
)

DIRECTORY_USAGE = T.StructType(
    [
        T.StructField("dir_id", LONG),
        T.StructField("owner_uid", LONG),
        T.StructField("bytes", LONG),
        T.StructField("files", LONG),
        T.StructField("last_mtime", TS),
        T.StructField("ancestors", T.ArrayType(LONG)),
        T.StructField("root_id", LONG),
    ]
)

ACCESS_USAGE = T.StructType(
    [
        T.StructField("owner_uid", LONG),
        T.StructField("atime", TS),
        T.StructField("files", LONG),
        T.StructField("bytes", LONG),
    ]
)

# The directories numbered in tree order (`operators/intervals.py`), and the access usage of all owners by exact
# time and by hour.
DIRECTORY_INTERVALS = T.StructType(
    [T.StructField("dir_id", LONG), T.StructField("pre", LONG), T.StructField("last", LONG), T.StructField("depth", INT)]
    + [T.StructField("parent_id", LONG)]
    + [T.StructField(c, LONG) for c in ("bytes_before", "bytes_through", "files_before", "files_through")]
)

# The totals of directories by their parent, and the largest total in each stored file of `directory_stats`.
CHILD_TOTALS = T.StructType(
    [T.StructField(c, LONG) for c in ("parent_id", "dir_id", "subtree_bytes", "subtree_count")]
)

STATS_MAXIMA = T.StructType([T.StructField("file", STR), T.StructField("most", LONG)])

ACCESS_TIMES = T.StructType(
    [T.StructField("atime", TS), T.StructField("files", LONG), T.StructField("bytes", LONG)]
)

ACCESS_HOURS = T.StructType(
    [T.StructField("hour", TS), T.StructField("files", LONG), T.StructField("bytes", LONG)]
)

# What ingest keeps: the directories by filesystem and path, the entries that were not stored, and what was
# taken in (a run, or a batch of a staging folder with a fingerprint of its files).
DIRECTORY_PATHS = T.StructType(
    [T.StructField("filesystem", STR), T.StructField("path", STR), T.StructField("dir_id", LONG)]
)

INGEST_ERRORS = T.StructType(
    [T.StructField("path", STR), T.StructField("error_kind", STR), T.StructField("run", STR)]
)

INGEST_LEDGER = T.StructType(
    [
        T.StructField("run", STR),
        T.StructField("batch_id", LONG),
        T.StructField("fingerprint", LONG),
        T.StructField("listed", LONG),
        T.StructField("directories", LONG),
        T.StructField("files", LONG),
        T.StructField("failed", LONG),
        T.StructField("skipped", LONG),
    ]
)

DERIVED_TABLES = {
    "directory_lineage": DIRECTORY_LINEAGE,
    "directory_usage": DIRECTORY_USAGE,
    "access_usage": ACCESS_USAGE,
    "access_times": ACCESS_TIMES,
    "access_hours": ACCESS_HOURS,
    "directory_intervals": DIRECTORY_INTERVALS,
    "child_totals": CHILD_TOTALS,
    "directory_paths": DIRECTORY_PATHS,
    "ingest_errors": INGEST_ERRORS,
    "ingest_ledger": INGEST_LEDGER,
}

# What describes stored files, not entries of the inventory: it differs from write to write.
FILE_INDEXES = {"stats_maxima": STATS_MAXIMA}

PRIMARY_KEYS = {
    "users": ["uid"],
    "directories": ["dir_id"],
    "files": ["file_id"],
    "directory_stats": ["dir_id"],
    "user_stats": ["uid", "dir_id"],
    "directory_closure": ["ancestor_id", "descendant_id"],
    "crawl_runs": ["id"],
}

# (table, column, referenced table, referenced column)
FOREIGN_KEYS = [
    ("directories", "owner_uid", "users", "uid"),
    ("directories", "parent_id", "directories", "dir_id"),
    ("files", "owner_uid", "users", "uid"),
    ("files", "dir_id", "directories", "dir_id"),
    ("directory_stats", "dir_id", "directories", "dir_id"),
    ("directory_closure", "ancestor_id", "directories", "dir_id"),
    ("directory_closure", "descendant_id", "directories", "dir_id"),
]
