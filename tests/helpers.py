"""Hand-made inventories."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from dirgauge.operators import rollups
from dirgauge.operators.intervals import build_intervals
from dirgauge.operators.tree import build_lineage, closure_of
from dirgauge.schemas import DIRECTORIES, FILES, LISTING, USERS
from dirgauge.session import as_of_literal

NOW = datetime(2024, 5, 1, 12, 0)
AS_OF = "2024-05-01 12:00:00"


def frame(spark, schema, rows):
    """Rows given as dicts; absent columns are NULL."""
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema.fields) for r in rows], schema)


def dirs(spark, *rows):
    """(dir_id, path, parent_id[, owner_uid])."""
    return frame(
        spark,
        DIRECTORIES,
        [
            {
                "dir_id": r[0],
                "path": r[1],
                "parent_id": r[2],
                "owner_uid": r[3] if len(r) > 3 else 1,
                "mtime": NOW,
                "last_seen": NOW,
            }
            for r in rows
        ],
    )


def files(spark, *rows):
    """(file_id, dir_id, size_bytes, owner_uid[, mtime[, atime]])."""
    return frame(
        spark,
        FILES,
        [
            {
                "file_id": r[0],
                "dir_id": r[1],
                "filename": f"f{r[0]}",
                "size_bytes": r[2],
                "owner_uid": r[3],
                "mtime": r[4] if len(r) > 4 else NOW,
                "atime": r[5] if len(r) > 5 else NOW,
                "ctime": NOW,
                "inode": r[0],
                "hardlink_count": 1,
                "last_seen": NOW,
            }
            for r in rows
        ],
    )


def users(spark, *rows):
    return frame(spark, USERS, [dict(zip(("uid", "username", "gid"), r)) for r in rows])


def listing(spark, *rows):
    """(path, entry_type[, size[, uid[, error_kind]]])."""
    names = ("path", "entry_type", "size_bytes", "uid", "error_kind")
    return frame(spark, LISTING, [{"mtime": NOW, "nlink": 1, **dict(zip(names, r))} for r in rows])


def aged(file_rows):
    """The tables of times of last access."""
    access = rollups.build_access(file_rows)
    times = rollups.access_times(access)
    return {"access_usage": access, "access_times": times, "access_hours": rollups.access_hours(times)}


def inventory(spark, directories, file_rows, user_rows=None, runs=None):
    """All tables, the derived ones computed in memory."""
    ancestors = build_lineage(directories)
    usage = rollups.locate_usage(rollups.build_usage(file_rows), ancestors)
    lineage = rollups.with_direct_stats(ancestors, usage)
    return {
        "directories": directories,
        "files": file_rows,
        "users": user_rows
        or rollups.build_users(file_rows, directories).select(
            "uid", F.lit(None).cast("string").alias("username"), F.lit(None).cast("bigint").alias("gid")
        ),
        "directory_lineage": lineage,
        "directory_usage": usage,
        **aged(file_rows),
        "directory_intervals": build_intervals(lineage),
        "directory_closure": closure_of(lineage),
        "directory_stats": rollups.directory_stats(lineage, as_of_literal(AS_OF)),
        "user_stats": rollups.user_stats(usage),
        "crawl_runs": spark.createDataFrame(runs or [], "id bigint, finished_at timestamp"),
    }


def rows(df, *names):
    picked = df.select(*names) if names else df
    return [tuple(r) for r in picked.collect()]


def as_set(df, *names):
    found = rows(df, *names)
    assert len(found) == len(set(found))
    return set(found)
