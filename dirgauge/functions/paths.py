"""Path text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_path(path: Column) -> Column:
    """Without repeated and trailing slashes, the root directory apart."""
    single = F.regexp_replace(path, "/+", "/")
    tidied = F.when(single == "/", single).otherwise(F.rtrim(single, F.lit("/")))
    return F.when(path.contains("//") | (path.endswith("/") & (path != "/")), tidied).otherwise(path)


def last_segment(path: Column) -> Column:
    """Text after the last slash; empty for a path that ends in one."""
    return F.substring_index(path, "/", -1)


def base_name(path: Column) -> Column:
    """Last non-empty segment, or the whole path if it has none."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.when(F.size(segments) > 0, F.element_at(segments, -1)).otherwise(path)


def file_name(path: Column) -> Column:
    """Final component of a path; '' where there is none ('/', '.', '..')."""
    ends = F.regexp_replace(path, r"(/\.?)+\z", "")
    name = last_segment(F.when(path.endswith("/") | path.endswith("/."), ends).otherwise(path))
    return F.when(name.isin(".", ".."), F.lit("")).otherwise(name)


def parent_path(path: Column) -> Column:
    """Path without its last component; NULL for '/' and for a single relative name."""
    slash = F.length(path) - F.length(last_segment(path))
    return (
        F.when((slash == 0) | (path == "/"), F.lit(None).cast("string"))
        .when(slash == 1, F.lit("/"))
        .otherwise(path.substr(F.lit(1), slash - 1))
    )


def path_order(path: Column) -> Column:
    """Sort key that compares paths component by component, so '/r/a/c' precedes '/r/a-b'."""
    return F.split(path, "/")
