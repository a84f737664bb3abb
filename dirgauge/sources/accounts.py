"""Account files: name:password:uid:gid:comment:home:shell, one account per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_U32 = 4_294_967_295


def _unsigned(field: Column) -> Column:
    """A 32-bit unsigned number, NULL for anything else (signs other than '+', spaces, overflow)."""
    digits = F.when(field.rlike(r"^\+?[0-9]+$"), F.ltrim(field, F.lit("+")))
    number = digits.try_cast("bigint")
    return F.when(number <= MAX_U32, number)


def parse_accounts(lines: DataFrame) -> DataFrame:
    """Lines (`value`, `line_order`) to (uid, username, gid, line_order). Lines with fewer than four
    fields or without numeric ids are skipped."""
    fields = F.split(F.regexp_replace("value", "\r$", ""), ":")
    return (
        lines.where(F.size(fields) >= 4)
        .select(
            _unsigned(fields[2]).alias("uid"),
            fields[0].alias("username"),
            _unsigned(fields[3]).alias("gid"),
            "line_order",
        )
        .where("uid IS NOT NULL AND gid IS NOT NULL")
    )


def load_accounts(spark: SparkSession, path: str) -> DataFrame:
    """Accounts of a file or folder, with the position of each line: file, split, line."""
    lines = spark.read.option("lineSep", "\n").text(path)
    position = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    return parse_accounts(lines.select("value", position.alias("line_order")))
