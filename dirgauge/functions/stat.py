"""Columns from raw stat fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First and last representable second (years -262143 to 262142).
MIN_SECOND = -8_334_601_228_800
MAX_SECOND = 8_210_266_876_799


def device_id(major: Column, minor: Column) -> Column:
    """Device numbers packed as (major << 32) | minor."""
    return F.shiftleft(major.cast("bigint"), 32).bitwiseOR(minor.cast("bigint"))


def stat_time(seconds: Column, nanos: Column) -> Column:
    """(seconds, nanoseconds) since the epoch as a timestamp; the epoch itself when out of range.
    Kept at microseconds: the rest is dropped."""
    valid = seconds.between(MIN_SECOND, MAX_SECOND) & nanos.between(0, 999_999_999)
    micros = seconds.cast("bigint") * 1_000_000 + F.floor(nanos / 1000)
    return F.when(valid, F.timestamp_micros(micros)).otherwise(F.timestamp_micros(F.lit(0)))
