"""Display text for sizes, times and report lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit sizes, display zone, placeholders and report column widths.
KB = 1_024
MB = 1_048_576
GB = 1_073_741_824
TB = 1_099_511_627_776
SIZE_UNITS = {"B": 1, "KB": KB, "MB": MB, "GB": GB}
DISPLAY_ZONE = "America/Los_Angeles"
NO_TIME = "—"
PATH_WIDTH, SIZE_WIDTH, UID_WIDTH = 60, 12, 6


def _tenths(size: Column, unit: int, rounding) -> Column:
    """`size / unit` as text with one decimal. The quotient by a power of two is exact, so the given
    rounding sees true ties; after it, "%.1f" has nothing left to round."""
    return F.format_string("%.1f", rounding(size.cast("double") / F.lit(float(unit)), 1))


def fmt_bytes(size: Column) -> Column:
    """GB, MB, KB with one decimal, else whole bytes. Exact ties go to the even digit (1280 is
    "1.2 KB"), as the server-side text does."""
    return (
        F.when(size >= GB, F.concat(_tenths(size, GB, F.bround), F.lit(" GB")))
        .when(size >= MB, F.concat(_tenths(size, MB, F.bround), F.lit(" MB")))
        .when(size >= KB, F.concat(_tenths(size, KB, F.bround), F.lit(" KB")))
        .otherwise(F.concat(size.cast("string"), F.lit(" B")))
    )


def fmt_bytes_tb(size: Column) -> Column:
    """TB, GB, MB, else KB with one decimal, ties away from zero (the title-bar text)."""
    return (
        F.when(size >= TB, F.concat(_tenths(size, TB, F.round), F.lit(" TB")))
        .when(size >= GB, F.concat(_tenths(size, GB, F.round), F.lit(" GB")))
        .when(size >= MB, F.concat(_tenths(size, MB, F.round), F.lit(" MB")))
        .when(size.isNotNull(), F.concat(_tenths(size, KB, F.round), F.lit(" KB")))
    )


def gigabytes(size: Column) -> Column:
    """Bytes as GB with one decimal, for charts."""
    return F.round(size.cast("double") / F.lit(float(GB)), 1)


def fmt_count(n: Column) -> Column:
    """Whole number with thousands separators."""
    return F.format_number(n, 0)


def local_time(ts: Column, pattern: str) -> Column:
    """A UTC timestamp as text in the display zone. Needs session time zone UTC."""
    return F.date_format(F.from_utc_timestamp(ts, DISPLAY_ZONE), pattern)


def fmt_mtime(ts: Column) -> Column:
    return F.coalesce(local_time(ts, "yyyy-MM-dd HH:mm"), F.lit(NO_TIME))


def quarter_label(year: Column, quarter: Column) -> Column:
    return F.concat(year.cast("string"), F.lit(" Q"), quarter.cast("string"))


def size_in_unit(size: Column, unit: str) -> Column:
    return size.cast("double") / F.lit(float(SIZE_UNITS[unit]))


def report_line(path: Column, size: Column, uid: Column) -> Column:
    """Fixed-width report row: path left, size with two decimals (ties to even), uid right."""
    return F.format_string(
        f"%-{PATH_WIDTH}s %{SIZE_WIDTH}.2f %{UID_WIDTH}d", path, F.bround(size, 2), uid
    )


def report_header(unit: str) -> str:
    """Column titles and the rule below them; the same rule precedes the totals."""
    title = f"{'Path':<{PATH_WIDTH}} {f'Size ({unit})':>{SIZE_WIDTH}} {'UID':>{UID_WIDTH}}"
    return f"{title}\n{report_rule()}"


def report_rule() -> str:
    return "-" * (PATH_WIDTH + SIZE_WIDTH + UID_WIDTH + 2)


def file_line(path: Column, size: Column, uid: Column) -> Column:
    """One text line per file; quotes, backslashes and line breaks in the path are escaped."""
    quoted = path
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(raw), F.lit(escaped))
    return F.format_string('[FILE] "%s" size=%d uid=%d', quoted, size, uid)
