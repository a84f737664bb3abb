import re
from datetime import datetime, timezone

import pytest
from helpers import rows
from pyspark.sql import functions as F

from dirgauge import functions as fx
from dirgauge.functions.formats import report_header


def values(spark, kind, items, column):
    df = spark.createDataFrame(list(enumerate(items)), f"i int, x {kind}")
    return [r[0] for r in rows(df.orderBy("i"), column.alias("y"))]


def test_fmt_bytes(spark):
    sizes = {
        0: "0 B", 1023: "1023 B", 1024: "1.0 KB", 1280: "1.2 KB", 1792: "1.8 KB", 1300: "1.3 KB",
        2**20 - 1: "1024.0 KB", 2**20: "1.0 MB", 2**30 - 1: "1024.0 MB", 2**30: "1.0 GB",
        5 * 2**40: "5120.0 GB", None: None,
    }
    assert values(spark, "bigint", list(sizes), fx.fmt_bytes(F.col("x"))) == list(sizes.values())


def test_fmt_bytes_tb(spark):
    sizes = {
        0: "0.0 KB", 100: "0.1 KB", 1280: "1.3 KB", 1792: "1.8 KB", 2**20: "1.0 MB",
        2**30: "1.0 GB", 2**40 - 1: "1024.0 GB", 2**40: "1.0 TB", None: None,
    }
    assert values(spark, "bigint", list(sizes), fx.fmt_bytes_tb(F.col("x"))) == list(sizes.values())


def test_gigabytes_and_counts(spark):
    assert values(spark, "bigint", [2**30, 3 * 2**29, 0], fx.gigabytes(F.col("x"))) == [1.0, 1.5, 0.0]
    assert values(spark, "bigint", [1234567, 12], fx.fmt_count(F.col("x"))) == ["1,234,567", "12"]


def test_fmt_mtime_follows_daylight_saving(spark):
    times = [datetime(2024, 1, 15, 12, 0), datetime(2024, 7, 15, 12, 0), None]
    want = ["2024-01-15 04:00", "2024-07-15 05:00", "—"]
    assert values(spark, "timestamp", times, fx.fmt_mtime(F.col("x"))) == want
    assert values(spark, "timestamp_ntz", times, fx.fmt_mtime(F.col("x"))) == want


def test_paths(spark):
    cases = {
        # path: (last segment, base name, file name, parent)
        "/a/b": ("b", "b", "b", "/a"),
        "/a": ("a", "a", "a", "/"),
        "/": ("", "/", "", None),
        "a": ("a", "a", "a", None),
        "a/b": ("b", "b", "b", "a"),
        "/a/b/": ("", "b", "b", "/a/b"),
        "/a/..": ("..", "..", "", "/a"),
        "/a/.": (".", ".", "a", "/a"),
        "": ("", "", "", None),
    }
    x = F.col("x")
    for place, column in enumerate([fx.last_segment(x), fx.base_name(x), fx.file_name(x), fx.parent_path(x)]):
        assert values(spark, "string", list(cases), column) == [c[place] for c in cases.values()], place


def test_path_order_is_by_component(spark):
    df = spark.createDataFrame([(p,) for p in ("/r/a-b", "/r/a/c", "/r/a", "/r/b")], "p string")
    assert [r[0] for r in rows(df.orderBy(fx.path_order(F.col("p"))))] == ["/r/a", "/r/a/c", "/r/a-b", "/r/b"]


def test_device_id(spark):
    df = spark.createDataFrame([(8, 1), (0, 0), (2**31 - 1, 2**32 - 1)], "a bigint, b bigint")
    assert [r[0] for r in rows(df, fx.device_id(F.col("a"), F.col("b")).alias("d"))] == [
        (8 << 32) | 1, 0, ((2**31 - 1) << 32) | (2**32 - 1),
    ]


def test_stat_time(spark):
    cases = [
        (0, 0, 0), (1, 999_999_999, 1_999_999), (-1, 500, -1_000_000), (1_700_000_000, 1500, 1_700_000_000_000_001),
        (8_210_266_876_799, 0, 8_210_266_876_799_000_000), (8_210_266_876_800, 0, 0), (2**62, 5, 0),
    ]
    df = spark.createDataFrame([(i, *c[:2]) for i, c in enumerate(cases)], "i int, s bigint, n bigint")
    got = rows(df.orderBy("i"), F.unix_micros(fx.stat_time(F.col("s"), F.col("n"))).alias("t"))
    assert [r[0] for r in got] == [c[2] for c in cases]


def test_file_line_escapes(spark):
    line = fx.file_line(F.col("x"), F.lit(3), F.lit(4))
    got = values(spark, "string", ['/a "b"', "/back\\slash", "/new\nline"], line)
    assert got == [
        '[FILE] "/a \\"b\\"" size=3 uid=4', '[FILE] "/back\\\\slash" size=3 uid=4', '[FILE] "/new\\nline" size=3 uid=4',
    ]


def test_report_header():
    title, rule = report_header("KB").split("\n")
    assert len(rule) == 80 and set(rule) == {"-"}
    assert title.startswith("Path ") and title.endswith("   UID")
    assert "   Size (KB) " in title and len(title) == 80


def test_as_of_accepts_zones(spark):
    from dirgauge.session import as_of_literal

    moment = datetime(2024, 1, 1, 12, tzinfo=timezone.utc)
    got = rows(spark.range(1).select(as_of_literal(moment).alias("a"), as_of_literal("2024-01-01 12:00:00").alias("b")))
    assert got[0][0] == got[0][1]


@pytest.mark.parametrize("unit,size", [("B", 2048.0), ("KB", 2.0), ("MB", 2 / 1024), ("GB", 2 / 1024**2)])
def test_units(spark, unit, size):
    assert values(spark, "bigint", [2048], fx.size_in_unit(F.col("x"), unit)) == [size]


def test_paths_that_are_in_order_meet_no_regular_expression(spark):
    """Only paths that a pattern can change go through it; all others are tested for their ends."""
    odd = ["/", "//", "///", "a", "", ".", "..", "/.", "a/.", "a/..", "/a//b/", "/a/b/./", "/a/b//.", "a/.b", "a/b..", "/a/b", None]
    df = spark.createDataFrame([(p,) for p in odd], "path string")
    got = df.select("path", fx.normal_path(F.col("path")).alias("normal"), fx.file_name(F.col("path")).alias("name")).collect()
    for path, normal, name in got:
        if path is None:
            assert normal is None and name is None
            continue
        single = re.sub("/+", "/", path)
        assert normal == (single if single == "/" else single.rstrip("/"))
        last = re.sub(r"(/\.?)+\Z", "", path).rsplit("/", 1)[-1]
        assert name == ("" if last in (".", "..") else last)
    plan = df.select(fx.file_name(F.col("path")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (EndsWith(path, /) OR EndsWith(path, /.)) THEN regexp_replace" in re.sub(r"#\d+", "", plan)
