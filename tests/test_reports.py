from datetime import datetime

import pytest
from helpers import aged, as_set, dirs, files, inventory, listing, rows, users

from dirgauge.plans import reports
from dirgauge.sources.listing import classify, split_errors

MAY = datetime(2024, 5, 1)


@pytest.fixture(scope="module")
def t(spark):
    d = dirs(
        spark,
        (1, "/b/data", None), (2, "/b/data/x", 1), (3, "/b/data/x/y", 2), (4, "/b/data/empty", 1),
        (5, "/a", None, 9), (6, "/b/data/w", 1),
    )
    f = files(
        spark,
        (1, 1, 10, 7, datetime(2024, 1, 1)), (2, 2, 20, 7, datetime(2024, 1, 2)),
        (3, 3, 30, 8, datetime(2024, 1, 3)), (4, 3, 40, 7, datetime(2024, 1, 4)),
        (5, 6, 60, 8, None), (6, 5, 5, 7, None),
    )
    u = users(spark, (7, "ann", 1), (8, None, None), (9, "zoe", 2), (1, None, None))
    runs = [(1, datetime(2024, 1, 1)), (2, datetime(2024, 3, 1, 5, 0))]
    kept = {k: df.cache() for k, df in inventory(spark, d, f, u, runs).items()}
    return kept


def test_filesystems(t):
    assert rows(reports.filesystems(t)) == [(5, "/a", 5, 1), (1, "/b/data", 160, 5)]


def test_children_keep_empty_ones_largest_first(t):
    assert rows(reports.dir_children(t, 1)) == [
        (2, "/b/data/x", 90, 3), (6, "/b/data/w", 60, 1), (4, "/b/data/empty", 0, 0),
    ]


def test_users_keep_those_without_files(t):
    assert rows(reports.users(t)) == [
        (8, "8", 90, 2), (7, "ann", 75, 4), (1, "1", 0, 0), (9, "zoe", 0, 0),
    ]


def test_user_breakdown(t):
    assert rows(reports.user_breakdown(t, 7)) == [(1, "/b/data", 70, 3), (5, "/a", 5, 1)]
    assert rows(reports.user_breakdown(t, 9)) == []


def test_user_children_drop_those_without_files(t):
    assert rows(reports.user_dir_children(t, 7, 1)) == [(2, "/b/data/x", 60, 2, datetime(2024, 1, 4))]
    assert rows(reports.user_dir_children(t, 8, 1)) == [
        (6, "/b/data/w", 60, 1, None), (2, "/b/data/x", 30, 1, datetime(2024, 1, 3)),
    ]
    assert rows(reports.user_dir_children(t, 7, 3)) == []


def test_user_tree_latest_first_nulls_last(t):
    assert rows(reports.user_tree(t, 7), "dir_id", "user_bytes", "user_files") == [
        (3, 40, 1), (2, 20, 1), (1, 10, 1), (5, 5, 1),
    ]


def test_user_tree_stops_at_200(spark):
    many = [(n, f"/r/{n}", None) for n in range(1, 251)]
    d = dirs(spark, *many)
    f = files(spark, *[(n, n, 1, 7, datetime(2024, 1, 1 + n % 3)) for n, _, _ in many])
    got = rows(reports.user_tree(inventory(spark, d, f), 7), "last_mtime", "dir_id")
    assert len(got) == 200
    assert got == sorted(got, key=lambda r: (-r[0].toordinal(), r[1]))


def test_last_crawled_is_a_local_date(t, spark):
    assert rows(reports.last_crawled(t), "label") == [("data as of 2024-02-29",)]
    empty = {"crawl_runs": spark.createDataFrame([], "id bigint, finished_at timestamp")}
    assert rows(reports.last_crawled(empty)) == [(None, "")]


def test_staleness_bounds_and_quarters(spark):
    times = [
        datetime(2000, 1, 1),                       # out: not after the bound
        datetime(2000, 1, 1, 0, 0, 0, 1),           # in
        datetime(2024, 5, 2),                       # in: as_of + 1 day
        datetime(2024, 5, 2, 0, 0, 0, 1),           # out
        None,                                       # out
        datetime(2023, 12, 31, 23, 59),             # in
        datetime(2024, 1, 1),                       # in
    ]
    f = files(spark, *[(i, 1, 2**i, 7 if i else 8, None, at) for i, at in enumerate(times)])
    got = rows(reports.staleness(aged(f), MAY))
    assert got == [("2000 Q1", 1, 2), ("2023 Q4", 1, 32), ("2024 Q1", 1, 64), ("2024 Q2", 1, 4)]
    of_users = inventory(spark, dirs(spark, (1, "/r", None)), f)
    assert rows(reports.staleness(of_users, MAY, 8)) == []
    assert rows(reports.staleness(of_users, MAY, 7)) == got


def test_user_summary(t):
    assert rows(reports.user_summary(t, 7)) == [("ann", 75, 4)]
    assert rows(reports.user_summary(t, 9)) == [("zoe", 0, 0)]
    assert rows(reports.user_summary(t, 12345)) == []


def test_cumulative_size_is_null_without_files(t):
    assert rows(reports.cumulative_size(t, 1)) == [(160,)]
    assert rows(reports.cumulative_size(t, 4)) == [(None,)]


def test_usage_by_username_merges_unnamed_and_drops_fileless(t):
    assert rows(reports.usage_by_username(t)) == [(None, 90), ("ann", 75)]


def test_top_dirs_breaks_ties_by_path(t):
    assert rows(reports.top_dirs(t, 4)) == [
        ("/b/data", 160, 5), ("/b/data/x", 90, 3), ("/b/data/x/y", 70, 2), ("/b/data/w", 60, 1),
    ]
    assert len(rows(reports.top_dirs(t, 100))) == 6


def test_top_dirs_with_ties_at_the_limit(spark):
    d = dirs(spark, *[(n, f"/{n:03}", None) for n in range(1, 60)])
    f = files(spark, *[(n, n, 9, 7) for n in range(1, 60)])
    got = rows(reports.top_dirs(inventory(spark, d, f)), "path")
    assert got == [(f"/{n:03}",) for n in range(1, 21)]


def test_grand_totals(t):
    assert rows(reports.grand_totals(t)) == [(165, 6)]


def test_size_share(spark, t):
    shares = dict(rows(reports.size_share(reports.users(t), "total_bytes"), "uid", "pct"))
    assert shares == {8: 100.0, 7: 83.3, 1: 0.0, 9: 0.0}
    zero = spark.createDataFrame([(0,), (0,)], "b bigint")
    assert rows(reports.size_share(zero, "b"), "pct") == [(0.0,), (0.0,)]
    huge = spark.createDataFrame([(2**63 - 1,), (2**62,)], "b bigint")
    assert sorted(rows(reports.size_share(huge, "b"), "pct")) == [(50.0,), (100.0,)]
    half = spark.createDataFrame([(1,), (2000,)], "b bigint")
    assert sorted(rows(reports.size_share(half, "b"), "pct")) == [(0.1,), (100.0,)]


def test_sorted_listing(spark):
    df = spark.createDataFrame(
        [(1, "b", datetime(2024, 1, 1)), (2, "A", None), (3, "C", datetime(2023, 1, 1))],
        "id int, name string, mtime timestamp",
    )
    assert rows(reports.sorted_listing(df, "name", True, "id"), "id") == [(2,), (1,), (3,)]
    assert rows(reports.sorted_listing(df, "mtime", False, "id"), "id") == [(1,), (3,), (2,)]
    assert rows(reports.sorted_listing(df, "mtime", True, "id"), "id") == [(2,), (3,), (1,)]


def test_breadcrumb(t):
    assert rows(reports.breadcrumb(t, 3)) == [(1, "data", 0), (2, "x", 1), (3, "y", 2)]
    assert rows(reports.breadcrumb(t, 5)) == [(5, "a", 0)]


def test_table_counts_in_fixed_order(t):
    assert rows(reports.table_counts(t)) == [
        ("files", 6), ("directories", 6), ("directory_stats", 6), ("directory_closure", 11), ("users", 4),
    ]


def test_table_count_lines(t):
    assert rows(reports.table_count_lines(t))[1] == ("directories" + " " * 15 + "6",)


def test_labels_and_chart(t, spark):
    shown = reports.labelled(reports.user_dir_children(t, 8, 1), "user_bytes", "path", "last_mtime")
    assert rows(shown, "name", "size", "modified") == [("w", "60 B", "—"), ("x", "30 B", "2024-01-02 16:00")]
    points = spark.createDataFrame([("2024 Q1", 1234, 3 * 2**29)], "label string, file_count bigint, total_bytes bigint")
    assert rows(reports.chart(points)) == [("2024 Q1", 1.5, "1,234 files")]


REPORT = [
    ("/r/a-b", "f", 1152, 1), ("/r/a/c", "f", 3200, 2), ("/r", "d", 0, 1), ("/r/z", "f", 0, 1),
    ("/r/bad", "f", 9, 1, "IoError"),
]


def test_file_report(spark):
    entries, errors = split_errors(listing(spark, *REPORT))
    f = classify(entries)[1].withColumnRenamed("uid", "owner_uid")
    by_path = rows(reports.file_report(f), "path", "size", "line")
    assert [r[0] for r in by_path] == ["/r/a/c", "/r/a-b", "/r/z"]
    assert by_path[0][2] == f"{'/r/a/c':<60} {'3.12':>12} {'2':>6}"
    assert by_path[1][1:] == (1.125, f"{'/r/a-b':<60} {'1.12':>12} {'1':>6}")
    assert [r[0] for r in rows(reports.file_report(f, "size", "B"), "size")] == [3200.0, 1152.0, 0.0]
    assert [r[0] for r in rows(reports.file_report(f, "owner"), "uid")] == [1, 1, 2]
    assert rows(reports.scan_totals(f, errors)) == [(3, 4352, 1)]
    assert rows(reports.file_lines(f.where("path = '/r/z'"))) == [('[FILE] "/r/z" size=0 uid=1',)]


def test_text_report_in_order(spark):
    entries, errors = split_errors(listing(spark, *REPORT))
    f = classify(entries)[1].withColumnRenamed("uid", "owner_uid")
    got = rows(reports.text_report(f.repartition(3), errors, "size", "B"), "position", "line")
    assert [p for p, _ in got] == list(range(1, 10))
    lines = [line for _, line in got]
    assert lines[0].split() == ["Path", "Size", "(B)", "UID"] and lines[1] == lines[5] == "-" * 80
    assert [line.split()[0] for line in lines[2:5]] == ["/r/a/c", "/r/a-b", "/r/z"]
    assert lines[6:] == ["files:  3", "bytes:  4352", "errors: 1"]
    none = rows(reports.text_report(f.where("false"), errors.where("false")), "line")
    assert [line for (line,) in none][2:] == ["-" * 80, "files:  0", "bytes:  0", "errors: 0"]


def test_top_dirs_leaves_out_statistics_without_a_directory(spark):
    d = dirs(spark, *[(n, f"/{n}", None) for n in range(1, 6)])
    f = files(spark, *[(n, n, n, 7) for n in range(1, 6)])
    full = inventory(spark, d, f)
    orphaned = {**full, "directories": full["directories"].where("dir_id NOT IN (4, 5)")}
    assert rows(reports.top_dirs(orphaned, 2), "path") == [("/3",), ("/2",)]
    assert rows(reports.top_dirs(orphaned, 9), "path") == [("/3",), ("/2",), ("/1",)]


def test_scan_totals_of_nothing(spark):
    entries, errors = split_errors(listing(spark))
    assert rows(reports.scan_totals(entries, errors)) == [(0, 0, 0)]


def test_descendants(t):
    assert as_set(reports.descendants(t, 2)) == {(2, 0), (3, 1)}


def test_one_user_reads_only_their_rows(t, spark, tmp_path):
    path = str(tmp_path / "usage")
    t["directory_usage"].write.parquet(path)
    stored = {**t, "directory_usage": spark.read.parquet(path)}
    plan = reports.user_tree(stored, 7)._jdf.queryExecution().toString()
    assert "EqualTo(owner_uid,7)" in plan
