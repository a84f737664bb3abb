"""The largest totals and the children of one directory are found without reading all statistics."""

import random

import pytest
from helpers import AS_OF, dirs, files, inventory, listing, rows
from pyspark.sql import functions as F

from dirgauge.operators import joins, tables
from dirgauge.operators.intervals import child_totals
from dirgauge.plans import build, reports
from dirgauge.plans.delta import apply_delta


def stored(spark, path, n, files, block=None, low=0):
    """n directories in an even number of files each, totals in no order; `stats_maxima` and `directories` with them."""
    stats = spark.range(n).select(
        F.col("id").alias("dir_id"),
        *[F.lit(0).cast("bigint").alias(c) for c in ("direct_bytes", "file_count", "subtree_count")],
        (low + F.col("id") * 7919 % n).alias("subtree_bytes"),
    )
    writer = build.stats_layout(stats.repartition(files)).write
    (writer.option("parquet.block.size", block) if block else writer).parquet(path)
    kept = spark.read.parquet(path)
    paths = spark.range(n).select(F.col("id").alias("dir_id"), F.concat(F.lit("/d"), "id").alias("path"))
    return {"directory_stats": kept, "stats_maxima": tables.file_maxima(kept), "directories": paths}


def read_by(df, spark):
    """(files, rows) that the only scan of `df` reads."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        assert leaves.length() == 1
        metrics = leaves.apply(0).metrics()
        return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_only_files_and_row_groups_of_the_largest_are_read(spark, tmp_path):
    n = 200_000
    t = stored(spark, str(tmp_path / "stats"), n, 40, 16 * 1024)
    held = reports.holding_largest(t, 5)
    files, read = read_by(held, spark)
    assert files <= 5 and 5 <= read < n // 20, (files, read)
    want = [(f"/d{i}", b) for i, b in sorted(((i, i * 7919 % n) for i in range(n)), key=lambda r: -r[1])[:5]]
    assert rows(reports.top_dirs(t, 5), "path", "subtree_bytes") == want


@pytest.mark.parametrize("case", ["few files", "ties", "other files", "no maxima", "no rows"])
def test_all_files_are_read_where_the_maxima_do_not_tell(spark, tmp_path, monkeypatch, case):
    t = stored(spark, str(tmp_path / "stats"), 0 if case == "no rows" else 400, 8)
    if case == "ties":
        monkeypatch.setattr(reports, "MAX_PUSHED_IDS", 2)
    elif case == "other files":
        t["stats_maxima"] = t["stats_maxima"].limit(5)
    elif case == "no maxima":
        del t["stats_maxima"]
    n = 20 if case == "few files" else 3
    want = sorted(((i * 7919 % 400, f"/d{i}") for i in range(400)), reverse=True)[:n]
    got = rows(reports.top_dirs(t, n), "subtree_bytes", "path")
    assert got == ([] if case == "no rows" else want)


def test_ties_at_the_last_place_go_by_path(spark, tmp_path):
    path = str(tmp_path / "stats")
    stats = spark.range(60).select(F.col("id").alias("dir_id"), (F.col("id") % 3).alias("subtree_bytes"), F.lit(0).alias("subtree_count"))
    stats.repartition(6).write.parquet(path)
    kept = spark.read.parquet(path)
    paths = spark.range(60).select(F.col("id").alias("dir_id"), F.format_string("/%03d", "id").alias("path"))
    t = {"directory_stats": kept, "stats_maxima": tables.file_maxima(kept), "directories": paths}
    assert rows(reports.top_dirs(t, 4), "path") == [("/002",), ("/005",), ("/008",), ("/011",)]


def test_statistics_without_a_directory_do_not_count(spark, tmp_path):
    t = stored(spark, str(tmp_path / "stats"), 400, 8)
    t["directories"] = t["directories"].where("dir_id % 2 = 0")
    want = sorted(((i * 7919 % 400, f"/d{i}") for i in range(0, 400, 2)), reverse=True)[:3]
    assert rows(reports.top_dirs(t, 3), "subtree_bytes", "path") == want


def test_maxima_follow_the_statistics(spark, tmp_path, monkeypatch):
    root, rng = str(tmp_path / "inventory"), random.Random(4)
    entries = [("/r", "d", 0, 1)] + [(f"/r/{i}", "d", 0, 1) for i in range(30)]
    entries += [(f"/r/{rng.randrange(30)}/f{k}", "f", rng.randrange(1000), 1) for k in range(90)]
    tables.create_tables(spark, root)
    build.ingest(spark, root, listing(spark, *entries), AS_OF)
    build.finish(spark, root, AS_OF)

    def check():
        t = tables.open_tables(spark, root)
        of = t["directory_stats"].groupBy(F.col("_metadata.file_name")).agg(F.max("subtree_bytes"))
        assert set(rows(of)) == {r for r in rows(t["stats_maxima"]) if r[1] is not None}
        assert set(r[0] for r in rows(t["stats_maxima"])) == {f.rsplit("/", 1)[1] for f in t["directory_stats"].inputFiles()}
        plain = {k: v for k, v in t.items() if k not in ("stats_maxima", "child_totals")}
        for n in (1, 2, 7):
            assert rows(reports.top_dirs(t, n)) == rows(reports.top_dirs(plain, n))
        assert set(rows(t["child_totals"])) == set(
            rows(t["directories"].join(t["directory_stats"], "dir_id"), "parent_id", "dir_id", "subtree_bytes", "subtree_count")
        )
        top = t["directories"].where("path = '/r'").first()["dir_id"]
        few = rows(reports.dir_children(t, top))
        monkeypatch.setattr(reports, "if_few", lambda df: None)
        assert rows(reports.dir_children(t, top)) == rows(reports.dir_children(plain, top)) == few
        assert rows(reports.filesystems(t)) == rows(reports.filesystems(plain))
        monkeypatch.setattr(reports, "if_few", joins.if_few)

    check()
    change = [("/r/3", "d", 0, 1), ("/r/3/f", "f", 70_000, 1), ("/r/new", "d", 0, 1), ("/r/new/g", "f", 5, 1)]
    apply_delta(spark, root, listing(spark, *change), AS_OF)
    check()


def test_children_come_from_the_row_groups_of_their_parent(spark, tmp_path, monkeypatch):
    """A directory with many children: its totals are read by parent, the statistics are not."""
    monkeypatch.setattr(reports, "if_few", lambda df: None)
    path, n = str(tmp_path / "children"), 100_000
    made = spark.range(n).select((F.col("id") % 50).alias("parent_id"), F.col("id").alias("dir_id"), F.col("id").alias("subtree_bytes"), F.lit(1).alias("subtree_count"))
    made.repartitionByRange(4, "parent_id", "dir_id").sortWithinPartitions("parent_id", "dir_id").write.option("parquet.block.size", 16 * 1024).parquet(path)
    kept = spark.read.parquet(path)
    files, read = read_by(kept.where("parent_id = 7"), spark)
    assert n // 50 <= read < n // 5
    t = {
        "child_totals": kept,
        "directories": kept.select("dir_id", "parent_id", F.concat(F.lit("/"), "dir_id").alias("path")),
        "directory_stats": kept.select("dir_id", F.raise_error(F.lit("read")).cast("bigint").alias("subtree_bytes"), "subtree_count"),
    }
    got = reports.dir_children(t, 7)
    assert got.count() == n // 50 and got.first()["subtree_bytes"] == n - 43


def test_children_of_a_directory_that_is_not_stored(spark, monkeypatch):
    t = inventory(spark, dirs(spark, (1, "/a", 99), (2, "/b", 99), (3, "/a/c", 1)), files(spark, (1, 3, 10, 1), (2, 2, 5, 1)))
    t["child_totals"] = child_totals(t["directory_intervals"])
    assert set(rows(t["child_totals"])) == {(None, 1, 10, 1), (None, 2, 5, 1), (1, 3, 10, 1)}
    monkeypatch.setattr(reports, "if_few", lambda df: None)
    assert rows(reports.dir_children(t, 99), "dir_id", "subtree_bytes") == [(1, 10), (2, 5)]
    assert rows(reports.dir_children(t, 1), "dir_id", "subtree_bytes") == [(3, 10)]
