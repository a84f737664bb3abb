import pyarrow.parquet as pq
import pytest
from helpers import AS_OF, NOW, as_set, dirs, files, listing, rows, users
from pyspark.sql import functions as F

from dirgauge.operators import tables
from dirgauge.operators.audit import audit
from dirgauge.plans import build, reports
from dirgauge.schemas import TABLES

LATER = "2024-06-01 00:00:00"

SCAN = [
    ("/data", "d", 0, 1), ("/data/a", "d", 0, 2), ("/data/x", "f", 5, 1), ("/data/a/y", "f", 6, 2),
    ("/home", "d", 0, 3), ("/home/z", "f", 7, 2), ("/home/bad", "f", 0, 1, "NotFound"),
]


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "inventory")
    tables.create_tables(spark, path)
    return path


def read(spark, root, table):
    return tables.read_table(spark, root, table)


def test_created_tables_are_empty_with_their_schema(spark, root):
    for table, schema in TABLES.items():
        df = read(spark, root, table)
        assert df.count() == 0
        assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in schema]


def test_create_keeps_rows_and_clear_drops_them(spark, root):
    tables.append_table(users(spark, (1, "ann", 1)), root, "users")
    tables.create_tables(spark, root)
    assert read(spark, root, "users").count() == 1
    tables.clear_tables(spark, root)
    assert read(spark, root, "users").count() == 0


def test_ingest_appends_with_one_last_seen_and_new_ids(spark, root):
    errors = build.ingest(spark, root, listing(spark, *SCAN), AS_OF)
    assert as_set(errors) == {("/home/bad", "NotFound")}
    build.ingest(spark, root, listing(spark, ("/tmp", "d", 0, 1), ("/tmp/t", "f", 1, 1)), LATER)
    found = read(spark, root, "files")
    assert as_set(found, "filename", "size_bytes") == {("x", 5), ("y", 6), ("z", 7), ("t", 1)}
    assert found.select("file_id").distinct().count() == 4
    assert sorted(r[0] for r in rows(read(spark, root, "directories"), "dir_id")) == [1, 2, 3, 4]
    seen = found.groupBy(F.col("last_seen").cast("string").alias("s")).count()
    assert as_set(seen) == {(AS_OF, 3), (LATER, 1)}


def test_id_beyond_bigint_raises(spark, root):
    wide = files(spark, (1, 1, 1, 1)).withColumn("inode", F.lit("9223372036854775808").cast("decimal(20,0)"))
    with pytest.raises(Exception, match="OVERFLOW|OUT_OF_RANGE"):
        tables.append_table(wide, root, "files")


def test_finish_twice_changes_only_the_run_log(spark, root):
    build.ingest(spark, root, listing(spark, *SCAN), AS_OF)
    build.finish(spark, root, AS_OF)
    first = {name: sorted(map(str, rows(read(spark, root, name)))) for name in tables.ALL_TABLES}
    build.finish(spark, root, AS_OF)
    second = {name: sorted(map(str, rows(read(spark, root, name)))) for name in tables.ALL_TABLES}
    assert len(first.pop("crawl_runs")) == 1 and len(second.pop("crawl_runs")) == 2
    assert first == second
    t = tables.open_tables(spark, root)
    assert audit(t).count() == 0
    assert rows(reports.filesystems(t), "path", "subtree_bytes") == [("/data", 11), ("/home", 7)]
    assert rows(reports.users(t), "uid", "total_bytes") == [(2, 13), (1, 5), (3, 0)]


def test_finish_after_more_data_updates_totals_and_keeps_names(spark, root):
    build.ingest(spark, root, listing(spark, *SCAN), AS_OF)
    build.finish(spark, root, AS_OF)
    named = users(spark, (1, "ann", 10), (2, None, None), (3, "cy", 30))
    tables.overwrite_table(named, root, "users")
    build.ingest(spark, root, listing(spark, ("/var", "d", 0, 4), ("/var/log", "f", 100, 1)), LATER)
    build.finish(spark, root, LATER)
    t = tables.open_tables(spark, root)
    assert as_set(t["users"]) == {(1, "ann", 10), (2, None, None), (3, "cy", 30), (4, None, None)}
    assert rows(reports.filesystems(t), "path", "subtree_bytes") == [("/data", 11), ("/home", 7), ("/var", 100)]
    assert rows(reports.user_summary(t, 1)) == [("ann", 105, 2)]
    assert rows(t["crawl_runs"].orderBy("id"), "id") == [(1,), (2,)]


def test_finish_refuses_files_without_owner(spark, root):
    build.ingest(spark, root, listing(spark, ("/d", "d", 0, 1), ("/d/f", "f", 3, None)), AS_OF)
    with pytest.raises(ValueError, match="owner"):
        build.finish(spark, root, AS_OF)
    assert read(spark, root, "directory_stats").count() == 1
    assert read(spark, root, "crawl_runs").count() == 0


def test_run_log_numbers_runs(spark, root):
    tables.log_run(spark, root, AS_OF)
    tables.log_run(spark, root, NOW)
    assert as_set(read(spark, root, "crawl_runs")) == {(1, NOW), (2, NOW)}


def test_insert_absent_keeps_known_rows(spark):
    known = users(spark, (1, "ann", 5))
    fresh = spark.createDataFrame([(1,), (2,), (2,)], "uid bigint")
    assert as_set(tables.insert_absent(known, fresh, ["uid"])) == {(1, "ann", 5), (2, None, None)}


def test_upsert_replaces_matching_rows(spark):
    kind = "uid bigint, dir_id bigint, total_bytes bigint, file_count bigint"
    old = spark.createDataFrame([(1, 1, 10, 1), (1, 2, 20, 2)], kind)
    new = spark.createDataFrame([(1, 2, 99, 9), (3, 1, 5, 5)], kind)
    assert as_set(tables.upsert(old, new, ["uid", "dir_id"])) == {(1, 1, 10, 1), (1, 2, 99, 9), (3, 1, 5, 5)}


def test_enrich_users_last_account_wins(spark):
    known = users(spark, (1, "old", 1), (2, "kept", 2), (3, None, None))
    accounts = spark.createDataFrame(
        [(1, "first", 10, 1), (1, "last", 11, 2), (3, "cy", 30, 3), (9, "nobody", 90, 4)],
        "uid bigint, username string, gid bigint, line_order bigint",
    )
    assert as_set(tables.enrich_users(known, accounts)) == {(1, "last", 11), (2, "kept", 2), (3, "cy", 30)}


def test_overwriting_a_table_with_its_own_rows(spark, root):
    tables.append_table(users(spark, (1, "ann", 1), (2, "bob", 2)), root, "users")
    tables.replace_from_itself(read(spark, root, "users").where("uid = 2"), root, "users")
    assert as_set(read(spark, root, "users")) == {(2, "bob", 2)}


def test_dirs_helper_matches_table(spark, root):
    tables.append_table(dirs(spark, (1, "/a", None)), root, "directories")
    assert rows(read(spark, root, "directories"), "dir_id", "path") == [(1, "/a")]


def test_tables_are_stored_with_zstd(spark, tmp_path):
    tables.write_parquet(spark.range(1000), "files", str(tmp_path / "t"), "error")
    stored = [pq.ParquetFile(p).metadata for p in (tmp_path / "t").glob("*.parquet")]
    assert {m.row_group(0).column(0).compression for m in stored if m.num_rows} == {"ZSTD"}
