"""Tables as versions: whole changes, conflicts, retries, removal of what is not named."""

import json

import pytest
from helpers import AS_OF, as_set, listing, rows, users
from pyspark.sql import functions as F

from dirgauge.operators import tables, versions
from dirgauge.plans import build
from dirgauge.streaming import finish_ingest, read_stream, stage_listing

SCAN = [("/d", "d", 0, 1), ("/d/x", "f", 5, 1), ("/d/e", "d", 0, 2), ("/d/e/y", "f", 7, 2)]


@pytest.fixture
def root(spark, tmp_path):
    path = str(tmp_path / "inventory")
    tables.create_tables(spark, path)
    return path


def counts(spark, root):
    return {n: df.count() for n, df in tables.open_tables(spark, root).items()}


def broken(df):
    """The same rows, one of which cannot be computed."""
    return df.withColumn("uid", F.when(F.col("uid") == 2, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("uid")))


def test_a_write_that_fails_leaves_the_old_rows(spark, root):
    tables.overwrite_table(users(spark, (1, "ann", 1), (3, "cy", 1)), root, "users")
    with pytest.raises(Exception, match="lost"):
        tables.overwrite_table(broken(users(spark, (1, "new", 1), (2, "bob", 2))), root, "users")
    assert as_set(tables.read_table(spark, root, "users"), "username") == {("ann",), ("cy",)}


def test_changes_to_several_tables_come_together(spark, root):
    with pytest.raises(RuntimeError):
        with tables.commit(spark, root) as changes:
            changes.append(users(spark, (1, "ann", 1)), "users")
            assert changes.read("users").count() == 1 and tables.read_table(spark, root, "users").count() == 0
            raise RuntimeError
    assert not any(counts(spark, root).values())


def test_a_failed_build_keeps_every_table_that_it_did_not_finish(spark, root, monkeypatch):
    build.ingest(spark, root, listing(spark, *SCAN), AS_OF)
    build.finish(spark, root, AS_OF)
    before = counts(spark, root)
    build.ingest(spark, root, listing(spark, ("/z", "d", 0, 1), ("/z/z", "f", 1, 1)), AS_OF)
    monkeypatch.setattr(build.rollups, "directory_stats", lambda lineage, as_of: lineage.select(F.raise_error(F.lit("lost")).cast("bigint").alias("dir_id"), *[F.lit(1).alias(c) for c in ("direct_bytes", "subtree_bytes", "file_count", "subtree_count")], as_of.alias("last_computed")))
    with pytest.raises(Exception, match="lost"):
        build.finish(spark, root, AS_OF)
    assert counts(spark, root)["directory_stats"] == before["directory_stats"] == 2


def test_of_two_commits_at_once_one_fails(spark, root):
    with pytest.raises(versions.ConflictError):
        with tables.commit(spark, root) as first:
            first.append(users(spark, (1, "ann", 1)), "users")
            tables.append_table(users(spark, (2, "bob", 1)), root, "users")
    assert as_set(tables.read_table(spark, root, "users"), "uid") == {(2,)}


def test_a_reader_keeps_its_version_and_vacuum_removes_what_nothing_names(spark, root):
    tables.overwrite_table(users(spark, (1, "ann", 1)), root, "users")
    old = versions.version(spark, root)["version"]
    opened = tables.read_table(spark, root, "users")
    tables.overwrite_table(users(spark, (2, "bob", 1)), root, "users")
    assert rows(opened, "uid") == [(1,)] and rows(tables.read_table(spark, root, "users", old), "uid") == [(1,)]
    with pytest.raises(Exception, match="lost"):
        tables.append_table(broken(users(spark, (2, "x", 1))), root, "users")
    assert versions.vacuum(spark, root, keep=1) == []  # all are younger than a day
    assert len(versions.vacuum(spark, root, keep=1, older_than=-1)) == 2
    assert rows(tables.read_table(spark, root, "users"), "uid") == [(2,)]
    tables.append_table(users(spark, (3, "cy", 1)), root, "users")
    assert tables.read_table(spark, root, "users").count() == 2


def test_an_unfinished_version_is_passed_over(spark, root, tmp_path):
    tables.append_table(users(spark, (1, "ann", 1)), root, "users")
    (tmp_path / "inventory" / "_versions" / "000000000099.json").write_text('{"version": 99, "tab')
    assert tables.read_table(spark, root, "users").count() == 1
    tables.append_table(users(spark, (2, "bob", 1)), root, "users")
    assert tables.read_table(spark, root, "users").count() == 2 and versions.version(spark, root)["version"] == 100


def test_tables_from_before_versions_are_taken_over(spark, tmp_path):
    root = str(tmp_path / "old")
    users(spark, (1, "ann", 1)).write.parquet(f"{root}/users")
    tables.create_tables(spark, root)
    tables.append_table(users(spark, (2, "bob", 1)), root, "users")
    assert as_set(tables.read_table(spark, root, "users"), "uid") == {(1,), (2,)}
    assert json.loads((tmp_path / "old" / "_versions" / "000000000001.json").read_text())["tables"]["files"] == []


def test_a_retried_ingest_repeats_nothing(spark, root, monkeypatch):
    publish = versions.Commit.publish
    monkeypatch.setattr(versions.Commit, "publish", lambda self: 1 / 0)
    entries = listing(spark, *SCAN, ("/q/f", "f", 1, 1))
    with pytest.raises(ZeroDivisionError):
        build.ingest(spark, root, entries, AS_OF, run="scan-1")
    assert not any(counts(spark, root).values())
    monkeypatch.setattr(versions.Commit, "publish", publish)
    for _ in range(2):
        assert rows(build.ingest(spark, root, entries, AS_OF, run="scan-1")) == [("/q/f", "NoParent")]
    found = counts(spark, root)
    assert (found["directories"], found["files"], found["ingest_errors"], found["ingest_ledger"]) == (2, 2, 1, 1)


def test_every_entry_is_stored_failed_or_skipped(spark, root):
    faults = [
        ("/d", "d", 0, 1), ("/d//x", "f", 5, 1), ("/d/x", "f", 9, 1), ("/d/l", "l", 0, 1), ("/d/.", "d", 0, 1), ("/d/s", "s", 0, 1),
        ("/d/t", "file", 3, 1), ("/d/u", None, 3, 1), ("/d/v", "f", None, 1), ("/q/f", "f", 1, 1), ("/d/w", "f", 1, 1, "IoError"),
    ]
    errors = build.ingest(spark, root, listing(spark, *SCAN, *faults), AS_OF)
    assert sorted(rows(errors)) == sorted([
        ("/d", "Repeated"), ("/d/x", "Repeated"), ("/d/x", "Repeated"), ("/d/t", "BadType"), ("/d/u", "BadType"), ("/d/v", "NoSize"),
        ("/q/f", "NoParent"), ("/d/w", "IoError"),
    ])
    done = tables.read_table(spark, root, "ingest_ledger").first()
    assert (done.listed, done.directories, done.files, done.failed, done.skipped) == (15, 2, 2, 8, 3)
    assert sum(r[0] for r in rows(tables.read_table(spark, root, "files"), "size_bytes")) in (12, 16)


def test_file_ids_go_on_without_gaps(spark, root):
    for k in range(2):
        build.ingest(spark, root, listing(spark, (f"/{k}", "d", 0, 1), *[(f"/{k}/{i}", "f", 1, 1) for i in range(50)]).repartition(8), AS_OF)
    assert sorted(r[0] for r in rows(tables.read_table(spark, root, "files"), "file_id")) == list(range(1, 101))


def test_late_files_go_to_their_own_filesystem(spark, root):
    both = None
    for name in ("one", "two"):
        part = listing(spark, ("/d", "d", 0, 1), ("/d/e", "d", 0, 1)).withColumn("filesystem", F.lit(name))
        both = part if both is None else both.unionByName(part)
    build.ingest(spark, root, both, AS_OF)
    build.ingest(spark, root, listing(spark, ("/d/e/late", "f", 9, 1)).withColumn("filesystem", F.lit("one")), AS_OF)
    assert build.ingest(spark, root, listing(spark, ("/d/e/x", "f", 9, 1)), AS_OF).count() == 1  # of no filesystem
    t = tables.open_tables(spark, root)
    assert rows(t["files"].join(t["directory_paths"], "dir_id"), "filesystem", "path", "filename") == [("one", "/d/e", "late")]


def stage(spark, tmp_path, arrived):
    stage_listing(read_stream(spark, arrived, files_per_trigger=1), str(tmp_path / "staged"), str(tmp_path / "offsets")).awaitTermination()


def test_a_batch_is_taken_in_once_wherever_a_run_is_interrupted(spark, tmp_path, root, monkeypatch):
    staged, arrived = str(tmp_path / "staged"), str(tmp_path / "arriving")
    assert finish_ingest(spark, staged, root, AS_OF).isEmpty()  # nothing staged
    for entry in SCAN:
        listing(spark, entry).coalesce(1).write.mode("append").parquet(arrived)
    stage(spark, tmp_path, arrived)
    publish = versions.Commit.publish
    monkeypatch.setattr(versions.Commit, "publish", lambda self: 1 / 0)  # after the append, before the mark is seen
    with pytest.raises(ZeroDivisionError):
        finish_ingest(spark, staged, root, AS_OF)
    monkeypatch.setattr(versions.Commit, "publish", publish)
    for _ in range(2):
        assert finish_ingest(spark, staged, root, AS_OF).isEmpty()
    found = counts(spark, root)
    assert (found["directories"], found["files"], found["ingest_ledger"]) == (2, 2, 4)
    assert versions.version(spark, root)["run"] == f"staging:{staged}"
