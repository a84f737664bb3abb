import pytest
from helpers import NOW, as_set, listing, rows
from pyspark.sql import functions as F

from dirgauge import sources
from dirgauge.operators.tree import resolve_tree
from dirgauge.schemas import LISTING

SCAN = [("/d", "d", 0, 1), ("/d/f", "f", 5, 2), ("/d/l", "l", 0, 2), ("/d/e", "f", 0, 2, "IoError")]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv", "orc"])
def test_listing_formats(spark, tmp_path, fmt):
    path = str(tmp_path / "listing")
    writer = listing(spark, *SCAN).write.format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)
    loaded = sources.load_listing(spark, path, fmt)
    assert as_set(loaded, "path", "entry_type", "size_bytes", "uid", "error_kind", "mtime") == {
        (*r[:4], r[4] if len(r) > 4 else None, NOW) for r in SCAN
    }


def test_several_filesystems(spark, tmp_path):
    for name, row in (("one", ("/a", "d")), ("two", ("/b", "d"))):
        listing(spark, row).write.parquet(str(tmp_path / name))
    roots = [(name, str(tmp_path / name)) for name in ("one", "two")]
    assert as_set(sources.load_roots(spark, roots), "filesystem", "path") == {("one", "/a"), ("two", "/b")}


def test_errors(spark):
    entries, errors = sources.split_errors(listing(spark, *SCAN, ("/d/g", "f", 0, 1, "IoError"), ("/n", "d", 0, 1, "NotFound")))
    assert entries.count() == 3 and "error_kind" not in entries.columns
    assert as_set(sources.error_counts(errors)) == {("IoError", 2), ("NotFound", 1)}


def test_delta(spark):
    times = ["2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-03 00:00:00", None]
    df = listing(spark, ("/d/a", "f"), ("/d/b", "f"), ("/e/c", "f"), ("/e/d", "f"))
    stamps = spark.createDataFrame(list(zip(["/d/a", "/d/b", "/e/c", "/e/d"], times)), "path string, t string")
    df = df.drop("mtime").join(stamps.select("path", F.col("t").cast("timestamp").alias("mtime")), "path")
    assert as_set(sources.delta(df, "2024-01-02 00:00:00"), "path") == {("/d/b",), ("/e/c",), ("/e/d",)}  # no time: not known to be older
    seen = spark.createDataFrame([("/d", "2024-01-02 00:00:00")], "path string, t string").select(
        "path", F.col("t").cast("timestamp").alias("last_seen_mtime")
    )
    kept = sources.delta_by_directory(df, seen)
    assert as_set(kept, "path") == {("/d/b",), ("/e/c",), ("/e/d",)}


def test_accounts(spark, tmp_path):
    (tmp_path / "accounts").write_text(
        "root:x:0:0:root:/root:/bin/sh\n"
        "short:x:5\n"
        "word:x:five:5\n"
        "spaced:x: 5:5\n"
        "minus:x:-5:5\n"
        "wide:x:4294967296:5\n"
        "top:x:4294967295:+7\r\n"
        "nogid:x:5:\n"
        "\n"
        "ann:x:8:80:c:h:s:extra\n"
        "later:x:8:81:::\n"
    )
    found = sources.load_accounts(spark, str(tmp_path / "accounts"))
    ordered = rows(found.orderBy("line_order"), "uid", "username", "gid")
    assert ordered == [
        (0, "root", 0), (4294967295, "top", 7), (8, "ann", 80), (8, "later", 81),
    ]


def test_directories_implied_by_listed_files(spark):
    found = listing(spark, ("/r/x.txt", "f", 5), ("/r/a/b/.y", "f", 1), ("/r/_z", "f", 2))
    implied = sources.implied_directories(found)
    assert as_set(implied, "path") == {("/r",), ("/r/a",), ("/r/a/b",)}
    directories, files = resolve_tree(implied, found)
    ids = {r["dir_id"]: r["path"] for r in directories.collect()}
    assert sorted(ids[r["dir_id"]] for r in files.collect()) == ["/r", "/r", "/r/a/b"]
    assert directories.where("parent_id IS NULL").count() == 1


def test_csv_quotes_are_doubled(spark, tmp_path):
    path = tmp_path / "l.csv"
    names = ",".join(f.name for f in LISTING.fields)
    first = [f.name for f in LISTING.fields].index("path")
    row = [""] * len(LISTING.fields)
    row[first] = '"/d/a ""q"" b"'
    path.write_text(names + "\n" + ",".join(row) + "\n")
    assert rows(sources.load_listing(spark, str(path), "csv"), "path") == [('/d/a "q" b',)]


def test_a_root_listed_as_a_dot_stays(spark):
    directories, files = sources.classify(listing(spark, (".", "d"), ("./.", "d"), ("./..", "d"), ("./f", "f", 1)))
    assert as_set(directories, "path") == {(".",)} and as_set(files, "path") == {("./f",)}


def test_file_names_may_end_with_a_line_break(spark):
    from dirgauge.functions.paths import file_name

    found = spark.createDataFrame([("/d/a\n",), ("/d/a/.",), ("/d/a/",)], "path string").select(file_name(F.col("path")))
    assert [r[0] for r in found.collect()] == ["a\n", "a", "a"]
