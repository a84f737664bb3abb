import pytest
from helpers import AS_OF, listing, rows

from dirgauge.operators import tables, tree
from dirgauge.operators.tree import resolve_tree
from dirgauge.plans import build
from dirgauge.sources.listing import classify
from pyspark.sql import functions as F


@pytest.fixture
def root(spark, tmp_path):
    tables.create_tables(spark, str(tmp_path))
    return str(tmp_path)


def stored(spark, root):
    """Path and parent's path of directories; directory's path and name of files."""
    d = tables.read_table(spark, root, "directories")
    up = d.select(F.col("dir_id").alias("up"), F.col("path").alias("up_path"))
    dirs = rows(d.join(up, F.col("parent_id") == F.col("up"), "left"), "path", "up_path")
    f = tables.read_table(spark, root, "files")
    return sorted(dirs), sorted(rows(f.join(up, F.col("dir_id") == F.col("up"), "left"), "up_path", "filename"))


def test_root_with_a_slash(spark, root):
    errors = build.ingest(spark, root, listing(spark, ("/data/", "d"), ("/data/x", "d"), ("/data/f", "f", 1, 1)), AS_OF)
    assert stored(spark, root) == ([("/data", None), ("/data/x", "/data")], [("/data", "f")])
    assert errors.count() == 0


def test_a_directory_listed_twice_does_not_multiply_its_files(spark, root):
    entries = listing(spark, ("/d", "d"), ("/d", "d"), ("/d/", "d"), ("/d/f", "f", 1, 1))
    errors = build.ingest(spark, root, entries, AS_OF)
    assert stored(spark, root) == ([("/d", None)], [("/d", "f")])
    assert rows(errors) == [("/d", "Repeated")] * 2


def test_entries_that_cannot_be_stored_are_returned(spark, root):
    entries = listing(spark, ("/d", "d"), ("/d/f", "f", None, 1), ("/gone/f", "f", 1, 1), ("/d/bad", "f", 0, 1, "IoError"))
    without = entries.limit(1).withColumn("path", F.lit(None).cast("string"))
    errors = build.ingest(spark, root, entries.unionByName(without), AS_OF)
    assert stored(spark, root) == ([("/d", None)], [])
    assert sorted(rows(errors), key=str) == [
        ("/d/bad", "IoError"), ("/d/f", "NoSize"), ("/gone/f", "NoParent"), (None, "NoPath"),
    ]


def test_a_later_listing_finds_stored_parents(spark, root):
    build.ingest(spark, root, listing(spark, ("/d", "d"), ("/d/a", "d"), ("/d/a/old", "f", 1, 1)), AS_OF)
    errors = build.ingest(spark, root, listing(spark, ("/d/a/new", "f", 5, 1), ("/d/b", "d"), ("/d/b/x", "f", 1, 1)), AS_OF)
    assert stored(spark, root) == (
        [("/d", None), ("/d/a", "/d"), ("/d/b", "/d")], [("/d/a", "new"), ("/d/a", "old"), ("/d/b", "x")],
    )
    assert errors.count() == 0


def test_files_of_listed_directories_are_not_looked_up_among_the_stored(spark, root, monkeypatch):
    """The directories of all files were collected and compared with the listed ones, and what was found was joined to all files."""
    looked, taken = [], tree._stored_parents

    def counted(entries, listed, stored):
        looked.append(sorted(r[0] for e in entries for r in e.select("path").collect() if r[0]))
        return taken(entries, listed, stored)

    monkeypatch.setattr(tree, "_stored_parents", counted)
    build.ingest(spark, root, listing(spark, ("/d", "d"), ("/d/old", "f", 1, 1)), AS_OF)
    assert looked == [["/d"]]
    entries = listing(spark, ("/e", "d"), ("/e/x", "f", 1, 1), ("/d/new", "f", 1, 1), ("/gone/f", "f", 1, 1))
    named = entries.withColumn("filesystem", F.lit(""))
    for again, name in ((entries, "new"), (named.where("path <> '/e'").withColumn("path", F.replace("path", F.lit("new"), F.lit("newer"))), "newer")):
        looked.clear()
        errors = build.ingest(spark, root, again, AS_OF)
        assert rows(errors) == [("/gone/f", "NoParent")]
        assert ("/d", name) in stored(spark, root)[1]
        assert looked[-1] == sorted(["/gone/f", f"/d/{name}"] + ["/e/x"] * (name == "newer"))
    assert stored(spark, root)[1] == [("/d", "new"), ("/d", "newer"), ("/d", "old"), ("/e", "x"), ("/e", "x")]


def test_given_roots_have_no_parent(spark, root):
    build.ingest(spark, root, listing(spark, ("/", "d"), ("/data", "d")), AS_OF, roots=["/", "/data/"])
    assert stored(spark, root)[0] == [("/", None), ("/data", None)]


def test_overlapping_roots_of_two_filesystems(spark):
    outer = listing(spark, ("/d", "d"), ("/d/e", "d"), ("/d/e/f", "f", 1, 1)).withColumn("filesystem", F.lit("outer"))
    inner = listing(spark, ("/d/e", "d"), ("/d/e/f", "f", 1, 1)).withColumn("filesystem", F.lit("inner"))
    directories, files = resolve_tree(*classify(outer.unionByName(inner)))
    assert sorted(rows(directories.groupBy("path").agg(F.count("*"), F.count("parent_id")))) == [("/d", 1, 0), ("/d/e", 2, 1)]
    placed = rows(files, "dir_id")
    assert len(placed) == 2 and len(set(placed)) == 2 and (None,) not in placed


def test_hot_keys_are_counted_without_a_single_task(spark, capsys):
    from dirgauge.operators.joins import heavy_keys

    facts = spark.range(4000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    assert set(heavy_keys(facts, "k")) == {"hot"}
