"""A scan of part of the tree against a full build on the merged listing."""

import random

import pytest
from helpers import AS_OF, as_set, listing, rows
from pyspark.sql import functions as F

from dirgauge.operators import joins, tables
from dirgauge.operators.audit import audit
from dirgauge.operators.joins import Keys
from dirgauge.plans import build
from dirgauge.plans.delta import apply_delta


def state(spark, root):
    """All tables, ids replaced by paths."""
    t = tables.open_tables(spark, root)
    path = dict(rows(t["directory_paths"], "dir_id", "path"))
    assert len(path) == t["directory_paths"].count() == t["directories"].count()
    up = lambda i: path.get(i, i)
    found = {
        "directories": [(up(d), p, up(u), o) for d, p, u, o in rows(t["directories"], "dir_id", "path", "parent_id", "owner_uid")],
        "files": [(up(d), *r) for d, *r in rows(t["files"], "dir_id", "filename", "size_bytes", "owner_uid", "atime")],
        "directory_stats": [(up(d), *r) for d, *r in rows(t["directory_stats"].drop("last_computed"))],
        "user_stats": [(u, up(d), *r) for u, d, *r in rows(t["user_stats"])],
        "directory_closure": [(up(a), up(d), n) for a, d, n in rows(t["directory_closure"])],
        "directory_lineage": [(up(d), tuple(map(up, a)), up(r), b, n) for d, a, r, b, n in rows(t["directory_lineage"])],
        "directory_usage": [(up(d), o, b, n, tuple(map(up, a)), up(r)) for d, o, b, n, _, a, r in rows(t["directory_usage"])],
        "access_usage": rows(t["access_usage"]),
    }
    return {k: sorted(v, key=repr) for k, v in found.items()}


def build_all(spark, root, entries):
    tables.create_tables(spark, root)
    build.ingest(spark, root, listing(spark, *entries), AS_OF)
    build.finish(spark, root, AS_OF)


FIRST = [
    ("/r", "d", 0, 1), ("/r/a", "d", 0, 1), ("/r/a/x", "d", 0, 2), ("/r/b", "d", 0, 3), ("/r/b/y", "d", 0, 1), ("/s", "d", 0, 4),
    ("/r/f", "f", 1, 1), ("/r/a/f", "f", 10, 1), ("/r/a/g", "f", 100, 2), ("/r/a/x/f", "f", 1000, 2),
    ("/r/b/f", "f", 10_000, 3), ("/r/b/y/f", "f", 100_000, 1), ("/s/f", "f", 5, 4),
]


@pytest.fixture
def root(spark, tmp_path):
    build_all(spark, str(tmp_path / "inventory"), FIRST)
    return str(tmp_path / "inventory")


def check(spark, tmp_path, root, scan, merged):
    apply_delta(spark, root, listing(spark, *scan), AS_OF)
    build_all(spark, str(tmp_path / "whole"), merged)
    assert state(spark, root) == state(spark, str(tmp_path / "whole"))
    assert audit(tables.open_tables(spark, root)).count() == 0


def test_inserted_changed_and_removed(spark, tmp_path, root):
    scan = [
        ("/r/a", "d", 0, 9), ("/r/a/f", "f", 11, 1), ("/r/a/h", "f", 7, 5),  # f grew, g and x went, h and n came
        ("/r/a/n", "d", 0, 6), ("/r/a/n/m", "d", 0, 6), ("/r/a/n/m/f", "f", 3, 6),
    ]
    gone = {"/r/a", "/r/a/x", "/r/a/f", "/r/a/g", "/r/a/x/f"}
    check(spark, tmp_path, root, scan, [e for e in FIRST if e[0] not in gone] + scan)
    assert (2,) in as_set(tables.read_table(spark, root, "users"), "uid")  # users stay


def test_a_scan_that_finds_everything_as_it_was(spark, tmp_path, root):
    before = tables.read_table(spark, root, "files").count()
    check(spark, tmp_path, root, FIRST, FIRST)
    assert tables.read_table(spark, root, "files").count() == before


def test_what_could_not_be_read_stays(spark, tmp_path, root):
    scan = [("/r", "d", 0, 1), ("/r/f", "f", 2, 1), ("/r/a", "d", 0, 1, "IoError"), ("/r/b", "d", 0, 3), ("/r/b/f", "f", 0, 3, "IoError")]
    merged = [e for e in FIRST if e[0] not in ("/r/f", "/r/b/y", "/r/b/y/f")] + [("/r/f", "f", 2, 1)]
    check(spark, tmp_path, root, scan, merged)


def test_a_file_of_a_directory_that_is_not_listed_is_added(spark, tmp_path, root):
    check(spark, tmp_path, root, [("/r/a/new", "f", 4, 8), ("/t", "d", 0, 1)], [*FIRST, ("/r/a/new", "f", 4, 8), ("/t", "d", 0, 1)])


def test_a_run_is_applied_once_and_a_failing_one_not_at_all(spark, root, monkeypatch):
    scan = listing(spark, ("/r/a", "d", 0, 1), ("/r/a/f", "f", 20, 1), ("/q/f", "f", 1, 1))
    before = state(spark, root)
    with pytest.raises(ValueError, match="owner"):
        apply_delta(spark, root, listing(spark, ("/r/a", "d", 0, 1), ("/r/a/f", "f", 1, None)), AS_OF, "scan")
    assert state(spark, root) == before
    for _ in range(2):
        assert rows(apply_delta(spark, root, scan, AS_OF, "scan")) == [("/q/f", "NoParent")]
    assert tables.read_table(spark, root, "crawl_runs").count() == 2


def test_random_scans(spark, tmp_path):
    rng = random.Random(12)
    root, entries = str(tmp_path / "inventory"), {"/r": ("/r", "d", 0, 1)}

    def add(below, n):
        for _ in range(n):
            parent = rng.choice([p for p, e in entries.items() if e[1] == "d" and p.startswith(below)])
            path = f"{parent}/{rng.randint(0, 30)}"
            if path not in entries:
                entries[path] = (path, "d", 0, rng.randint(1, 3)) if rng.random() < 0.4 else (path, "f", rng.randint(0, 99), rng.randint(1, 3))

    add("/r", 120)
    build_all(spark, root, list(entries.values()))
    for k in range(2):
        below = rng.choice([p for p, e in entries.items() if e[1] == "d" and p.count("/") < 3])
        for p in rng.sample([p for p in entries if p.startswith(below + "/")], 8) if sum(p.startswith(below + "/") for p in entries) > 8 else []:
            for q in [q for q in entries if q == p or q.startswith(p + "/")]:
                del entries[q]
        add(below, 20)
        scan = [e for p, e in entries.items() if p == below or p.startswith(below + "/")]
        apply_delta(spark, root, listing(spark, *scan), AS_OF)
    build_all(spark, str(tmp_path / "whole"), list(entries.values()))
    assert state(spark, root) == state(spark, str(tmp_path / "whole"))


def test_only_files_with_rows_concerned_are_written_anew(spark, tmp_path):
    root = str(tmp_path / "many")
    tables.create_tables(spark, root)
    for k in range(6):
        with tables.commit(spark, root) as changes:
            changes.append(spark.range(10 * k, 10 * k + 10).select(F.col("id").alias("uid"), F.lit("n").alias("username"), F.lit(k).alias("gid")).coalesce(1), "users")
    keys = spark.createDataFrame([(3,), (42,), (47,)], "uid bigint")
    with tables.commit(spark, root) as changes:
        assert changes.replace("users", keys, spark.createDataFrame([(3, "new", 1)], "uid bigint, username string, gid bigint")) == 2
    found = tables.read_table(spark, root, "users")
    assert found.count() == 58 and as_set(found.where("username = 'new'")) == {(3, "new", 1)}


@pytest.mark.parametrize("most", [0, 1])
def test_more_keys_than_are_broadcast_give_the_same(spark, tmp_path, root, monkeypatch, most):
    """With 1 the ids go as bits, with 0 rows are moved."""
    monkeypatch.setattr(joins, "MAX_BROADCAST_ROWS", most)
    monkeypatch.setattr(joins, "if_few", lambda df: None)
    scan = [
        ("/r", "d", 0, 1), ("/r/f", "f", 2, 1), ("/r/a", "d", 0, 9), ("/r/a/f", "f", 11, 1), ("/r/a/g", "f", 100, 2, "IoError"), ("/r/a/h", "f", 7, 5),
        ("/r/a/n", "d", 0, 6), ("/r/a/n/m", "d", 0, 6), ("/r/a/n/m/f", "f", 3, 6),  # x went, and b with y below it
    ]
    kept = [e for e in FIRST if e[0].startswith("/s")] + [("/r/a/g", "f", 100, 2)]
    check(spark, tmp_path, root, scan, kept + [e for e in scan if len(e) == 4])


def test_only_tops_with_something_below_are_looked_for_in_the_lists(spark, root, monkeypatch):
    """All pairs of directories and ancestors were moved to find what lies below directories that have nothing below."""
    looked = []
    taken = Keys.having
    monkeypatch.setattr(Keys, "having", lambda self, df: looked.append(df.columns) or taken(self, df))
    apply_delta(spark, root, listing(spark, ("/r/a", "d", 0, 1), ("/r/a/f", "f", 10, 1), ("/r/a/g", "f", 100, 2)), AS_OF)
    assert not [c for c in looked if "above" in c]
    assert as_set(tables.read_table(spark, root, "directories"), "path") == {("/r",), ("/r/a",), ("/r/b",), ("/r/b/y",), ("/s",)}
