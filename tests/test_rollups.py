import random

import pytest
from helpers import AS_OF, as_set, dirs, files, inventory, rows, users
from pyspark.sql import functions as F

from dirgauge.operators import rollups
from dirgauge.operators.audit import audit, duplicate_keys, repeated_pairs
from dirgauge.operators.tree import build_lineage


def two_roots(spark):
    d = dirs(
        spark,
        (1, "/a", None), (2, "/a/x", 1), (3, "/a/x/y", 2), (4, "/a/empty", 1),
        (5, "/b", None, 9), (6, "/b/z", 5),
    )
    f = files(
        spark,
        (1, 1, 10, 7), (2, 2, 20, 7), (3, 3, 30, 8), (4, 3, 40, 7), (5, 6, 50, 7),
    )
    return inventory(spark, d, f)


def test_directory_stats(spark):
    t = two_roots(spark)
    got = as_set(t["directory_stats"], "dir_id", "direct_bytes", "subtree_bytes", "file_count", "subtree_count")
    assert got == {
        (1, 10, 100, 1, 4), (2, 20, 90, 1, 3), (3, 70, 70, 2, 2), (4, 0, 0, 0, 0),
        (5, 0, 50, 0, 1), (6, 50, 50, 1, 1),
    }
    assert rows(t["directory_stats"].select(F.min("last_computed").cast("string")))[0][0] == AS_OF


def test_subtree_and_direct_agree_with_directory_stats(spark):
    t = two_roots(spark)
    sub = rollups.subtree_stats(t["directory_lineage"], t["directory_usage"])
    assert as_set(sub) == {(1, 100, 4), (2, 90, 3), (3, 70, 2), (5, 50, 1), (6, 50, 1)}
    direct = rollups.direct_stats(t["directory_usage"])
    assert as_set(direct) == {(1, 10, 1), (2, 20, 1), (3, 70, 2), (6, 50, 1)}


def test_user_stats_split_by_root(spark):
    t = two_roots(spark)
    got = as_set(t["user_stats"], "uid", "dir_id", "total_bytes", "file_count")
    assert got == {(7, 1, 70, 3), (8, 1, 30, 1), (7, 5, 50, 1)}


def test_users_own_files_or_directories(spark):
    t = two_roots(spark)
    assert as_set(t["users"], "uid") == {(1,), (7,), (8,), (9,)}


def test_empty_tree(spark):
    t = inventory(spark, dirs(spark, (1, "/a", None)), files(spark))
    assert as_set(t["directory_stats"].drop("last_computed")) == {(1, 0, 0, 0, 0)}
    assert t["user_stats"].count() == 0


def test_hard_links_count_every_name(spark):
    f = files(spark, (1, 1, 10, 7), (2, 1, 10, 7)).withColumn("inode", F.lit(5).cast("bigint"))
    t = inventory(spark, dirs(spark, (1, "/a", None)), f)
    assert rows(t["directory_stats"], "subtree_bytes", "subtree_count") == [(20, 2)]


def test_file_without_owner(spark):
    d = dirs(spark, (1, "/a", None, 3))
    t = inventory(spark, d, files(spark, (1, 1, 10, None), (2, 1, 5, 3)))
    assert as_set(t["users"], "uid") == {(3,)}
    assert rows(t["directory_stats"], "subtree_bytes") == [(15,)]
    assert as_set(audit(t)) == {("notnull:user_stats.uid", "", 1)}


def test_sum_overflow_raises(spark):
    f = files(spark, (1, 1, 2**63 - 1, 7), (2, 1, 1, 7))
    with pytest.raises(Exception, match="OVERFLOW"):
        rollups.build_usage(f).collect()


def test_invariants_on_random_tree(spark):
    rng = random.Random(11)
    parents = {1: None, 2: None}
    for node in range(3, 200):
        parents[node] = rng.randrange(1, node)
    d = dirs(spark, *[(n, f"/{n}", p) for n, p in parents.items()])
    raw = [(i, rng.randrange(1, 200), rng.randrange(0, 10**6), rng.randrange(5)) for i in range(1, 800)]
    t = inventory(spark, d, files(spark, *raw))
    stats = {r["dir_id"]: r for r in t["directory_stats"].collect()}
    assert set(stats) == set(parents)
    total = sum(size for _, _, size, _ in raw)
    assert stats[1]["subtree_bytes"] + stats[2]["subtree_bytes"] == total
    assert sum(r["total_bytes"] for r in t["user_stats"].collect()) == total
    for node, s in stats.items():
        below = [stats[c] for c, p in parents.items() if p == node]
        assert s["subtree_bytes"] == s["direct_bytes"] + sum(c["subtree_bytes"] for c in below)
        assert s["subtree_count"] == s["file_count"] + sum(c["subtree_count"] for c in below)
    depth = {}
    for node in parents:
        depth[node] = 0 if parents[node] is None else depth[parents[node]] + 1
    assert t["directory_closure"].count() == sum(n + 1 for n in depth.values())
    assert t["directory_closure"].where("depth = 0").count() == len(parents)


def test_audit_reports_every_kind(spark):
    d = dirs(spark, (1, "/a", None, 3), (2, "/a/b", 77, 4))
    f = files(spark, (1, 1, 10, 3), (1, 2, 5, 3), (2, 55, 5, 3))
    t = inventory(spark, d, f, users(spark, (3, None, None)))
    assert as_set(audit(t)) == {
        ("pk:files", "1", 2),
        ("fk:directories.owner_uid->users", "4", 1),
        ("fk:directories.parent_id->directories", "77", 1),
        ("fk:files.dir_id->directories", "55", 1),
    }


def test_audit_of_sound_tables_is_empty(spark):
    assert audit(two_roots(spark)).count() == 0


def test_repeated_closure_pairs_are_found_with_any_lineage(spark):
    closure = two_roots(spark)["directory_closure"].select("ancestor_id", "descendant_id", "depth")
    lineage = build_lineage(two_roots(spark)["directories"])
    pair = lambda *r: spark.createDataFrame([r], closure.schema)
    faults = {
        "sound": (closure, set()),
        "one twice": (closure.unionByName(pair(1, 3, 2)), {("1,3", 2)}),
        "one three times": (closure.unionByName(pair(1, 3, 2)).unionByName(pair(1, 3, 5)), {("1,3", 3)}),
        "one in place of another": (closure.where("NOT (ancestor_id = 2 AND descendant_id = 3)").unionByName(pair(1, 3, 2)), {("1,3", 2)}),
        "one missing": (closure.where("NOT (ancestor_id = 2 AND descendant_id = 3)"), set()),
        "unknown to the lineage": (closure.unionByName(pair(9, 9, 0)).unionByName(pair(9, 9, 0)), {("9,9", 2)}),
        "nulls": (closure.unionByName(pair(None, 3, 0)).unionByName(pair(None, 3, 0)).unionByName(pair(1, None, 0)), set()),
        "empty": (closure.limit(0), set()),
    }
    twice = F.when(F.col("dir_id") == 3, F.concat("ancestors", F.array(F.lit(1).cast("bigint")))).otherwise(F.col("ancestors"))
    for other in (lineage, lineage.limit(0), lineage.where("dir_id <> 3"), lineage.withColumn("ancestors", twice), lineage.unionByName(lineage)):
        for name, (pairs, expected) in faults.items():
            found = as_set(repeated_pairs(pairs, other), "key", "n")
            assert found == expected == as_set(duplicate_keys(pairs, "directory_closure"), "key", "n"), name


def test_files_below_a_missing_parent_have_no_root(spark):
    d = dirs(spark, (2, "/a/b", 77), (3, "/a/b/c", 2))
    t = inventory(spark, d, files(spark, (1, 3, 10, 7)))
    assert t["user_stats"].count() == 0
    assert as_set(t["directory_stats"], "dir_id", "subtree_bytes") == {(2, 10), (3, 10)}
    assert build_lineage(d).where("root_id IS NOT NULL").count() == 0
