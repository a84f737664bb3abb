"""Properties of the physical plans that matter at scale."""

import pytest
from pyspark.sql import functions as F

from dirgauge import session
from dirgauge.operators import audit, joins
from dirgauge.operators.joins import broadcast_if_small
from dirgauge.operators.intervals import subtree_sums
from dirgauge.plans import build, registry, reports
from dirgauge.sources.order_tree import AS_OF, DEEP_DIR_ID, DIR_ID, UID, OrderTree

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return OrderTree.of(spark, SF_DIR)


@pytest.fixture
def no_automatic_broadcast(spark):
    """Plan joins as for large inputs: what is still broadcast was marked so."""
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(registry.queries()))
def test_no_products_and_no_python_in_plans(spark, no_automatic_broadcast, name):
    plan = plan_of(registry.queries()[name](spark, SF_DIR))
    for operator in ("CartesianProduct", "NestedLoop", "EvalPython", "InPandas", "InArrow", "Scan ExistingRDD"):
        assert operator not in plan


@pytest.mark.parametrize(
    "report,pushed",
    [
        (lambda t: reports.user_tree(t, UID), "EqualTo(owner_uid,7)"),
        (lambda t: reports.user_dir_children(t, UID, DIR_ID), "EqualTo(owner_uid,7)"),
        (lambda t: reports.user_dir_children(t, UID, DIR_ID), f"EqualTo(parent_id,{DIR_ID})"),
        (lambda t: reports.dir_children(t, DIR_ID), f"EqualTo(parent_id,{DIR_ID})"),
        (lambda t: reports.filesystems(t), "IsNull(parent_id)"),
        (lambda t: reports.descendants(t, DIR_ID), "LessThanOrEqual(pre,"),
        (lambda t: reports.descendants({**t, "directory_intervals": t["directory_intervals"].limit(0)}, DIR_ID), f"EqualTo(ancestor_id,{DIR_ID})"),
        (lambda t: reports.breadcrumb(t, DIR_ID), f"EqualTo(dir_id,{DIR_ID})"),
        (lambda t: reports.user_breakdown(t, UID), "EqualTo(uid,7)"),
        (lambda t: reports.user_summary(t, UID), "EqualTo(uid,7)"),
        (lambda t: reports.staleness(t, AS_OF), "LessThanOrEqual(atime,2001-07-01T00:00)"),
        (lambda t: reports.staleness(t, AS_OF, UID), "EqualTo(owner_uid,7)"),
        (lambda t: reports.cumulative_size(t, DIR_ID), f"EqualTo(dir_id,{DIR_ID})"),
        (lambda t: reports.user_tree(t, UID), "In(dir_id, ["),
        (lambda t: reports.breadcrumb(t, DEEP_DIR_ID), "In(dir_id, ["),
        (lambda t: reports.top_dirs(t), "In(dir_id, ["),
        (lambda t: reports.filesystems(t), "In(dir_id, ["),
        (lambda t: reports.dir_children(t, DIR_ID), "In(dir_id, ["),
        (lambda t: reports.grand_totals(t), "In(dir_id, ["),
    ],
)
def test_filters_reach_the_scan(t, report, pushed):
    # The scan's pushed filters may be cut short in the plan text; the data filters are too.
    found = report(t)._jdf.queryExecution().explainString(
        t.spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert pushed in found


@pytest.mark.parametrize(
    "report,shuffles",
    [
        # Selected by index-like filters; the large tables are not shuffled for them.
        (lambda t: reports.cumulative_size(t, DIR_ID), 0),
        (lambda t: reports.descendants(t, DIR_ID), 0),
        (lambda t: reports.user_tree(t, UID), 0),
        (lambda t: reports.top_dirs(t), 0),
        (lambda t: reports.breadcrumb(t, DIR_ID), 0),
        (lambda t: reports.staleness(t, AS_OF), 1),
    ],
)
def test_shuffles(t, no_automatic_broadcast, report, shuffles):
    assert plan_of(report(t)).count("hashpartitioning") == shuffles


def test_statistics_of_few_directories_are_not_shuffled_whole(t, no_automatic_broadcast):
    few = plan_of(reports.dir_children(t, DIR_ID))
    assert "hashpartitioning" not in few and "BroadcastHashJoin" in few


def test_statistics_of_more_directories_are_not_shuffled_whole(t, no_automatic_broadcast, monkeypatch):
    monkeypatch.setattr(reports, "if_few", lambda df: None)
    plan = plan_of(reports.dir_children(t, DIR_ID))
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan


def test_ages_of_one_user_read_that_users_row_groups(spark, tmp_path, plain_plans):
    path, n = str(tmp_path / "access"), 300_000
    times = F.timestamp_micros(F.lit(1_600_000_000_000_000) + F.col("id") * 1_000_003)
    files = spark.range(n).select((F.col("id") % 50).alias("owner_uid"), times.alias("atime"), F.lit(2).alias("size_bytes"))
    build.access_layout(files).write.option("parquet.block.size", 64 * 1024).parquet(path)
    report = reports.staleness({"access_usage": spark.read.parquet(path)}, AS_OF.replace("2001", "2031"), UID)
    assert report.agg(F.sum("file_count"), F.sum("total_bytes")).first() == (n // 50, n // 25)
    report.collect()
    leaves = report._jdf.queryExecution().executedPlan().collectLeaves()
    assert leaves.length() == 1 and n // 50 <= leaves.apply(0).metrics().apply("numOutputRows").value() < n // 5


@pytest.fixture
def plain_plans(spark):
    """Plans that are not changed while they run, so that their scans can be asked for metrics."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_point_lookups_skip_row_groups(spark, tmp_path, plain_plans):
    """Small row groups of shuffled ids: Bloom filters, not statistics, rule most of them out."""
    path, n, step = str(tmp_path / "directories"), 200_000, 40_000
    rows = spark.range(n).select(F.col("id").alias("dir_id"), F.concat(F.lit("/d"), "id").alias("path"))
    writer = rows.orderBy(F.xxhash64("dir_id")).coalesce(1).write.option("parquet.block.size", 64 * 1024)
    writer.option("parquet.bloom.filter.enabled#dir_id", "true").option("parquet.bloom.filter.adaptive.enabled", "true").parquet(path)
    found = reports._with_path(spark.read.parquet(path), spark.range(7, n, step).toDF("dir_id"))
    assert {tuple(r) for r in found.collect()} == {(i, f"/d{i}") for i in range(7, n, step)}
    leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
    scans = [leaves.apply(i) for i in range(leaves.length())]
    read = [s.metrics().apply("numOutputRows").value() for s in scans if "parquet" in s.nodeName()]
    assert len(read) == 1 and 0 < read[0] < 0.9 * n, read


def test_subtrees_are_ranges_without_pairs(t):
    for df in (subtree_sums(t["directory_intervals"]), reports.descendants(t, DIR_ID)):
        plan = plan_of(df)
        assert "Generate" not in plan and "Exchange" not in plan and "Join" not in plan


def test_closure_is_written_without_a_shuffle(t):
    from dirgauge.plans.build import closure_layout

    assert "Exchange" not in plan_of(closure_layout(t["directory_lineage"]))


def test_closure_pairs_are_not_shuffled_by_the_audit(t, no_automatic_broadcast):
    plan = plan_of(audit.pair_sums(t["directory_closure"]))
    assert plan.count("Exchange") == 1 and plan.index("Exchange") < plan.index("partial_bit_xor")  # summed first
    plan = plan_of(audit.repeated_pairs(t["directory_closure"], t["directory_lineage"]))
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan  # few are left to be grouped


def test_broadcast_only_below_the_limit(spark, no_automatic_broadcast):
    big = spark.range(1000)
    few = spark.range(50).select("id")
    assert "BroadcastHashJoin" in plan_of(big.join(broadcast_if_small(few, 50), "id"))
    assert "BroadcastHashJoin" not in plan_of(big.join(broadcast_if_small(few, 49), "id"))


def test_the_path_index_is_not_shuffled_to_find_parents(t, no_automatic_broadcast, monkeypatch):
    index = t["directories"].select("path", "dir_id")
    keys = index.where("dir_id % 7 = 0").select("path")
    assert "hashpartitioning(path" not in plan_of(joins.rows_having(index, "path", keys)).split("BroadcastExchange")[0]
    few = plan_of(joins.rows_having(index, "path", keys.limit(3)))
    assert "Join" not in few and "Exchange" not in few
    monkeypatch.setattr(joins, "if_few", lambda df: None)
    assert "BroadcastHashJoin" in plan_of(joins.rows_having(index, "path", keys))


@pytest.mark.parametrize("most", [0, 50, 10_000])
def test_keys_in_each_form_choose_the_same_rows(spark, most):
    ids = [None, *range(-700, 700, 3), 2**62]
    df = spark.createDataFrame([(i, j) for i in [None, *range(-1100, 1100), 2**62, 2**62 + 1] for j in (1, 2)], "id bigint, j bigint")
    given = set(ids) - {None}
    one = joins.Keys(spark.createDataFrame([(i,) for i in ids], "id bigint"), most)
    two = joins.Keys(spark.createDataFrame([(i, 1) for i in ids], "id bigint, j bigint"), most)
    assert (one.is_small, one.blocks is not None) == (most == 10_000, most == 50)
    rows = [tuple(r) for r in df.collect()]
    same = lambda found, wanted: sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))
    assert same(one.having(df), [r for r in rows if r[0] in given]) and same(one.without(df), [r for r in rows if r[0] not in given])
    assert same(two.having(df), [r for r in rows if r[0] in given and r[1] == 1])
    assert same(two.without(df), [r for r in rows if r[0] not in given or r[1] == 2])
    assert same(one.flagged(df, "f"), [(*r, r[0] in given) for r in rows]) and same(two.flagged(df, "f"), [(*r, r[0] in given and r[1] == 1) for r in rows])


def test_rows_are_not_moved_to_find_many_close_ids(spark, no_automatic_broadcast):
    stored = spark.range(0, 1_000_000, 2).select("id", F.lit("x").alias("name"))
    keys = spark.range(0, 1_000_000, 3)  # more than are broadcast one by one
    plan = plan_of(joins.rows_having(stored, "id", keys))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert joins.rows_having(stored, "id", keys).count() == 166_667


def test_scans_read_only_the_columns_needed(t):
    plan = plan_of(reports.staleness(t, AS_OF))
    assert "inode" not in plan and "file_id" not in plan and "owner_uid" not in plan  # `files` is not read
    users = plan_of(reports.users(t).select(F.col("uid")))
    assert "last_mtime" not in users and "ancestors" not in users


def test_parts_of_a_listing_are_written_without_a_sort(spark, t):
    """Whole rows were sorted by the column that the folders are named by: a task held its share of the listing."""
    parts = t["listing"].select("path", "size_bytes", "entry_type")
    parts.limit(0).write.partitionBy("entry_type").saveAsTable("parts_unsorted")
    parts.createOrReplaceTempView("listed_parts")
    plan = spark.sql("EXPLAIN INSERT INTO parts_unsorted SELECT * FROM listed_parts").first()[0]
    assert "InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan


def test_task_sizes_are_lowered_and_smaller_ones_stay(spark):
    kept = {setting: spark.conf.get(setting) for setting in session.TASK_BYTES}
    try:
        for given, want in (("1g", None), ("128MB", None), ("2m", "2m")):
            for setting, most in session.TASK_BYTES.items():
                spark.conf.set(setting, given)
            session.configure(spark)
            for setting, most in session.TASK_BYTES.items():
                assert spark.conf.get(setting) == (want or str(most))
    finally:
        for setting, value in kept.items():
            spark.conf.set(setting, value)
