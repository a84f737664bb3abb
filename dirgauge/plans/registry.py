"""One callable per operator and question, (spark, sf_dir) to DataFrame, over the derived inventory."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirgauge import functions as fx
from dirgauge.operators import rollups, tables
from dirgauge.operators.audit import audit
from dirgauge.operators.intervals import subtree_sums
from dirgauge.operators.tree import assign_ids, build_closure, max_id, resolve_tree
from dirgauge.plans import build, reports
from dirgauge.plans.delta import apply_delta
from dirgauge.schemas import LISTING
from dirgauge.session import as_of_literal, materialise, scratch_path
from dirgauge.sources import listing as listings
from dirgauge.sources.accounts import load_accounts
from dirgauge.sources.order_tree import (
    AS_OF,
    CUSTOMER_BASE,
    DEEP_DIR_ID,
    DIR_ID,
    NATION_BASE,
    NTZ,
    ORDER_BASE,
    REGION_BASE,
    UID,
    OrderTree,
)
from dirgauge.streaming import finish_ingest, read_stream, stage_listing, stream_totals

Query = Callable[[SparkSession, str], DataFrame]


def _wall_clock(df: DataFrame) -> DataFrame:
    """Zoned timestamps (stored tables) as UTC wall-clock ones, the type of the order tables."""
    return df.select(
        *[
            F.col(f.name).cast(NTZ).alias(f.name) if f.dataType.typeName() == "timestamp" else f.name
            for f in df.schema.fields
        ]
    )


def _listing_files(t: OrderTree) -> str:
    """The listing as stored by a scanner: zoned timestamps, Parquet files in the shared folder."""
    if not hasattr(t, "_listing_path"):
        path = scratch_path(t.spark, "raw-listing")
        raw = t.derived("listing")
        raw.select(
            *[F.col(c).cast("timestamp") if c.endswith("time") else F.col(c) for c in raw.columns]
        ).write.option("compression", "zstd").parquet(path)
        t._listing_path = path
    return t._listing_path


def _new_root(t: OrderTree) -> str:
    root = scratch_path(t.spark, "inventory")
    tables.create_tables(t.spark, root)
    return root


# Sources and ingest


def inventory_load(t: OrderTree) -> DataFrame:
    return _wall_clock(listings.load_listing(t.spark, _listing_files(t)))


def entry_classify(t: OrderTree) -> DataFrame:
    entries, _ = listings.split_errors(t["listing"])
    dirs, files = listings.classify(entries)
    return dirs.select("path", F.lit("directory").alias("kind")).unionByName(
        files.select("path", F.lit("file").alias("kind"))
    )


def tree_resolve(t: OrderTree) -> DataFrame:
    entries, _ = listings.split_errors(t["listing"])
    directories, files = resolve_tree(*listings.classify(entries))
    directories = materialise(directories, "resolved-dirs")
    parents = directories.select(F.col("dir_id").alias("_id"), F.col("path").alias("parent_path"))
    return (
        directories.join(parents, F.col("parent_id") == F.col("_id"), "left")
        .select(F.lit("directory").alias("kind"), "path", "parent_path")
        .unionByName(
            files.join(parents, F.col("dir_id") == F.col("_id"), "left").select(
                F.lit("file").alias("kind"), "path", "parent_path"
            )
        )
    )


def id_seed(t: OrderTree) -> DataFrame:
    seen = max_id(t["directories"], "dir_id")
    numbered = assign_ids(t["directories"].select("path"), "new_id", seen)
    return numbered.agg(
        F.lit(seen).cast("bigint").alias("max_seen"),
        F.min("new_id").alias("min_id"),
        F.max("new_id").alias("max_id"),
        F.count("new_id").alias("ids"),
        F.countDistinct("new_id").alias("distinct_ids"),
    )


def multi_root(t: OrderTree) -> DataFrame:
    """One stored listing per region, loaded together under the region's name."""
    stored = scratch_path(t.spark, "roots")
    top = F.split("path", "/")[1]
    t.spark.read.parquet(_listing_files(t)).withColumn("root", top).write.partitionBy("root").parquet(stored)
    names = [row["r_name"] for row in t.raw("region").select("r_name").collect()]
    roots = [(name, f"{stored}/root={name}") for name in names]
    return listings.load_roots(t.spark, roots).select("filesystem", "path", "entry_type", "size_bytes")


def delta_by_directory(t: OrderTree) -> DataFrame:
    """Entries not older than their own directory."""
    seen = t["directories"].select("path", F.col("mtime").alias("last_seen_mtime"))
    return listings.delta_by_directory(t["listing"], seen).select("path", "mtime")


def device_pack(t: OrderTree) -> DataFrame:
    return (
        t.raw("lineitem")
        .groupBy(F.col("l_suppkey").alias("major"), F.col("l_partkey").alias("minor"))
        .agg(F.count("*").alias("n"))
        .withColumn("device", fx.device_id(F.col("major"), F.col("minor")))
    )


def epoch_ts(t: OrderTree) -> DataFrame:
    """Ship dates as stat times; first and second items of an order run out of range."""
    item = t.raw("lineitem").select(
        F.when(F.col("l_linenumber") == 1, F.col("l_orderkey") * 10_000_000_000)
        .when(F.col("l_linenumber") == 2, F.col("l_orderkey") * -1_000_000_000)
        .otherwise(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) - F.col("l_orderkey"))
        .alias("sec"),
        ((F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729) % 1_000_000_000).alias("nsec"),
    )
    moment = fx.stat_time(F.col("sec"), F.col("nsec"))
    return item.select("sec", "nsec", F.unix_micros(moment).alias("micros"))


def _account_files(t: OrderTree) -> str:
    """Account lines: suppliers and customers, with lines that must be skipped."""
    if not hasattr(t, "_account_path"):
        path = scratch_path(t.spark, "accounts")
        name, supp, cust = F.col("s_name"), F.col("s_suppkey"), F.col("c_custkey")
        lines = [
            t.raw("supplier").select(
                F.concat_ws(":", F.upper(name), F.lit("x"), supp, F.col("s_nationkey") + 100, F.lit("c"))
            ),
            t.raw("customer").select(F.concat_ws(":", "c_name", F.lit("x"), cust + 2_000_000, "c_nationkey")),
            t.raw("part").select(F.concat_ws(":", "p_name", F.lit("x"), "p_partkey")),
            t.raw("nation").select(F.concat_ws(":", "n_name", F.lit("x"), "n_name", "n_nationkey")),
            t.raw("orders").select(
                F.concat_ws(":", "o_orderstatus", F.lit("x"), F.col("o_orderkey") + 4_294_967_296, F.lit(0))
            ),
        ]
        text = lines[0].toDF("value")
        for more in lines[1:]:
            text = text.unionByName(more.toDF("value"))
        text.write.text(path)
        t._account_path = path
    return t._account_path


def account_source(t: OrderTree) -> DataFrame:
    return load_accounts(t.spark, _account_files(t)).drop("line_order")


# Sinks and maintenance


def append_inventory(t: OrderTree) -> DataFrame:
    root = _new_root(t)
    build.ingest(t.spark, root, listings.load_listing(t.spark, _listing_files(t)), AS_OF)
    stored = tables.open_tables(t.spark, root)
    paths = stored["directories"].select("dir_id", "path")
    return _wall_clock(stored["files"].join(paths, "dir_id").drop("file_id", "dir_id"))


def _by_directory(stored: dict[str, DataFrame]) -> DataFrame:
    paths = stored["directories"].select("dir_id", "path")
    return stored["files"].join(paths, "dir_id").select("path", "filename", "size_bytes", "owner_uid")


def ingest_retry(t: OrderTree) -> DataFrame:
    """A run that is broken before its last step, then made, then made again."""
    root, listing = _new_root(t), listings.load_listing(t.spark, _listing_files(t))
    try:
        with tables.commit(t.spark, root, "scan") as changes:
            build.take_in(changes, listing, AS_OF, (), "scan")
            raise InterruptedError
    except InterruptedError:
        pass
    for _ in range(2):
        build.ingest(t.spark, root, listing, AS_OF, run="scan")
    return _by_directory(tables.open_tables(t.spark, root))


def _entries(df: DataFrame, **values) -> DataFrame:
    """Listing rows with these columns; the others are NULL."""
    return df.select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in LISTING.fields])


def ingest_balance(t: OrderTree) -> DataFrame:
    """Entries by what became of them, of a listing with every fault: entries listed twice, types that are
    not known, no path, no size, no directory."""
    root, listing = _new_root(t), listings.load_listing(t.spark, _listing_files(t))
    one = F.lit(1)
    region = t["directories"].where("parent_id IS NULL")
    customer = t["directories"].where(f"dir_id BETWEEN {CUSTOMER_BASE} AND {ORDER_BASE - 1}")
    faults = [
        listing.where("entry_type = 'f' AND inode % 50 = 0"),
        _entries(region, path=F.concat("path", F.lit("//")), entry_type=F.lit("d")),
        _entries(region, path=F.concat("path", F.lit("/.")), entry_type=F.lit("d")),
        _entries(
            t.raw("part").where("p_partkey % 10 = 0"),
            path=F.concat(F.lit("/ASIA/odd-"), "p_partkey"),
            entry_type=F.when(F.col("p_partkey") % 20 == 0, "file"),
            size_bytes=one,
        ),
        _entries(t.raw("supplier"), entry_type=F.lit("f"), size_bytes=one),
        _entries(customer, path=F.concat("path", F.lit("/sizeless")), entry_type=F.lit("f")),
        _entries(t.raw("nation"), path=F.concat(F.lit("/lost/"), "n_name"), entry_type=F.lit("f"), size_bytes=one),
    ]
    for more in faults:
        listing = listing.unionByName(more)
    build.ingest(t.spark, root, listing, AS_OF)
    stored = tables.open_tables(t.spark, root)
    counts = [F.struct(F.lit(c).alias("outcome"), F.col(c).alias("n")) for c in ("listed", "directories", "files", "failed", "skipped")]
    outcomes = stored["ingest_ledger"].select(F.explode(F.array(*counts)).alias("o")).select("o.*")
    return outcomes.unionByName(listings.error_counts(stored["ingest_errors"]).withColumnRenamed("error_kind", "outcome"))


def late_file_of_filesystem(t: OrderTree) -> DataFrame:
    """Two filesystems with the same paths; files that come later go to the tree of their own."""
    root, nations = _new_root(t), t["directories"].where(f"dir_id < {CUSTOMER_BASE}")
    dirs = _entries(nations, path=F.col("path"), entry_type=F.lit("d"), uid=F.lit(1))
    both = [dirs.withColumn("filesystem", F.lit(name)) for name in ("one", "two")]
    build.ingest(t.spark, root, both[0].unionByName(both[1]), AS_OF)
    late = nations.where(f"dir_id >= {NATION_BASE}").withColumn("n", F.col("dir_id") - NATION_BASE)
    late = _entries(late, path=F.concat("path", F.lit("/late")), entry_type=F.lit("f"), size_bytes=F.col("n"), uid=F.lit(2))
    build.ingest(t.spark, root, late.withColumn("filesystem", F.lit("one")), AS_OF)
    build.ingest(t.spark, root, late.where("size_bytes % 2 = 0").withColumn("filesystem", F.lit("two")), AS_OF)
    stored = tables.open_tables(t.spark, root)
    found = stored["directory_paths"].join(stored["files"].select("dir_id", "size_bytes"), "dir_id", "left")
    return found.groupBy("filesystem", "path").agg(F.count("size_bytes").alias("files"), F.sum("size_bytes").alias("bytes"))


def _rescan(t: OrderTree) -> DataFrame:
    """Every third customer scanned again: every fifth order is gone, in the others every fourth file, another
    fourth has grown and changed its owner; a directory with a file is new."""
    dirs = t["directories"]
    customer = dirs.where(f"dir_id BETWEEN {CUSTOMER_BASE} AND {ORDER_BASE - 1} AND (dir_id - {CUSTOMER_BASE}) % 3 = 0")
    order = dirs.where(f"dir_id >= {ORDER_BASE} AND (parent_id - {CUSTOMER_BASE}) % 3 = 0 AND (dir_id - {ORDER_BASE}) % 5 <> 0")
    file = t["files"].join(order.select("dir_id", "path"), "dir_id").withColumn("k", F.col("file_id") % 1000 % 4).where("k <> 0")
    grown, moment = F.col("k") == 1, {c: F.col(c) for c in ("atime", "mtime", "ctime")}
    new = F.concat("path", F.lit("/new"))
    parts = [
        _entries(customer.unionByName(order), path=F.col("path"), entry_type=F.lit("d"), uid=F.col("owner_uid"), mtime=F.col("mtime")),
        _entries(
            file,
            path=F.concat_ws("/", "path", "filename"),
            entry_type=F.lit("f"),
            size_bytes=F.when(grown, F.col("size_bytes") * 2 + 1).otherwise(F.col("size_bytes")),
            uid=F.when(grown, F.lit(999)).otherwise(F.col("owner_uid")),
            inode=F.col("inode"),
            nlink=F.col("hardlink_count"),
            **moment,
        ),
        _entries(customer, path=new, entry_type=F.lit("d"), uid=F.lit(1_000_003)),
        _entries(
            customer, path=F.concat(new, F.lit("/n")), entry_type=F.lit("f"), size_bytes=F.col("dir_id") - CUSTOMER_BASE, uid=F.lit(1_000_003)
        ),
    ]
    return reduce(DataFrame.unionByName, parts)


def _after_delta(t: OrderTree) -> dict[str, DataFrame]:
    """The finished inventory after the scan of part of it."""
    if not hasattr(t, "_delta_root"):
        root = _new_root(t)
        with tables.commit(t.spark, root) as changes:
            for name in ("directories", "files"):
                changes.append(t[name], name)
            changes.append(tables.paths_of(t["directories"]), "directory_paths")
        build.finish(t.spark, root, AS_OF)
        apply_delta(t.spark, root, materialise(_rescan(t), "rescan"), AS_OF, run="rescan")
        t._delta_root = root
    return tables.open_tables(t.spark, t._delta_root)


def delta_apply(t: OrderTree) -> DataFrame:
    stored = _after_delta(t)
    paths = stored["directories"].select("dir_id", "path")
    return stored["directory_stats"].join(paths, "dir_id").drop("dir_id", "last_computed")


def delta_users(t: OrderTree) -> DataFrame:
    stored = _after_delta(t)
    return stored["user_stats"].join(stored["directories"].select("dir_id", "path"), "dir_id").drop("dir_id")


def _file_entries(t: OrderTree) -> DataFrame:
    entries, _ = listings.split_errors(t["listing"])
    return listings.classify(entries)[1].withColumnRenamed("uid", "owner_uid")


def scan_totals(t: OrderTree) -> DataFrame:
    entries, errors = listings.split_errors(t["listing"])
    return reports.scan_totals(listings.classify(entries)[1], errors)


def _text_report(order: str, unit: str) -> Callable[[OrderTree], DataFrame]:
    return lambda t: reports.text_report(
        _file_entries(t), listings.split_errors(t["listing"])[1], order, unit
    )


def sorted_listing_places(t: OrderTree) -> DataFrame:
    """Each directory's place in the listing by name, bytes, files and time of change."""
    listed = t["directory_stats"].join(t["directories"].select("dir_id", "path", "mtime"), "dir_id")
    places = None
    for column, ascending in (("path", True), ("subtree_bytes", False), ("subtree_count", True), ("mtime", False)):
        ordered = reports.sorted_listing(listed, column, ascending, "path").select("path")
        placed = assign_ids(ordered, "place", 0).select(F.lit(column).alias("by"), "place", "path")
        places = placed if places is None else places.unionByName(placed)
    return places


def run_log(t: OrderTree) -> DataFrame:
    root = _new_root(t)
    tables.append_table(t["crawl_runs"], root, "crawl_runs")
    tables.log_run(t.spark, root, AS_OF)
    return _wall_clock(tables.read_table(t.spark, root, "crawl_runs"))


def insert_absent(t: OrderTree) -> DataFrame:
    """All suppliers as known users; owners not among them are added without a name."""
    known = t.raw("supplier").select(
        F.col("s_suppkey").alias("uid"),
        F.col("s_name").alias("username"),
        F.col("s_nationkey").cast("bigint").alias("gid"),
    )
    owners = rollups.build_users(t["files"], t["directories"])
    return tables.insert_absent(known, owners, ["uid"])


def upsert(t: OrderTree) -> DataFrame:
    """Zero totals for each supplier and customer in its own region, then the real ones: suppliers'
    rows are replaced or added, customers' are kept."""
    place = t.raw("nation").select(
        F.col("n_nationkey").alias("nation"), (F.lit(REGION_BASE) + F.col("n_regionkey")).alias("dir_id")
    )
    owners = t.raw("supplier").select(F.col("s_suppkey").alias("uid"), F.col("s_nationkey").alias("nation"))
    others = t.raw("customer").select(
        (F.col("c_custkey") + 2_000_000).alias("uid"), F.col("c_nationkey").alias("nation")
    )
    none = F.lit(0).cast("bigint")
    stored = (
        owners.unionByName(others)
        .join(place, "nation")
        .select("uid", "dir_id", none.alias("total_bytes"), none.alias("file_count"))
    )
    return tables.upsert(stored, t["user_stats"], ["uid", "dir_id"])


def enrich_users(t: OrderTree) -> DataFrame:
    return tables.enrich_users(t["users"], load_accounts(t.spark, _account_files(t)))


# Builds


def integrity_audit(t: OrderTree) -> DataFrame:
    """An inventory with two faults: files keyed by order and line number, which repeat, and users
    taken from the files only, so that owners of directories are missing."""
    item = t.raw("lineitem")
    by_line = item.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("file_id"),
        (F.lit(ORDER_BASE) + F.col("l_orderkey")).alias("dir_id"),
        F.lit("item").alias("filename"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size_bytes"),
        F.col("l_suppkey").alias("owner_uid"),
        as_of_literal(AS_OF, NTZ).alias("last_seen"),
    )
    owners = by_line.select(F.col("owner_uid").alias("uid")).distinct()
    given = {name: t[name] for name in [*tables.TABLES, "directory_lineage"]}
    return audit({**given, "files": by_line, "users": owners})


def create_clear(t: OrderTree) -> DataFrame:
    """Rows per table after loading it and after clearing all."""
    root = _new_root(t)
    before = after = None
    for name in ("directories", "files", "users", "crawl_runs"):
        tables.append_table(t[name], root, name)
        counted = tables.read_table(t.spark, root, name).agg(F.count("*").alias("before"))
        counted = counted.select(F.lit(name).alias("table"), "before")
        before = counted if before is None else before.unionByName(counted)
    before = materialise(before, "before")
    tables.clear_tables(t.spark, root)
    for name in ("directories", "files", "users", "crawl_runs"):
        counted = tables.read_table(t.spark, root, name).agg(F.count("*").alias("after"))
        counted = counted.select(F.lit(name).alias("table"), "after")
        after = counted if after is None else after.unionByName(counted)
    return before.join(after, "table")


def full_build(t: OrderTree) -> DataFrame:
    """Load the base tables, build the rest, and sum up what was stored."""
    root = _new_root(t)
    for name in ("directories", "files"):
        tables.append_table(t[name], root, name)
    build.finish(t.spark, root, AS_OF)
    totals = {
        "directory_closure": F.sum("depth"),
        "directory_stats": F.sum(F.col("direct_bytes") + F.col("subtree_bytes")),
        "user_stats": F.sum("total_bytes"),
        "users": F.sum("uid"),
        "crawl_runs": F.sum("id"),
    }
    report = None
    for name, total in totals.items():
        row = tables.read_table(t.spark, root, name).agg(
            F.lit(name).alias("table"), F.count("*").alias("n"), total.alias("total")
        )
        report = row if report is None else report.unionByName(row)
    return report


# Scalar functions


def base_name(t: OrderTree) -> DataFrame:
    path, slashed = F.col("path"), F.concat("path", F.lit("/"))
    return t["directories"].select(
        "path",
        fx.last_segment(path).alias("segment"),
        fx.base_name(path).alias("name"),
        fx.last_segment(slashed).alias("slash_segment"),
        fx.base_name(slashed).alias("slash_name"),
    )


def fmt_mtime(t: OrderTree) -> DataFrame:
    """Access times moved to varied minutes of the day."""
    minutes = (F.col("file_id") % 1440).cast("int")
    moved = F.col("atime") + F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return t["files"].select("file_id", fx.fmt_mtime(moved).alias("label"))


def fmt_bytes(t: OrderTree) -> DataFrame:
    size = F.col("subtree_bytes")
    return t["directory_stats"].select("dir_id", size.alias("size"), fx.fmt_bytes(size).alias("label"))


def fmt_bytes_tb(t: OrderTree) -> DataFrame:
    size = F.col("subtree_bytes") * 64
    return t["directory_stats"].select("dir_id", size.alias("size"), fx.fmt_bytes_tb(size).alias("label"))


# Streaming


def stream_ingest(t: OrderTree) -> DataFrame:
    root = _new_root(t)
    staging, checkpoint = scratch_path(t.spark, "staging"), scratch_path(t.spark, "offsets")
    stream = read_stream(t.spark, _listing_files(t), files_per_trigger=2)
    stage_listing(stream, staging, checkpoint).awaitTermination()
    finish_ingest(t.spark, staging, root, AS_OF)
    return _by_directory(tables.open_tables(t.spark, root))


def stream_late(t: OrderTree) -> DataFrame:
    """Half of the files arrive after the first half was taken in; the last call finds nothing new."""
    root, staging, checkpoint = _new_root(t), scratch_path(t.spark, "staging"), scratch_path(t.spark, "offsets")
    arrived, listing = scratch_path(t.spark, "arrived"), listings.load_listing(t.spark, _listing_files(t))
    late = "entry_type = 'f' AND inode % 2 = 1"
    for part in (listing.where(f"NOT coalesce({late}, false)"), listing.where(late)):
        part.write.mode("append").parquet(arrived)
        stage_listing(read_stream(t.spark, arrived, files_per_trigger=4), staging, checkpoint).awaitTermination()
        finish_ingest(t.spark, staging, root, AS_OF)
    finish_ingest(t.spark, staging, root, AS_OF)
    return _by_directory(tables.open_tables(t.spark, root))


def stream_totals_query(t: OrderTree) -> DataFrame:
    """Totals after each micro-batch; the last stored ones are returned."""
    stored, checkpoint = scratch_path(t.spark, "totals"), scratch_path(t.spark, "offsets")

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{stored}/batch_id={batch_id}")

    query = (
        stream_totals(read_stream(t.spark, _listing_files(t), files_per_trigger=2))
        .writeStream.outputMode("complete")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    totals = t.spark.read.parquet(stored)
    last = totals.agg(F.max("batch_id")).scalar()
    return totals.where(F.col("batch_id") == last).select("files", "bytes", "errors")


def _queries() -> dict[str, Callable[[OrderTree], DataFrame]]:
    return {
        "inventory_load": inventory_load,
        "entry_classify": entry_classify,
        "tree_resolve": tree_resolve,
        "id_seed": id_seed,
        "error_split": lambda t: listings.split_errors(t["listing"])[1],
        "error_counts": lambda t: listings.error_counts(listings.split_errors(t["listing"])[1]),
        "multi_root": multi_root,
        "delta_filter": lambda t: listings.delta(t["listing"], reports.EARLIEST_ATIME).select(
            "path", "entry_type", "mtime"
        ),
        "delta_by_directory": delta_by_directory,
        "device_pack": device_pack,
        "epoch_ts": epoch_ts,
        "account_source": account_source,
        "table_counts": reports.table_counts,
        "append_inventory": append_inventory,
        "ingest_retry": ingest_retry,
        "ingest_balance": ingest_balance,
        "late_file_of_filesystem": late_file_of_filesystem,
        "delta_apply": delta_apply,
        "delta_users": delta_users,
        "report_table": lambda t: reports.file_report(_file_entries(t)),
        "report_text": _text_report("path", "KB"),
        "report_text_by_size": _text_report("size", "MB"),
        "report_text_by_owner": _text_report("owner", "B"),
        "file_lines": lambda t: reports.file_lines(_file_entries(t)),
        "scan_totals": scan_totals,
        "create_clear": create_clear,
        "run_log": run_log,
        "insert_absent": insert_absent,
        "upsert": upsert,
        "enrich_users": enrich_users,
        "users_build": lambda t: rollups.build_users(t["files"], t["directories"]),
        "closure_build": lambda t: build_closure(t["directories"]),
        "direct_stats": lambda t: rollups.direct_stats(rollups.build_usage(t["files"])),
        "subtree_stats": lambda t: subtree_sums(t["directory_intervals"]),
        "directory_stats": lambda t: rollups.directory_stats(
            rollups.with_direct_stats(t["ancestors"], rollups.build_usage(t["files"])),
            as_of_literal(AS_OF, NTZ),
        ),
        "user_stats": lambda t: rollups.user_stats(
            rollups.locate_usage(rollups.build_usage(t["files"]), t["ancestors"])
        ),
        "integrity_audit": integrity_audit,
        "full_build": full_build,
        "filesystems": reports.filesystems,
        "users": reports.users,
        "user_breakdown": lambda t: reports.user_breakdown(t, UID),
        "dir_children": lambda t: reports.dir_children(t, DIR_ID),
        "user_dir_children": lambda t: reports.user_dir_children(t, UID, DIR_ID),
        "user_dir_labels": lambda t: reports.labelled(
            reports.user_dir_children(t, UID, DIR_ID), "user_bytes", "path", "last_mtime"
        ).select("dir_id", "name", "size", "modified", "user_files"),
        "user_tree": lambda t: reports.user_tree(t, UID),
        "last_crawled": reports.last_crawled,
        "staleness": lambda t: reports.staleness(t, AS_OF),
        "staleness_chart": lambda t: reports.chart(reports.staleness(t, AS_OF)),
        "user_staleness": lambda t: reports.staleness(t, AS_OF, UID),
        "user_summary": lambda t: reports.user_summary(t, UID),
        "cumulative_size": lambda t: reports.cumulative_size(t, DIR_ID),
        "descendants": lambda t: reports.descendants(t, DIR_ID),
        "usage_by_username": reports.usage_by_username,
        "top_dirs": reports.top_dirs,
        "grand_totals": reports.grand_totals,
        "size_share": lambda t: reports.size_share(
            reports.users(t).select("uid", "total_bytes"), "total_bytes"
        ),
        "sorted_listing": lambda t: reports.sorted_listing(
            t["directory_stats"]
            .join(t["directories"].select("dir_id", "path"), "dir_id")
            .select("path", "subtree_bytes", "subtree_count"),
            "path",
            True,
            "path",
        ),
        "sorted_listing_places": sorted_listing_places,
        "breadcrumb": lambda t: reports.breadcrumb(t, DEEP_DIR_ID),
        "fmt_bytes": fmt_bytes,
        "fmt_bytes_tb": fmt_bytes_tb,
        "fmt_mtime": fmt_mtime,
        "base_name": base_name,
        "stream_ingest": stream_ingest,
        "stream_late": stream_late,
        "stream_totals": stream_totals_query,
    }


def queries() -> dict[str, Query]:
    def bound(run: Callable[[OrderTree], DataFrame]) -> Query:
        return lambda spark, sf_dir: run(OrderTree.of(spark, sf_dir))

    return {name: bound(run) for name, run in _queries().items()}
