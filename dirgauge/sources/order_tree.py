"""An inventory derived from order tables: the data the registered queries run on.

Regions, nations, customers and orders become four levels of directories, line items become files,
suppliers their owners.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.operators import rollups, tables
from dirgauge.operators.tables import write_parquet
from dirgauge.operators.tree import build_lineage
from dirgauge.plans import build
from dirgauge.schemas import LISTING
from dirgauge.session import as_of_literal, configure, scratch_path

AS_OF = "2001-06-30 00:00:00"
OLD = "1995-01-01 00:00:00"
UID = 7
DIR_ID = 1_000_000_002
DEEP_DIR_ID = 2_000_000_002
NTZ = T.TimestampNTZType()

# Ids of the four levels start here.
REGION_BASE, NATION_BASE, CUSTOMER_BASE, ORDER_BASE = (n * 1_000_000_000 for n in (1, 2, 3, 4))


def _utc(text: str):
    return as_of_literal(text, NTZ)


class OrderTree(Mapping[str, DataFrame]):
    """Tables by name, each derived on first use and kept as Parquet in the shared folder."""

    _kept: dict[tuple[str, str], OrderTree] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = configure(spark), sf_dir
        self._tables: dict[str, DataFrame] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> OrderTree:
        key = (spark.sparkContext.applicationId, sf_dir)
        if key not in cls._kept:
            cls._kept[key] = cls(spark, sf_dir)
        return cls._kept[key]

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._tables:
            derived, path = self._recipes()[name](), scratch_path(self.spark, name)
            write_parquet(derived, name, path, "error")
            self._tables[name] = self.spark.read.schema(derived.schema).parquet(path)
        return self._tables[name]

    def derived(self, name: str) -> DataFrame:
        """A table that is read once: as kept if it is, else without storing it."""
        return self._tables[name] if name in self._tables else self._recipes()[name]()

    def __iter__(self):
        return iter(self._recipes())

    def __len__(self) -> int:
        return len(self._recipes())

    def _recipes(self) -> dict[str, Callable[[], DataFrame]]:
        return {
            "directories": self._directories,
            "files": self._files,
            "users": self._users,
            "listing": self._listing,
            "crawl_runs": self._crawl_runs,
            "ancestors": lambda: build_lineage(self["directories"]),
            "directory_usage": lambda: build.usage_layout(self["files"], self["ancestors"]),
            "access_usage": lambda: build.access_layout(self["files"]),
            "access_times": lambda: build.times_layout(self["access_usage"]),
            "access_hours": lambda: rollups.access_hours(self["access_times"]),
            "directory_intervals": lambda: build.intervals_layout(self["directory_lineage"]),
            "directory_lineage": lambda: build.lineage_layout(
                self["ancestors"], self["directory_usage"]
            ),
            "directory_closure": lambda: build.closure_layout(self["directory_lineage"]),
            "directory_stats": lambda: build.stats_layout(
                rollups.directory_stats(self["directory_lineage"], _utc(AS_OF))
            ),
            "stats_maxima": lambda: tables.file_maxima(self["directory_stats"]).coalesce(1),
            "user_stats": lambda: rollups.user_stats(self["directory_usage"]),
        }

    def _directories(self) -> DataFrame:
        region = self.raw("region").select("r_regionkey", F.concat(F.lit("/"), "r_name").alias("r_path"))
        nation = (
            self.raw("nation")
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", "n_regionkey", F.concat_ws("/", "r_path", "n_name").alias("n_path"))
        )
        customer = (
            self.raw("customer")
            .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_nationkey", F.concat_ws("/", "n_path", "c_name").alias("c_path"))
        )
        order = self.raw("orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))

        def level(df, base, key, path, parent, owner, mtime):
            return df.select(
                (F.lit(base) + F.col(key)).cast("bigint").alias("dir_id"),
                path.alias("path"),
                parent.cast("bigint").alias("parent_id"),
                owner.cast("bigint").alias("owner_uid"),
                mtime.alias("mtime"),
                _utc(AS_OF).alias("last_seen"),
            )

        return (
            level(region, REGION_BASE, "r_regionkey", F.col("r_path"), F.lit(None), F.lit(1_000_001), _utc(OLD))
            .unionByName(
                level(
                    nation,
                    NATION_BASE,
                    "n_nationkey",
                    F.col("n_path"),
                    F.lit(REGION_BASE) + F.col("n_regionkey"),
                    F.lit(1_000_002),
                    _utc(OLD),
                )
            )
            .unionByName(
                level(
                    customer,
                    CUSTOMER_BASE,
                    "c_custkey",
                    F.col("c_path"),
                    F.lit(NATION_BASE) + F.col("c_nationkey"),
                    F.lit(1_000_003),
                    _utc(OLD),
                )
            )
            .unionByName(
                level(
                    order,
                    ORDER_BASE,
                    "o_orderkey",
                    F.concat_ws("/", "c_path", F.col("o_orderkey").cast("string")),
                    F.lit(CUSTOMER_BASE) + F.col("o_custkey"),
                    F.when(F.col("o_orderkey") % 100 != 0, F.lit(1_000_004)),
                    F.col("o_orderdate"),
                )
            )
        )

    def _files(self) -> DataFrame:
        return self._items().drop("l_orderkey")

    def _items(self) -> DataFrame:
        """The files with the order they belong to, dealt out by it."""
        in_order = Window.partitionBy("l_orderkey").orderBy(
            "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
        )
        item = self.raw("lineitem").withColumn("seq", F.row_number().over(in_order).cast("bigint"))
        file_id = F.col("l_orderkey") * 1000 + F.col("seq")
        return item.select(
            "l_orderkey",
            file_id.alias("file_id"),
            (F.lit(ORDER_BASE) + F.col("l_orderkey")).alias("dir_id"),
            F.concat(F.lit("item-"), F.col("seq").cast("string")).alias("filename"),
            F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("size_bytes"),
            F.col("l_suppkey").alias("owner_uid"),
            F.when(
                F.col("l_linenumber") != 7,
                F.col("l_shipdate") + F.make_dt_interval(F.col("l_quantity").cast("int")),
            ).alias("atime"),
            F.col("l_shipdate").alias("mtime"),
            F.col("l_shipdate").alias("ctime"),
            file_id.alias("inode"),
            F.lit(1).alias("hardlink_count"),
            _utc(AS_OF).alias("last_seen"),
        )

    def _users(self) -> DataFrame:
        supplier = self.raw("supplier").select(
            F.col("s_suppkey").alias("uid"), "s_name", F.col("s_nationkey").cast("bigint").alias("gid")
        )
        return (
            rollups.build_users(self["files"], self["directories"])
            .join(supplier, "uid", "left")
            .select("uid", F.when(F.col("uid") % 10 != 0, F.col("s_name")).alias("username"), "gid")
        )

    def _crawl_runs(self) -> DataFrame:
        """One run per day on which an order was placed."""
        return self.raw("orders").groupBy(F.col("o_orderdate").alias("finished_at")).agg(
            F.min("o_orderkey").alias("id")
        ).select("id", "finished_at")

    def _listing(self) -> DataFrame:
        """Raw entries: all directories and files, plus one symlink per part, some unreadable."""
        none = F.lit(None)

        def entries(df, **values):
            return df.select(
                *[
                    values.get(f.name, none)
                    .cast(NTZ if isinstance(f.dataType, T.TimestampType) else f.dataType)
                    .alias(f.name)
                    for f in LISTING.fields
                ]
            )

        zero, part = F.lit(0), F.col("p_partkey")
        dirs = self["directories"]
        # files are joined as they are dealt out to number them: stored ones would be shuffled once more
        order = dirs.where(F.col("dir_id") >= ORDER_BASE).select((F.col("dir_id") - ORDER_BASE).alias("l_orderkey"), "path")
        placed = self._items().join(order, "l_orderkey")
        return (
            entries(
                dirs,
                path=F.col("path"),
                entry_type=F.lit("d"),
                size_bytes=zero,
                uid=F.col("owner_uid"),
                gid=zero,
                mtime=F.col("mtime"),
            )
            .unionByName(
                entries(
                    placed,
                    path=F.concat_ws("/", "path", "filename"),
                    entry_type=F.lit("f"),
                    size_bytes=F.col("size_bytes"),
                    inode=F.col("inode"),
                    uid=F.col("owner_uid"),
                    gid=zero,
                    nlink=F.col("hardlink_count"),
                    atime=F.col("atime"),
                    mtime=F.col("mtime"),
                    ctime=F.col("ctime"),
                )
            )
            .unionByName(
                entries(
                    self.raw("part"),
                    path=F.concat(F.lit("/ASIA/link-"), part.cast("string")),
                    entry_type=F.lit("l"),
                    size_bytes=zero,
                    uid=zero,
                    gid=zero,
                    mtime=_utc(OLD),
                    error_kind=F.when(part % 97 == 0, F.lit("NotFound")).when(
                        part % 89 == 0, F.lit("IoError")
                    ),
                )
            )
        )
