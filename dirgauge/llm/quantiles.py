"""Exact quantiles per group, from the rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirgauge.operators.joins import broadcast_if_small
from dirgauge.operators.tree import assign_ids
from dirgauge.session import materialise


def quantiles(rows: DataFrame, group: str, value: str, shares: list[float], spread_by: str) -> DataFrame:
    """(group, q): for each share the least value that this share of the group's rows does not exceed.

    Rows are sorted in ranges, split by a hash of `spread_by` where values are equal, and numbered by an offset per
    task; then the rows at the places wanted are read. Groups and values are not NULL.
    """
    ordered = rows.select(group, value, F.xxhash64(spread_by).alias("_spread"))
    ordered = ordered.repartitionByRange(group, value, "_spread").sortWithinPartitions(group, value, "_spread").drop("_spread")
    placed = materialise(assign_ids(ordered, "_place", 0), "placed")
    of_group = placed.groupBy(group).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    rank = lambda share: F.greatest(F.ceil(F.lit(share) * F.col("_n")), F.lit(1)) - 1
    wanted = of_group.select(F.posexplode(F.array(*[F.col("_first") + rank(s) for s in shares])).alias("_i", "_place"))
    found = placed.join(broadcast_if_small(materialise(wanted, "places")), "_place")
    in_order = F.sort_array(F.collect_list(F.struct("_i", value)))  # a row per share
    return found.groupBy(group).agg(F.transform(in_order, lambda x: x[value]).alias("q"))
