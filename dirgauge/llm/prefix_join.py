"""Pairs of sets that may reach a Jaccard similarity, by an exact prefix-filter join.

The elements of a set stand in order of their counts over all sets, rarest first. Two sets of n and m
elements that share at least `need` of them share their first common element within the first
n - need + 1 places of the one and the first m - need + 1 of the other. Only those places are joined,
so no pair that reaches the similarity is lost, and what all sets of a template share comes last.

How far the places reach depends on both sizes. So the join is by element and band of the smaller
set's size: a row goes only to the bands in which its place can still be the first common one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirgauge.operators.joins import lookup_join
from dirgauge.session import materialise

#: Sizes of one band differ by less than this factor; small ones have a band each.
BAND = 1.02


def _band(n: Column) -> Column:
    """Number of the band of a size; it rises with the size, and up to 1 / (BAND - 1) by one each."""
    single = math.floor(1 / (BAND - 1))
    return F.when(n <= single, n).otherwise(single + F.ceil(F.log(n / F.lit(single)) / math.log(BAND))).cast("bigint")


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """e, id, group, n, left, most: the places of each set that may hold the first element in common with
    a set of another group. left: elements from there on; most: the largest size of such a partner."""
    rows = sets.select("id", "group", F.size("elements").alias("n"), F.explode("elements").alias("e"))
    shared = rows.groupBy("e").agg(F.count("*").alias("sets"), F.min("group").alias("least"), F.max("group").alias("most"))
    shared = materialise(shared.where("sets > 1").withColumn("crosses", F.expr("least <> most")).drop("least", "most"), "shared-elements")
    total, parts = shared.agg(F.sum("sets")).first()[0] or 0, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    even = max(total // parts, 1)
    heavy = {r["e"]: -(-r["sets"] // even) for r in shared.where(F.col("sets") > even).collect()}  # fewer than there are tasks
    # an element of a single set is never a common one, but takes its place before the others
    placed = lookup_join(rows, shared, "e", heavy, "inner", "id").groupBy("id").agg(
        F.first("group").alias("group"), F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("sets", "e", "crosses"))).alias("common")
    )
    placed = placed.select("id", "group", "n", (F.col("n") - F.size("common")).alias("alone"), F.posexplode("common").alias("i", "c"))
    placed = placed.withColumn("left", F.col("n") - F.col("alone") - F.col("i"))
    # percent * (n + m) <= (100 + percent) * left, and 100 * m >= percent * n, and 100 * n >= percent * m
    most = F.least(F.floor((100 + percent) * F.col("left") / percent - F.col("n") + 1e-6), F.floor(100 * F.col("n") / percent + 1e-6))
    placed = placed.withColumn("most", most).where(f"c.crosses AND 100 * most >= {percent} * n")
    return placed.select("c.e", "id", "group", "n", "left", "most")


def candidate_pairs(sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) with a < b: all pairs of `sets` that reach `percent`, and some that do not.

    `sets` has id, group and elements (distinct numbers); pairs within one group are left out.
    """
    placed = materialise(prefixes(sets, percent), "prefixes")
    a, b = (placed.select("e", *[F.col(c).alias(f"{c}_{s}") for c in ("id", "group", "n", "left", "most")]) for s in "ab")
    a = a.where("most_a >= n_a").withColumn("band", _band(F.col("n_a")))  # the smaller one
    lowest = F.ceil(percent * F.col("n_b") / 100 - 1e-6)
    b = b.withColumn("band", F.explode(F.sequence(_band(lowest), _band(F.least("n_b", "most_b")))))
    enough = f"""group_a <> group_b AND (n_a < n_b OR n_a = n_b AND id_a < id_b) AND 100 * n_a >= {percent} * n_b
        AND {100 + percent} * least(left_a, left_b) >= {percent} * (n_a + n_b)"""
    return a.join(b, ["e", "band"]).where(enough).select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()
