"""Integrity rules as a report: rows that break a key, a reference or a NOT NULL column."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dirgauge.operators.joins import broadcast_if_small
from dirgauge.schemas import FOREIGN_KEYS, PRIMARY_KEYS, TABLES
from dirgauge.session import materialise


def _finding(df: DataFrame, rule: str, key: list[str]) -> DataFrame:
    text = F.concat_ws(",", *[F.col(k).cast("string") for k in key]) if key else F.lit("")
    return df.select(F.lit(rule).alias("rule"), text.alias("key"), F.col("n"))


def duplicate_keys(df: DataFrame, table: str) -> DataFrame:
    key = PRIMARY_KEYS[table]
    present = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in key])
    repeated = df.where(present).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")
    return _finding(repeated, f"pk:{table}", key)


def pair_sums(closure: DataFrame) -> DataFrame:
    """Per descendant: number of its pairs and two sums (XOR) of hashes of them. The pairs are summed
    in the task that reads them, so rows per directory are shuffled, not pairs."""
    pair = [F.col("ancestor_id"), F.col("descendant_id")]
    return (
        closure.where("ancestor_id IS NOT NULL AND descendant_id IS NOT NULL")
        .groupBy("descendant_id")
        .agg(
            F.count("*").alias("pairs"),
            F.bit_xor(F.xxhash64(*pair)).alias("one"),
            F.bit_xor(F.xxhash64(F.lit(1), *pair)).alias("two"),
        )
    )


def lineage_sums(lineage: DataFrame) -> DataFrame:
    """What `pair_sums` gives for a closure made of the lineage's rows whose ancestors all differ."""

    def total(*seed: Column) -> Column:
        each = lambda acc, a: acc.bitwiseXOR(F.xxhash64(*seed, a, F.col("dir_id")))
        return F.aggregate("ancestors", F.lit(0).cast("bigint"), each)

    sound = lineage.where(F.size(F.array_distinct("ancestors")) == F.size("ancestors"))
    return sound.select(
        F.col("dir_id").alias("descendant_id"),
        F.size("ancestors").cast("bigint").alias("pairs"),
        total().alias("one"),
        total(F.lit(1)).alias("two"),
    )


def repeated_pairs(closure: DataFrame, lineage: DataFrame) -> DataFrame:
    """Pairs that occur more than once, without a shuffle of all pairs.

    The ancestors of a lineage row differ, so a descendant whose pairs have the same number and the
    same sums of hashes (128 bits) as such a row has no pair twice. Only the pairs of descendants
    without that proof are grouped: none in a sound inventory, all of them where the lineage is missing.
    """
    key = ["descendant_id", "pairs", "one", "two"]
    unproven = pair_sums(closure).join(lineage_sums(lineage), key, "left_anti").select("descendant_id")
    unproven = materialise(unproven, "unproven")
    return duplicate_keys(
        closure.join(broadcast_if_small(unproven), "descendant_id", "left_semi"), "directory_closure"
    )


def missing_values(df: DataFrame, table: str) -> DataFrame:
    """NULLs per required column, all columns of the table in one scan."""
    required = [f.name for f in TABLES[table].fields if not f.nullable]
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in required])
    rules = ", ".join(f"'notnull:{table}.{c}', `{c}`" for c in required)
    return counts.select(
        F.expr(f"stack({len(required)}, {rules}) AS (rule, n)")
    ).where("n > 0").select("rule", F.lit("").alias("key"), "n")


def dangling_references(
    child: DataFrame, column: str, parent: DataFrame, parent_column: str, rule: str
) -> DataFrame:
    """References without a target. Children are counted per key first, so a frequent key is one
    row in the join. NULL references are allowed."""
    counts = (
        child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    )
    targets = parent.select(F.col(parent_column).alias(column))
    return _finding(counts.join(targets, column, "left_anti"), rule, [column])


def audit(t: Mapping[str, DataFrame]) -> DataFrame:
    """(rule, key, n) for every violation; empty when the tables are sound.

    With `directory_lineage` among the tables the keys of the closure are checked against it.
    """
    findings = []
    for table in TABLES:
        if table == "directory_closure" and "directory_lineage" in t:
            findings.append(repeated_pairs(t[table], t["directory_lineage"]))
        else:
            findings.append(duplicate_keys(t[table], table))
        findings.append(missing_values(t[table], table))
    for table, column, target, target_column in FOREIGN_KEYS:
        rule = f"fk:{table}.{column}->{target}"
        findings.append(
            dangling_references(t[table], column, t[target], target_column, rule)
        )
    return reduce(DataFrame.unionByName, findings)
