"""Mixing sources to target weights, with exact budgets from distributed prefix sums.

Documents get a hash-random key; within a source they are taken in the order of the key until the
budget is spent. The key range is cut into buckets, about the square root of the number of rows: sums
per bucket tell which one the cut lies in, and only that bucket is put in order row by row. No source is
ever held by one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dirgauge.session import materialise

#: `[^\x20\x09-\x0D]+`
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def _keyed(docs: DataFrame, seed: str, *more: Column) -> DataFrame:
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), key.alias("key"), *more)


def _bucket(bits: int) -> Column:
    return F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), 32 - bits)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """source, source_size, target from (source, source_size), a row per source.

    Weights go round the sources by code point, NULL last. A target over `most` times the source's size
    stops there and the excess is dealt again by weight, until none is above: sources are looked at in
    the order of size / weight, each against the level that those before it leave.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(in_order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("bigint")
    table = sizes.withColumn("weight", weight).withColumn("most", most * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    table = table.withColumn("full", F.col("most") < left.cast("double") / weight_left * F.col("weight"))
    table = table.withColumn("spent", F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything))
    table = table.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything))
    total = F.sum("source_size").over(everything)
    level = (total - F.col("spent")).cast("double") / F.col("open")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(level * F.col("weight"))
    return table.select("source", "source_size", target.alias("target"))


def _plan(keyed: DataFrame, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """Per source: its target, whole epochs, and the bucket and rest of the cut; the bits of a bucket."""
    rows = keyed.count()
    bits = min(20, max(4, math.ceil(math.log2(max(rows, 1)) / 2)))
    sums = keyed.groupBy("source", _bucket(bits).alias("bucket")).agg(F.sum("size").alias("sum"))
    sums = materialise(sums, "mix-sums")
    goals = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, most)
    goals = goals.withColumn("budget", F.floor(F.col("target") + 0.5))
    has = F.col("source_size") > 0
    goals = goals.withColumn("epochs", F.when(has, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("bigint"))
    goals = goals.withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("sum").over(running), F.lit(0))
    cut = sums.select("source", "bucket", "sum", spent.alias("spent")).alias("s").join(goals.alias("g"), F.expr("s.source <=> g.source"))
    cut = cut.where("spent < rest AND rest <= spent + sum").select("s.source", "bucket", (F.col("rest") - F.col("spent")).alias("rest"))
    cuts = goals.alias("g").join(cut.alias("c"), F.expr("g.source <=> c.source"), "left").select(
        F.col("g.source").alias("of"), "source_size", "target", "epochs", F.coalesce("bucket", F.lit(-1)).alias("cut"), F.coalesce("c.rest", F.lit(0)).alias("rest")
    )
    return materialise(cuts, "mix-cuts"), bits


def _allocated(keyed: DataFrame, cuts: DataFrame, bits: int) -> DataFrame:
    rows = keyed.withColumn("bucket", _bucket(bits)).join(cuts, F.expr("source <=> of"))
    whole = F.col("epochs") * F.col("size")
    clear = rows.where("bucket <> cut").withColumn("taken", whole + F.when(F.col("bucket") < F.col("cut"), F.col("size")).otherwise(0))
    order = Window.partitionBy("of").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(order), F.lit(0))
    part = F.greatest(F.lit(0), F.least("size", F.col("rest") - before))
    return clear.unionByName(rows.where("bucket = cut").withColumn("taken", whole + part))


def allocate(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken per row of `docs` (doc_id, text, source).

    taken: words the mix takes of the document, whole epochs and then, in key order, what is left of the
    source's budget (its target, rounded); the document on the cut gives its first words only. NULL
    texts have size 0, NULL is a source of its own, a NULL doc_id is a key like any. Rows with equal
    doc_id follow by size; rows alike in both are interchangeable. No rows give no rows.
    """
    keyed = materialise(_keyed(docs, seed), "mix")
    cuts, bits = _plan(keyed, weights, most)
    return _allocated(keyed, cuts, bits).select("doc_id", "source", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed documents, with the columns of `docs`: a row for each epoch of a document.

    The document on a source's cut comes once more with only its first words, joined by single blanks;
    n_chars, if there, is that text's length.
    """
    cuts, bits = _plan(materialise(_keyed(docs, seed), "mix"), weights, most)
    rows = _allocated(_keyed(docs, seed, F.struct("*").alias("row")), cuts, bits)
    epochs = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    words = (F.col("taken") - epochs * F.col("size")).cast("int")
    copies = rows.select("row", "size", epochs.alias("epochs"), words.alias("words"))
    whole = copies.where("epochs > 0").select("row", F.explode(F.sequence(F.lit(1), "epochs"))).select("row.*")
    cut = copies.where("words > 0")
    text = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})")), F.lit(1), F.col("words")), " ")
    changed = F.col("row").withField("text", text)
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(cut.select(changed.alias("row")).select("row.*"))
