"""Connected components by alternating star contraction, until one task can hold what is left."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dirgauge.llm import reach
from dirgauge.session import materialise

#: Edges that one task contracts at once. More are first contracted by rounds over all tasks.
HELD = 100_000


def _roots(batches: Iterable[pa.RecordBatch]) -> list[tuple]:
    """(node, the smallest node it reaches) for every node of the edges."""
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in parent]


def _columns(pairs: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(i).type) for i in (0, 1)], names=["a", "b"])


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the edges of each batch: every node points to the smallest it reaches there."""
    for batch in batches:
        yield _columns([p for p in _roots([batch]) if p[0] != p[1]], batch.schema)


def _all_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contract the edges of all batches together; the smallest nodes point to themselves."""
    kept = list(batches)
    if kept:
        pairs = _roots(kept)
        for i in range(0, len(pairs), 10_000):
            yield _columns(pairs[i : i + 10_000], kept[0].schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): the smallest node it reaches.

    Edges with a NULL end or equal ends say nothing. Each round is stored in the shared folder; its
    shuffles are sums or minima per node with partial results, or joins that adaptive execution can
    split, so a star with very many rays is no single task. The number of rounds grows with the
    logarithm of the longest path. Rounds are for more than `HELD` edges; so many or fewer are contracted by
    one task at once, whatever their number is in the beginning or becomes.
    """
    reach(edges.sparkSession)
    edges = edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    schema = edges.schema
    edges = materialise(edges.mapInArrow(_local_stars, schema).distinct(), "edges")
    seen, n = None, edges.count()
    while n > HELD:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialise(large.where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b"))))
            .alias("e")
        )
        edges = materialise(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        state = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("bigint")), F.sum(F.crc32(F.col("b").cast("string").cast("binary")))).first()
        if state == seen:
            break
        seen, n = state, state[0]
    if n <= HELD:
        return edges.coalesce(1).mapInArrow(_all_stars, schema).toDF("node", "root")
    node = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return node.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
