"""Near-duplicate documents with a MinHash forest.

Every document has a signature of SLOTS minima over its set of five-word shingles. TREES orders of the
signature give TREES sorted lists: rows are range-partitioned and sorted by the first DEPTH minima and
then by the rest of the signature, so that the neighbours of a row share the longest prefix with it.
A region (rows with equal first minima) of up to WINDOW + 1 rows is compared in full. In a denser one,
or one that a range boundary cuts, rows are compared with the WINDOW next; rows that have further ones
in their region go to an exact prefix-filter join, which stands in for further depth.

Rows carry the group they are known to belong to, at first themselves. A round proposes each group's best
neighbour in another group, confirms it on the full sets and merges the groups, so that a group of many copies
halves from round to round and pairs inside a group are never made. When few proposals are confirmed,
all pairs of neighbours in different groups are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.llm import reach
from dirgauge.llm import words as W
from dirgauge.llm.components import components
from dirgauge.llm.prefix_join import candidate_pairs
from dirgauge.session import materialise

SHINGLE = 5
SLOTS, TREES, DEPTH, WINDOW = 96, 10, 3, 16
#: Least equal slots of a candidate. At similarity 0.85 the mean is 81.7, the deviation 3.5.
EQUAL_SLOTS = 66
#: Rounds go on while more than one in AGAIN proposals is confirmed.
AGAIN = 4

_RANDOM = np.random.Generator(np.random.PCG64(7))
_FACTORS = _RANDOM.integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 2**63, SLOTS, dtype=np.uint64)


def _sets(batch: pa.RecordBatch):
    raw, at = W.flat(W.column(batch, "text"))
    return W.shingles(W.split_words(raw, at, W.NOT_SPACE, True), SHINGLE)


def _nodes(values: np.ndarray, at: np.ndarray, full: np.ndarray) -> pa.Array:
    """16 bytes that stand for the whole set: two sums of mixed hashes."""
    out = np.zeros((len(at) - 1, 2), np.uint64)
    if full.any():
        first = at[:-1][full]
        out[full, 0] = W.mix(np.add.reduceat(values, first))
        out[full, 1] = W.mix(np.add.reduceat(W.mix(values ^ np.uint64(0x5851F42D4C957F2D)), first))
    packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(out), [None, pa.py_buffer(np.ascontiguousarray(out))])
    return pa.array(np.where(full, packed.to_numpy(zero_copy_only=False), None), pa.binary())


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            values, at = _sets(piece)
            n = np.diff(at)
            full = n > 0
            sketch = np.zeros((len(n), SLOTS), np.uint8)
            keys = np.zeros((len(n), TREES), np.int64)
            if full.any():
                first = at[:-1][full]
                minima = np.empty((full.sum(), SLOTS), np.uint64)
                for k in range(SLOTS):
                    minima[:, k] = np.minimum.reduceat(values * _FACTORS[k] + _SHIFTS[k], first)
                minima = W.mix(minima)
                sketch[full] = (minima >> np.uint64(56)).astype(np.uint8)
                for t in range(TREES):
                    key = np.full(len(minima), t + 1, np.uint64)
                    for i in range(DEPTH):
                        key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, _slot(t, i)])
                    keys[full, t] = key.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    W.column(piece, "doc_id"),
                    pa.array(n, pa.int64()),
                    _nodes(values, at, full),
                    pa.array([x.tobytes() for x in sketch], pa.binary()),
                    pa.array(list(keys), pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "node", "sketch", "keys"],
            )


def _slot(tree: int, i: int) -> int:
    return (tree * (SLOTS // TREES) + i) % SLOTS


def _neighbours(every: bool):
    """Sorted rows (key, label, node, group) to pairs of rows at most WINDOW apart that have the same key,
    different groups and enough equal slots: all of them, or the best of each row and of each group in a
    batch, as (group, a, b, equal).

    A row that may have others of its key further off, here or beyond the range, comes with b NULL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = first_key = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            n, old = rows.num_rows, 0 if tail is None else tail.num_rows
            key = rows.column("key").to_numpy()
            label = np.frombuffer(b"".join(rows.column("label").to_pylist()), np.uint8).reshape(-1, SLOTS)
            node, named = (rows.column(c).combine_chunks() for c in ("node", "group"))
            group = named.dictionary_encode().indices.to_numpy()
            if first_key is None and n:
                first_key = key[0]
            far = [np.flatnonzero(key[old:] == first_key) + old] if n else []
            i = np.flatnonzero(key[: -WINDOW - 1] == key[WINDOW + 1 :])
            far += [i, i + WINDOW + 1]
            found = [(np.empty(0, np.int64), 0, np.empty(0, np.int64))]
            for d in range(1, min(WINDOW, n - 1) + 1):
                i = np.flatnonzero((key[:-d] == key[d:]) & (group[:-d] != group[d:]))
                i = i[i + d >= old]
                for part in np.array_split(i, len(i) // 200_000 + 1):
                    equal = (label[part] == label[part + d]).sum(1)
                    found.append((part[equal >= EQUAL_SLOTS], d, equal[equal >= EQUAL_SLOTS]))
            left = np.concatenate([f[0] for f in found])
            right = np.concatenate([f[0] + f[1] for f in found])
            equal = np.concatenate([f[2] for f in found]).astype(np.int64)
            if not every:
                left, right, equal = np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([equal, equal])
                order = np.lexsort((-equal, group[left]))
                best = np.ones(len(order), bool)
                best[1:] = group[left[order[1:]]] != group[left[order[:-1]]]
                # a row with neighbours in other groups stays in the next round, the best pair or not
                seen, row = np.unique(left, return_index=True)
                best = np.union1d(order[best], row)
                left, right, equal = left[best], right[best], equal[best]
            far = np.unique(np.concatenate(far))
            missing = pa.nulls(len(far), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([named.take(pa.array(left)), missing]),
                    node.take(pa.array(np.concatenate([left, far]))),
                    pa.concat_arrays([node.take(pa.array(right)), missing]),
                    pa.array(np.concatenate([equal, np.zeros(len(far), np.int64)])),
                ],
                names=["group", "a", "b", "equal"],
            )
            tail = rows.slice(max(0, n - WINDOW - 1)).to_batches()
            tail = tail[0] if tail else None
        if tail is not None:
            key = W.column(tail, "key").to_numpy()
            node = W.column(tail, "node").filter(pa.array(key == key[-1]))
            missing = pa.nulls(len(node), pa.binary())
            yield pa.RecordBatch.from_arrays([missing, node, missing, pa.array(np.zeros(len(node), np.int64))], names=["group", "a", "b", "equal"])

    return run


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            values, at = _sets(piece)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.view(np.int64)))
            yield pa.RecordBatch.from_arrays([_nodes(values, at, np.diff(at) > 0), lists], names=["node", "shingles"])


def _name_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        row = W.column(batch, "row")
        for piece in W.pieces(pa.RecordBatch.from_arrays([row, row.field("text")], names=["row", "text"]), "text"):
            values, at = _sets(piece)
            yield pa.RecordBatch.from_arrays([piece.column(0), _nodes(values, at, np.diff(at) > 0)], names=["row", "node"])


def neighbours(nodes: DataFrame, groups: DataFrame | None, every: bool) -> DataFrame:
    """(group, a, b, equal): neighbours in different groups in any of the sorted orders, the best ones of each
    group or all. (NULL, a, NULL, 0) is a row that has not met all rows of a region of its."""
    width = SLOTS // TREES
    turned = F.when(F.col("tree") == 0, F.col("sketch"))
    for t in range(1, TREES):
        cut = t * width
        turned = turned.when(
            F.col("tree") == t,
            F.concat(F.substring("sketch", cut + 1, SLOTS - cut), F.substring("sketch", 1, cut)),
        )
    named = nodes.withColumn("group", F.col("node"))
    if groups is not None:
        named = nodes.join(groups, "node", "left").withColumn("group", F.coalesce("root", "node"))
    rows = named.select("node", "group", "sketch", F.posexplode("keys").alias("tree", "key")).select("key", turned.alias("label"), "node", "group")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, "key", "label").sortWithinPartitions("key", "label", "node")
    return ordered.mapInArrow(_neighbours(every), "group binary, a binary, b binary, equal bigint")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    joined = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("both", both)
    return joined.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def _in_order(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _grouped(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signed rows (node is NULL without shingles), and node, root, component_id per distinct set."""
    reach(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + [T.StructField(n, t) for n, t in (("n_shingles", T.LongType()), ("node", T.BinaryType()), ("sketch", T.BinaryType()), ("keys", T.ArrayType(T.LongType())))]
    )
    signed = materialise(docs.mapInArrow(_sign, schema), "signed")
    filled = signed.where("node IS NOT NULL")
    nodes = materialise(
        filled.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("sketch").alias("sketch"), F.min("keys").alias("keys")), "nodes"
    )
    live = nodes.select("node", "sketch", "keys")
    links = groups = sets = dense = None
    while True:
        found = materialise(neighbours(live, groups, False), "neighbours")
        if dense is None:
            dense = materialise(found.where("b IS NULL").select(F.col("a").alias("node")).distinct(), "dense")
            ends = materialise(found.select(F.explode(F.array("a", "b")).alias("node")).where("node IS NOT NULL").distinct(), "ends")
            wanted = nodes.join(ends, "node", "left_semi").select(F.col("doc_id").alias("wanted")).distinct()
            texts = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("wanted")), "left_semi").select("text")
            sets = texts.mapInArrow(_full_sets, "node binary, shingles array<bigint>").join(ends, "node", "left_semi")
            sets = materialise(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
        pairs = found.where("b IS NOT NULL")
        best = pairs.groupBy("group").agg(F.max_by(F.struct("a", "b"), "equal").alias("p"))
        best = materialise(best.select(*_in_order("p.a", "p.b")).distinct(), "proposals")
        fresh = materialise(_confirmed(best, sets, percent), "links")
        links = fresh if links is None else links.unionByName(fresh)
        groups = materialise(components(links), "groups")
        live = live.join(materialise(pairs.select(F.col("a").alias("node")).distinct(), "live"), "node", "left_semi")
        if AGAIN * fresh.count() <= best.count():
            break
    rest = neighbours(live, groups, True).where("b IS NOT NULL").select(*_in_order("a", "b")).distinct()
    links = materialise(links.unionByName(_confirmed(rest, sets, percent)), "links")
    groups = materialise(components(links), "groups")
    dense = sets.join(dense, "node", "left_semi").join(groups, "node", "left")
    dense = dense.select(F.col("node").alias("id"), F.coalesce("root", "node").alias("group"), F.col("shingles").alias("elements"))
    links = links.unionByName(_confirmed(candidate_pairs(materialise(dense, "dense"), percent), sets, percent))
    groups = materialise(components(links), "groups")

    member = nodes.select("node", "doc_id").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = member.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return signed, member.join(smallest, "root").select("node", "root", "component_id")


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs` (doc_id, text; more may be there).

    Documents with 100 * intersection >= percent * union are linked; component_id is the smallest
    doc_id reachable. NULL text, or one without words, has no shingles and is linked with nothing.
    Repeated rows share their component and are all kept if one is. A NULL doc_id is never smallest:
    where a component has no other, component_id is NULL and kept is true.
    """
    signed, of_node = _grouped(docs, percent)
    filled = signed.where("node IS NOT NULL")
    linked = filled.select("doc_id", "n_shingles", "node").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicate(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row of `docs` per component, that of its smallest doc_id; rows without shingles all stay."""
    signed, of_node = _grouped(docs, percent)
    filled = signed.where("node IS NOT NULL").select("doc_id", "node")
    first = filled.join(of_node, "node").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    winners = materialise(first.groupBy("root").agg(F.min("node").alias("w_node"), F.min("doc_id").alias("w_id")), "winners")
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("node", T.BinaryType())])
    rows = docs.select(F.struct("*").alias("row")).mapInArrow(_name_rows, schema)
    same = (F.col("node") == F.col("w_node")) & F.col("row.doc_id").eqNullSafe(F.col("w_id"))
    chosen = rows.where("node IS NOT NULL").join(winners, same, "left_semi").groupBy("node").agg(F.first("row").alias("row"))
    return chosen.select("row.*").unionByName(rows.where("node IS NULL").select("row.*"))
