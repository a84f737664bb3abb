"""How far the sources of a language differ in their terms, from a frequent-pattern tree of term rows.

A term's row is its count in each source that has it, in the order of the sources. Rows alike, as those of
most rare terms are, are one pattern with a multiplicity. Patterns sorted item by item are a prefix tree
read in depth-first order: a pattern opens the nodes behind what it shares with the one before, and a node's
multiplicity is that of the run of patterns that share it.

Divergence f(p, q) = floor((p - q)^2 / q) is summed over all terms of a language, most of which a pair of
sources does not have. So a sum has four parts: every term as if neither had it; a correction for each
term of the one, and of the other, from the number of terms per count; and, for terms of both, a
correction for each pair of a node and an ancestor, taken once and multiplied by the node's
multiplicity. All numbers are whole; sums are wide enough for any input.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dirgauge.llm import reach
from dirgauge.llm import words as W
from dirgauge.operators.joins import broadcast_if_small
from dirgauge.session import materialise

LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
TOP = 200
#: Pairs of a node and an ancestor that a task holds at a time.
PAIRS = 1 << 20

#: `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`
_BYTES = np.arange(256)
TERM_BYTES = ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = _BYTES.astype(np.uint8)
_LOWER[0x41:0x5B] += 0x20


def _terms(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The terms of all texts, one after the other, and the text of each."""
    raw, at = W.flat(column)
    inside = TERM_BYTES[raw]
    full = at[:-1] < at[1:]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    text = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(_LOWER[raw[inside]])))
    return text, np.searchsorted(at, starts, "right") - 1


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, source, term, occurrences and documents, summed over a piece of the documents."""
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            terms, doc = _terms(W.column(piece, "text"))
            if not len(terms):
                continue
            coded = terms.dictionary_encode()
            kinds = len(coded.dictionary)
            in_doc, n = np.unique(doc * kinds + coded.indices.to_numpy(), return_counts=True)
            group = pa.StructArray.from_arrays([W.column(piece, c) for c in ("lang", "source")], names=["lang", "source"])
            named = {}
            of_doc = np.array([named.setdefault((g["lang"], g["source"]), len(named)) for g in group.to_pylist()])
            key, at = np.unique(of_doc[in_doc // kinds] * kinds + in_doc % kinds, return_inverse=True)
            langs, sources = (pa.array([g[i] for g in named], pa.string()) for i in (0, 1))
            which = pa.array(key // kinds)
            yield pa.RecordBatch.from_arrays(
                [
                    langs.take(which),
                    sources.take(which),
                    coded.dictionary.take(pa.array(key % kinds)).cast(pa.string()),
                    pa.array(np.bincount(at, n).astype(np.int64)),
                    pa.array(np.bincount(at).astype(np.int64)),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )


def term_rows(documents: DataFrame, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """lang, term, total, cells (source, n; in the order of sources) of each term that `least` documents
    of its language have. `documents` has text, lang and source, none of them NULL.

    A row has an entry per source at most, and so has the result a row per two sources.
    """
    reach(documents.sparkSession)
    counted = documents.select("text", "lang", "source").mapInArrow(_count, "lang string, source string, term string, n bigint, docs bigint")
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    rows = cells.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("cells"))
    return rows.where(F.col("docs") >= least).select("lang", "term", "total", "cells")


def _share(n: Column, whole: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / whole), exactly."""
    wide = "decimal(38,0)"
    up = (F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(20,0)")).cast(wide)
    return F.call_function("div", up, whole.cast(wide)) + 1


def _f(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _pair_corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Patterns in order to lang, a, b (sources' numbers) and the sum of corrections for value (a, b)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        items = W.column(batch, "items")
        at = items.offsets.to_numpy().astype(np.int64)
        at = at - at[0]
        i, n, p, z = (pc.to_numpy() for pc in items.flatten().flatten())
        coded = W.column(batch, "lang").dictionary_encode()
        lang, many = coded.indices.to_numpy().astype(np.int64), np.concatenate([[0], np.cumsum(W.column(batch, "m").to_numpy())])
        size, rows = np.diff(at), len(at) - 1
        # what a pattern shares with the one before
        common = np.concatenate([[0], np.where(lang[1:] == lang[:-1], np.minimum(size[1:], size[:-1]), 0)])
        row = np.repeat(np.arange(rows), common)
        place = np.arange(len(row)) - np.repeat(np.cumsum(common) - common, common)
        here, above = at[row] + place, at[row - 1] + place
        differs = (i[here] != i[above]) | (n[here] != n[above])
        shared = common.copy()
        np.minimum.at(shared, row[differs], place[differs])
        # a node: a row and a place from where the row leaves the one before; it ends where a row leaves it
        opened = size - shared
        row = np.repeat(np.arange(rows), opened)
        place = np.arange(len(row)) - np.repeat(np.cumsum(opened) - opened, opened) + shared[row]
        ends = np.empty(len(row), np.int64)
        order = np.lexsort((row, place))
        for level in np.split(order, np.flatnonzero(np.diff(place[order])) + 1) if len(order) else []:
            breaks = np.append(np.flatnonzero(shared <= place[level[0]]), rows)
            ends[level] = breaks[np.searchsorted(breaks, row[level], "right")]
        weight = many[ends] - many[row]
        done = np.concatenate([[0], np.cumsum(place)])
        first = 0
        while first < len(row):  # PAIRS at a time, a node's at least
            last = max(first + 1, int(np.searchsorted(done, done[first] + PAIRS, "right")) - 1)
            part = slice(first, last)
            node = np.repeat(at[row[part]] + place[part], place[part])
            older = np.arange(len(node)) - np.repeat(done[part] - done[first], place[part]) + np.repeat(at[row[part]], place[part])
            times, of = np.repeat(weight[part], place[part]), np.repeat(lang[row[part]], place[part])
            first = last
            if len(node):
                yield _summed(coded.dictionary, of, i, p, z, older, node, times)


def _summed(langs: pa.Array, of, i, p, z, a, b, times) -> pa.RecordBatch:
    width = int(i.max()) + 1
    keys, values = [], []
    for x, y in ((a, b), (b, a)):
        f = lambda s, t: (s - t) ** 2 // t
        keys.append((of * width + i[x]) * width + i[y])
        values.append(f(p[x], p[y]) - f(p[x], z[y]) - f(z[x], p[y]) + f(z[x], z[y]))
    key, value, times = np.concatenate(keys), np.concatenate(values), np.concatenate([times, times])
    found, at = np.unique(key, return_inverse=True)
    # two halves, so that no sum overflows 64 bits
    high, low = np.zeros(len(found), np.int64), np.zeros(len(found), np.int64)
    np.add.at(high, at, (value >> 32) * times)
    np.add.at(low, at, (value & 0xFFFFFFFF) * times)
    sums = [Decimal((h << 32) + x) for h, x in zip(high.tolist(), low.tolist())]
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(found // width**2)), pa.array(found // width % width), pa.array(found % width), pa.array(sums, pa.decimal128(38, 0))],
        names=["lang", "a", "b", "value"],
    )


def _groups(documents: DataFrame, rows: DataFrame) -> DataFrame:
    """lang, source, i (number of the source in its language), v, n_source, n_lang, z (share of a term
    that the source does not have; NULL without terms) of every group that occurs."""
    found = documents.select("lang", "source").distinct()
    sums = rows.select("lang", F.explode("cells").alias("c")).groupBy("lang", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n_source"))
    langs = rows.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    out = found.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["n_source", "v", "n_lang"])
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    z = F.when(F.col("v") > 0, _share(F.lit(0), F.col("n_source") + F.col("v")))
    return materialise(out.select("lang", "source", number.cast("bigint").alias("i"), "v", "n_source", "n_lang", z.alias("z")), "groups")


def divergence(documents: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank from `documents` (text, lang, source; NULL is empty).

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; each language keeps those that
    at least `least` of its documents have. In a group (lang, source) or a whole language a kept term has
    p = 1 + floor(10^9 (count + 1) / (N + V)), N the count's sum over the V kept terms. Part `pair`: f of the
    group against each other source of its language, summed over all kept terms (0 without any). Part
    `term`: f of the group against its whole language, of the terms it has with the larger share, the
    `top` highest. rank: by value, highest first, then by item.

    Every row is a document, repeated ones too; doc_id is not used. Empty strings are a language and a
    source like any. A group without terms has pairs only; the single group of a language has no pairs.
    """
    documents = documents.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    rows = materialise(term_rows(documents, least), "term-rows")
    groups = _groups(documents, rows)
    listed = F.map_from_entries(F.collect_list(F.struct("source", F.struct("i", "n_source", "z"))))
    langs = groups.groupBy("lang").agg(F.first("v").alias("v"), F.first("n_lang").alias("n_lang"), listed.alias("sources"))
    langs = broadcast_if_small(materialise(langs, "langs")) if groups.count() <= 20_000 else langs

    def cell(c: Column) -> Column:
        of = F.element_at("sources", c["source"])
        return F.struct(of["i"].alias("i"), c["n"].alias("n"), _share(c["n"], of["n_source"] + F.col("v")).alias("p"), of["z"].alias("z"), c["source"].alias("source"))

    placed = rows.join(langs, "lang").select("lang", "term", _share(F.col("total"), F.col("n_lang") + F.col("v")).alias("q"), F.transform("cells", cell).alias("items"))
    placed = materialise(placed, "placed")

    single = placed.select("lang", "term", "q", F.explode("items").alias("c")).select("lang", "term", "q", "c.*")
    terms = single.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    in_order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = terms.withColumn("rank", F.row_number().over(in_order)).where(F.col("rank") <= top)

    wide = "decimal(38,0)"
    g = broadcast_if_small(groups)
    one, other = (g.select("lang", *[F.col(c).alias(f"{c}_{s}") for c in ("source", "i", "z", "v")]) for s in "ab")
    counts = single.groupBy("lang", F.col("i").alias("i_a"), "p", F.col("z").alias("z_a")).agg(F.count("*").alias("m"))
    with_other = counts.join(other, "lang").where("i_a <> i_b")
    z_a, z_b, p, m = (F.col(c) for c in ("z_a", "z_b", "p", "m"))
    there = with_other.select("lang", F.col("i_a").alias("a"), F.col("i_b").alias("b"), ((_f(p, z_b) - _f(z_a, z_b)).cast(wide) * m).cast(wide).alias("value"))
    back = with_other.select("lang", F.col("i_b").alias("a"), F.col("i_a").alias("b"), ((_f(z_b, p) - _f(z_b, z_a)).cast(wide) * m).cast(wide).alias("value"))

    items = F.transform("items", lambda c: F.struct(c["i"], c["n"], c["p"], c["z"]))
    patterns = placed.groupBy("lang", items.alias("items")).agg(F.count("*").alias("m")).where(F.size("items") > 1)
    # ranges by the first items only: their bounds pass through the driver; a beginning that very many share is split
    ranges = ["lang", F.slice("items", 1, 3), F.xxhash64("items")]
    patterns = materialise(patterns, "patterns").repartitionByRange(*ranges).sortWithinPartitions("lang", "items")
    both = patterns.mapInArrow(_pair_corrections, "lang string, a bigint, b bigint, value decimal(38,0)")

    corrections = there.unionByName(back).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("value").cast(wide).alias("more"))
    pairs = one.join(other, "lang").where("i_a <> i_b")
    pairs = pairs.join(corrections, (pairs["lang"] == corrections["lang"]) & (pairs["i_a"] == corrections["a"]) & (pairs["i_b"] == corrections["b"]), "left").drop(corrections["lang"])
    neither = F.coalesce((_f(z_a, z_b).cast(wide) * F.col("v_a")).cast(wide), F.lit(0))
    value = (neither + F.coalesce("more", F.lit(0))).cast("bigint")
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(in_order))
    return pairs.unionByName(terms)
