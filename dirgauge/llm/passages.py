"""Passages that repeat across or within documents, by MinHash banding of paragraphs.

Paragraphs are cut where the content says so, not at line breaks: before each word pair whose hash is
the least within REACH words on both sides. A passage that two texts share is cut alike in both, but
for REACH words at its ends, wherever it stands, so a passage of 50 words has whole paragraphs of its
own. Paragraphs have 6 to about 30 words, at the ends of a text also fewer; those under MIN_WORDS have no
whole shingle and are left out. A passage is a run of neighbouring paragraphs that each have a like; it counts
from MIN_RUN words on, so that a common phrase is none. The set of a paragraph is its five-word shingles. Bands are tuned for high recall: sets of BANDED
shingles or more have BANDS bands of ROWS minima, which find a pair of similarity 0.8 with probability 0.997. A smaller
set, and a larger one that a smaller may be like, have a band for each of their least shingles that a pair may share first
(a prefix filter by hash), so no pair with a small set is lost. Copies of a set share one id, so
only different sets are paired; sets of a band that holds too many go to an exact prefix-filter join.
Pairs are verified by exact Jaccard similarity and clustered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.llm import reach
from dirgauge.llm import words as W
from dirgauge.llm.components import components
from dirgauge.llm.prefix_join import candidate_pairs
from dirgauge.operators.joins import heavy_keys, lookup_join
from dirgauge.session import materialise

REACH, MIN_WORDS, SHINGLE = 5, 5, 5
#: Words of the shortest run of repeated paragraphs that is a passage.
MIN_RUN = 20
BANDS, ROWS, BANDED = 8, 3, 10
#: Next sets of a band that a set is paired with, besides the first; sets with further ones are joined apart.
WINDOW = 16

_RANDOM = np.random.Generator(np.random.PCG64(9))
_FACTORS = _RANDOM.integers(1, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Paragraphs:
    """The paragraphs of a piece: text, first word and number of words of each, and their sets."""

    def __init__(self, piece: pa.RecordBatch):
        raw, at = W.flat(W.column(piece, "text"))
        words = W.split_words(raw, at, W.NOT_SPACE, True)
        n = len(words.hashes)
        owner = words.text_of_word()
        gap = 2 * REACH + 1
        place = np.arange(n) + gap * (owner + 1)
        height = np.full(n + gap * (len(at) + 1), np.iinfo(np.uint64).max, np.uint64)
        after = np.append(words.hashes[1:], np.uint64(0)) if n else words.hashes
        after = np.where(np.append(owner[1:] == owner[:-1], False), after, np.uint64(0)) if n else after
        height[place] = W.mix(words.hashes * np.uint64(3) + W.mix(after + np.uint64(11))) >> np.uint64(1)
        least = np.ones(n, bool)
        own = height[place]
        for d in range(1, REACH + 1):
            least &= (own < height[place - d]) & (own <= height[place + d])
        begins = least.copy()
        begins[words.offsets[:-1][np.diff(words.offsets) > 0]] = True
        start = np.flatnonzero(begins)
        length = np.diff(np.append(start, n))
        kept = length >= MIN_WORDS
        start, length = start[kept], length[kept]
        self.text = owner[start] if n else start
        self.start = start - words.offsets[self.text]
        self.length = length
        # the words of the kept paragraphs, each paragraph as a text of its own
        offsets = np.concatenate([[0], np.cumsum(length)])
        index = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        self.values, self.at = W.shingles(W.Words(words.hashes[index], words.starts[index], words.ends[index], offsets), SHINGLE)
        self.ids = W.mix(np.add.reduceat(W.mix(self.values), self.at[:-1])) if len(start) else np.empty(0, np.uint64)

    def matched(self, percent: int) -> np.ndarray:
        """The paragraphs that another set can be like: one shingle more would leave them alike."""
        n = np.diff(self.at)
        return np.flatnonzero((n >= BANDED) | (100 * n >= percent * (n + 1)))

    def bands(self, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Key and paragraph of every band."""
        n = np.diff(self.at)
        wide = np.flatnonzero(n >= BANDED)
        keys, owners = [self.ids], [np.arange(len(self.ids))]
        if len(wide):
            for b in range(BANDS):
                key = np.full(len(wide), b + 1, np.uint64)
                for r in range(ROWS):
                    least = np.minimum.reduceat(W.mix(self.values * _FACTORS[b * ROWS + r]), self.at[:-1])
                    key = W.mix(key * np.uint64(0x9E3779B97F4A7C15) + least[wide])
                keys.append(key)
                owners.append(wide)
        shared = -(-percent * n // 100)  # with any set that is alike; the least of a partner's size, too
        small = self.matched(percent)
        small = small[shared[small] < BANDED]
        count = (n - shared + 1)[small]
        first = np.repeat(self.at[:-1][small] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        keys.append(W.mix(self.values[first] + np.uint64(BANDS + 1)))
        owners.append(np.repeat(small, count))
        return np.concatenate(keys), np.concatenate(owners)


def _emit_bands(percent: int):
    """(key, id, n): n of the band that is the whole set counts paragraphs; 0 in the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                found = _Paragraphs(piece)
                key, owner = found.bands(percent)
                pair = np.stack([key.view(np.int64), found.ids[owner].view(np.int64)], 1)
                n = np.zeros(len(pair), np.int64)
                n[: len(found.ids)] = 1
                order = np.lexsort((pair[:, 1], pair[:, 0]))
                pair, n = pair[order], n[order]
                first = np.flatnonzero(np.append(True, (pair[1:] != pair[:-1]).any(1))[: len(pair)])
                n = np.add.reduceat(n, first) if len(first) else n
                yield pa.RecordBatch.from_arrays([pa.array(pair[first, 0]), pa.array(pair[first, 1]), pa.array(n)], names=["key", "id", "n"])

    return run


def _pair_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key and id: pairs of different ids of a key, and (id, id) if it repeats.

    far marks (id, id) of a set that may have others of its band further off, here or beyond the range.
    """
    key, ids, n = (np.empty(0, np.int64) for _ in range(3))
    lead_key = lead = first_key = None
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        ids = np.concatenate([ids, batch.column(1).to_numpy()])
        n = np.concatenate([n, batch.column(2).to_numpy()])
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1]))[: len(key)])
        if len(first):
            key, ids, n = key[first], ids[first], np.add.reduceat(n, first)
        start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        head = np.repeat(ids[start], np.diff(np.append(start, len(key))))
        if lead_key is not None and len(key):
            head = np.where(key == lead_key, lead, head)
        a, b = [ids[n > 1], head], [ids[n > 1], ids]
        for d in range(1, min(WINDOW, max(0, len(key) - 1)) + 1):
            i = np.flatnonzero(key[:-d] == key[d:])
            a.append(ids[i])
            b.append(ids[i + d])
        a, b = np.concatenate(a), np.concatenate(b)
        kept = (a != b) | (np.arange(len(a)) < (n > 1).sum())
        yield _found(np.minimum(a, b)[kept], np.maximum(a, b)[kept], False)
        if len(key):
            first_key = key[0] if first_key is None else first_key
            lead_key, lead = key[-1], head[-1]
            i = np.flatnonzero(key[: -WINDOW - 1] == key[WINDOW + 1 :])
            far = ids[np.unique(np.concatenate([i, i + WINDOW + 1, np.flatnonzero(key == first_key)]))]
            yield _found(far, far, True)
        key, ids, n = key[-WINDOW - 1 :], ids[-WINDOW - 1 :], n[-WINDOW - 1 :]
    if len(key):
        far = ids[key == key[-1]]
        yield _found(far, far, True)


def _found(a: np.ndarray, b: np.ndarray, far: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), far))], names=["a", "b", "far"])


def _emit_sets(percent: int):
    """(id, shingles) of the paragraphs that another set can be like, each set once a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in W.pieces(batch, "text"):
                found = _Paragraphs(piece)
                rows = found.matched(percent)
                rows = rows[np.unique(found.ids[rows], return_index=True)[1]]
                lists = pa.ListArray.from_arrays(pa.array(found.at, pa.int32()), pa.array(found.values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(found.ids[rows].view(np.int64)), lists.take(pa.array(rows))], names=["id", "shingles"])

    return run


def _emit_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in W.pieces(batch, "text"):
            found = _Paragraphs(piece)
            yield pa.RecordBatch.from_arrays(
                [W.column(piece, "doc_id").take(pa.array(found.text)), pa.array(found.start), pa.array(found.length), pa.array(found.ids.view(np.int64))],
                names=["doc_id", "start", "n_words", "id"],
            )


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    a = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    near = pairs.select("a", "b").join(a, "a").join(b, "b").withColumn("both", both)
    return near.where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def passages_of(places: DataFrame, min_run: int) -> DataFrame:
    """The places (doc_id, start, n_words) that lie in a run of min_run words or more, with the run's first
    word and number of words. Places of one document that touch or overlap are a run; a window holds the
    places of one document."""
    end = F.col("start") + F.col("n_words")
    in_order = Window.partitionBy("doc_id").orderBy("start")
    before = F.max(end).over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    begins = places.withColumn("begins", F.when(F.coalesce(F.col("start") > before, F.lit(True)), F.col("start")))
    runs = begins.withColumn("run_start", F.max("begins").over(in_order.rangeBetween(Window.unboundedPreceding, 0))).drop("begins")
    run_words = F.max(end).over(Window.partitionBy("doc_id", "run_start")) - F.col("run_start")
    return runs.withColumn("run_words", run_words).where(F.col("run_words") >= min_run)


def repeated_passages(docs: DataFrame, percent: int = 80, min_run: int = MIN_RUN) -> DataFrame:
    """doc_id, start, n_words, cluster_id, removed, run_start, run_words: the paragraphs of passages that repeat.

    start: the first word's number in the text; run_start and run_words: the passage's. Paragraphs are alike if 100 * intersection >= percent *
    union of their shingle sets, or by a chain of such. One place of each cluster stays, that of the
    smallest doc_id (NULL before all), then start; the others are marked removed. Repeated rows give the
    same places and are not told apart, and texts with a NULL doc_id count as one. A run of one repeated word is one paragraph. NULL and short texts have no paragraphs; no rows, no passages.
    """
    reach(docs.sparkSession)
    texts = docs.select("text").where("text IS NOT NULL")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bands = texts.mapInArrow(_emit_bands(percent), "key bigint, id bigint, n bigint")
    bands = bands.repartitionByRange(parts, "key", "id").sortWithinPartitions("key", "id")
    found = materialise(bands.mapInArrow(_pair_up, "a bigint, b bigint, far boolean").distinct(), "passages")
    pairs = found.where("a <> b")
    ends = found.where("a <> b OR far").select(F.explode(F.array("a", "b")).alias("id"))
    ends = materialise(ends.distinct(), "passage-ends")
    sets = texts.mapInArrow(_emit_sets(percent), "id bigint, shingles array<bigint>").join(ends, "id", "left_semi")
    sets = materialise(sets.groupBy("id").agg(F.first("shingles").alias("shingles")), "passage-sets")
    near = materialise(_confirmed(pairs, sets, percent), "passage-links")
    groups = materialise(components(near), "passage-groups")
    dense = sets.join(found.where("far").select(F.col("a").alias("id")), "id", "left_semi").join(groups.withColumnRenamed("node", "id"), "id", "left")
    dense = materialise(dense.select("id", F.coalesce("root", "id").alias("group"), F.col("shingles").alias("elements")), "passage-dense")
    groups = components(near.unionByName(_confirmed(candidate_pairs(dense, percent), sets, percent)))
    exact = found.where("a = b AND NOT far").select(F.col("a").alias("id"))
    known = groups.withColumnRenamed("node", "id")
    known = materialise(known.unionByName(exact.join(known, "id", "left_anti").withColumn("root", F.col("id"))), "passage-groups")

    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("start", "n_words", "id")])
    places = docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(_emit_places, schema)
    places = places.join(known, "id").select("doc_id", "start", "n_words", F.col("root").alias("cluster_id"))
    places = materialise(passages_of(places, min_run), "places")
    first = places.groupBy("cluster_id").agg(F.min(F.struct("doc_id", "start")).alias("first"))
    marked = lookup_join(places, first, "cluster_id", heavy_keys(places, "cluster_id"), "inner", "doc_id")
    removed = ~F.struct("doc_id", "start").eqNullSafe(F.col("first"))
    return marked.select("doc_id", "start", "n_words", "cluster_id", removed.alias("removed"), "run_start", "run_words")
