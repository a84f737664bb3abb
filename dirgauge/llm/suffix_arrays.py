"""Benchmark decontamination with suffix arrays of the training text.

Each task builds suffix arrays over the words of its documents, a few megabytes of text at a time, and
every suffix of the benchmark is found in them by binary search. Words that occur in no benchmark item
end every match, so suffixes that start with one are left out, and an order as deep as the longest item
is enough. The benchmark reaches the tasks in blocks of bounded size; a larger one takes more passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.llm import reach
from dirgauge.llm import words as W

WINDOW = 13
#: Text of one block of the benchmark, which every task holds.
BLOCK_BYTES = 8 << 20


@dataclass
class Block:
    """Some benchmark items: the word numbers of all, one 0 after each item."""

    names: list[str]
    vocabulary: np.ndarray
    tokens: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @staticmethod
    def of(names: list[str], texts: list[str | None]) -> Block:
        raw, at = W.flat(pa.array(texts, pa.string()))
        found = W.split_words(raw, at, W.ALNUM, True)
        vocabulary, number = np.unique(found.hashes, return_inverse=True)
        n = len(names)
        tokens = np.zeros(len(number) + n, np.int64)
        tokens[np.arange(len(number)) + found.text_of_word()] = number + 1
        return Block(names, vocabulary, tokens, found.offsets[:-1] + np.arange(n), np.diff(found.offsets))

    def suffixes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, first token and length of every suffix of every item."""
        item = np.repeat(np.arange(len(self.names)), self.lengths)
        skip = np.arange(len(item)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        return item, self.starts[item] + skip, self.lengths[item] - skip

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Suffixes of at least WINDOW words, cut there; of a shorter item the whole."""
        item, start, length = self.suffixes()
        whole = (self.lengths[item] < WINDOW) & (start == self.starts[item])
        kept = (length >= WINDOW) | whole
        return item[kept], start[kept], np.minimum(length[kept], WINDOW)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    names: list[str] = []
    texts: list[str | None] = []
    held = 0
    for name, text in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        names.append("" if name is None else name)
        texts.append(text)
        held += len(text or "") + 16
        if held >= block_bytes:
            yield Block.of(names, texts)
            names, texts, held = [], [], 0
    if names:
        yield Block.of(names, texts)


class SuffixArray:
    """Suffixes of `tokens` (0 ends a suffix), in order of their first `depth` tokens."""

    def __init__(self, tokens: np.ndarray, largest: int, depth: int):
        self.bits = max(1, int(largest).bit_length())
        self.per = max(1, 62 // self.bits)
        self.tokens = np.concatenate([tokens, np.zeros(self.per + depth + 1, np.int64)])
        n = len(tokens)
        self.packed, alive = np.zeros(n + depth + 1, np.int64), np.ones(n + depth + 1, bool)
        for i in range(self.per):
            value = self.tokens[i : i + len(alive)]
            alive &= value > 0
            self.packed = (self.packed << self.bits) | np.where(alive, value, 0)
        self.full = alive
        at = np.flatnonzero(tokens > 0)
        order = np.argsort(self.packed[at], kind="stable")
        at = at[order]
        value = self.packed[at]
        new = np.ones(len(at), bool)
        new[1:] = value[1:] != value[:-1]
        open_ = self.full[at]
        for done in range(self.per, depth, self.per):
            group = np.cumsum(new)
            size = np.bincount(group)
            slots = np.flatnonzero(open_ & (size[group] > 1))
            if not len(slots):
                break
            members = at[slots]
            deeper = self.packed[members + done]
            turn = np.lexsort((deeper, group[slots]))
            at[slots], deeper = members[turn], deeper[turn]
            same = np.zeros(len(slots), bool)
            same[1:] = (group[slots][1:] == group[slots][:-1]) & (deeper[1:] == deeper[:-1])
            new[slots] = ~same
            open_ = np.zeros(len(at), bool)
            open_[slots] = self.full[at[slots] + done]
        self.at = at

    def pattern(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the packed values that begin with `tokens` from `skip` on, of one column."""
        low = np.zeros(len(starts), np.int64)
        left = np.clip(lengths - skip, 0, self.per)
        padded = np.concatenate([tokens, np.zeros(self.per, np.int64)])
        for i in range(self.per):
            low = (low << self.bits) | np.where(i < left, padded[np.minimum(starts + skip + i, len(padded) - 1)], 0)
        return low, low + (np.int64(1) << ((self.per - left) * self.bits))

    def _bisect(self, low: np.ndarray, high: np.ndarray, value: np.ndarray, done: int) -> np.ndarray:
        low, high = low.copy(), high.copy()
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            less = open_.copy()
            less[open_] = self.packed[self.at[middle[open_]] + done] < value[open_]
            low = np.where(less, middle + 1, low)
            high = np.where(open_ & ~less, middle, high)
        return low

    def find(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of suffixes that begin with each pattern; an empty range is where it would stand."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.at), np.int64)
        for done in range(0, int(lengths.max(initial=0)), self.per):
            i = np.flatnonzero((lengths > done) & (low < high))
            if not len(i):
                break
            first, last = self.pattern(tokens, starts[i], lengths[i], done)
            a, b = low[i], high[i]
            low[i] = self._bisect(a, b, first, done)
            high[i] = self._bisect(low[i], b, last, done)
        return low, high

    def longest(self, tokens: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length and place of the longest match of each pattern's beginning (0: none)."""
        low, _ = self.find(tokens, starts, lengths)
        best, place = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.at):
            return best, place
        for side in (low - 1, low):
            there = (side >= 0) & (side < len(self.at))
            at = self.at[np.clip(side, 0, len(self.at) - 1)]
            common, i = np.zeros(len(starts), np.int64), np.flatnonzero(there & (lengths > 0))
            while len(i):
                k = common[i]
                i = i[(k < lengths[i]) & (tokens[np.minimum(starts[i] + k, len(tokens) - 1)] == self.tokens[at[i] + k])]
                common[i] += 1
            better = common > best
            best, place = np.where(better, common, best), np.where(better, at, place)
        return best, place


def _shards(batch: pa.RecordBatch, text: pa.Array, block: Block):
    """Pieces of a batch with their suffix arrays: (first row, words, text of each token, array)."""
    depth = int(block.lengths.max(initial=1))
    only = pa.RecordBatch.from_arrays([text], names=["text"])
    first = 0
    for piece in W.pieces(only, "text"):
        raw, at = W.flat(piece.column(0))
        found = W.split_words(raw, at, W.ALNUM, True)
        owner = found.text_of_word()
        tokens = np.zeros(len(owner) + piece.num_rows, np.int64)
        if len(block.vocabulary):
            number = np.minimum(np.searchsorted(block.vocabulary, found.hashes), len(block.vocabulary) - 1)
            tokens[np.arange(len(owner)) + owner] = np.where(block.vocabulary[number] == found.hashes, number + 1, 0)
        yield first, found, SuffixArray(tokens, len(block.vocabulary), depth)
        first += piece.num_rows


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_MARKS = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _marker(block: Block, keep: list[str]):
    item, start, length = block.windows()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = W.column(batch, "row")
            fields = {n: row.field(n) for n in [*keep, "text"]}
            n_words = np.zeros(batch.num_rows, np.int64)
            spans = [[(s["start"], s["end"]) for s in x] for x in W.column(batch, "spans").to_pylist()]
            items = W.column(batch, "items").to_pylist()
            for first, found, array in _shards(batch, fields["text"], block):
                rows = len(found.offsets) - 1
                n_words[first : first + rows] = np.diff(found.offsets)
                low, high = array.find(block.tokens, start, length)
                count = high - low
                hit = np.flatnonzero(count > 0)
                if not len(hit):
                    continue
                window = np.repeat(hit, count[hit])
                begun = np.cumsum(count[hit]) - count[hit]
                token = array.at[np.repeat(low[hit] - begun, count[hit]) + np.arange(len(window))]
                text_start = found.offsets[:-1] + np.arange(rows)
                text = np.searchsorted(text_start, token, "right") - 1
                at = token - text_start[text]
                for t, i in np.unique(np.stack([text, item[window]]), axis=1).T.tolist():
                    items[first + t].append(block.names[i])
                places = np.unique(np.stack([text, at, at + length[window]]), axis=1)
                turns = np.flatnonzero(np.diff(places[0], prepend=-1))
                for t, mine in zip(places[0][turns].tolist(), np.split(places, turns[1:], axis=1)):
                    spans[first + t] = _merge(spans[first + t] + list(zip(mine[1].tolist(), mine[2].tolist())))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.StructArray.from_arrays([fields[n] for n in keep], names=keep),
                    pa.array(n_words),
                    pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], W.column(batch, "spans").type),
                    pa.array([sorted(set(x)) for x in items], W.column(batch, "items").type),
                ],
                names=["row", "n_words", "spans", "items"],
            )

    return run


def mark_contaminated(docs: DataFrame, benchmark: DataFrame, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of `docs`: `row` (a struct of the columns in `keep`), n_words, spans, items.

    spans: merged runs of words (start, end) that lie in an occurrence of a window of `benchmark`
    (item_id, text); items: the sorted names of the items with such windows. NULL texts have no words.
    Items without words have no windows; a NULL item_id is named ''; repeated items count once.
    """
    reach(docs.sparkSession)
    both = list(dict.fromkeys([*keep, "text"]))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in both]).alias("row"),
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    schema = lambda names: T.StructType(
        [T.StructField("row", T.StructType([docs.schema[c] for c in names]))]
        + T.StructType.fromDDL(_MARKS).fields
    )
    parts = list(blocks(benchmark, block_bytes)) or [Block.of([], [])]
    for i, block in enumerate(parts):
        names = keep if i == len(parts) - 1 else both
        rows = rows.mapInArrow(_marker(block, names), schema(names))
    return rows


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated() -> Column:
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the contaminated: those with a twentieth of their words or more in matches."""
    marked = mark_contaminated(docs, benchmark, docs.columns)
    return marked.where(~is_contaminated()).select("row.*")


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, start, length, doc_id, position) for every suffix of every item that matches at all.

    length: words of the longest verbatim match of the suffix's beginning in any document; doc_id and
    position (word): where it is found, ties to the smallest. item_id is given as string.
    """
    reach(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_id", kind), T.StructField("position", T.LongType())]
    )

    def finder(block: Block):
        item, start, length = block.suffixes()

        def run(batches):
            for batch in batches:
                for first, found, array in _shards(batch, W.column(batch, "text"), block):
                    best, place = array.longest(block.tokens, start, length)
                    hit = np.flatnonzero(best > 0)
                    text_start = found.offsets[:-1] + np.arange(len(found.offsets) - 1)
                    text = np.searchsorted(text_start, place[hit], "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block.names[i] for i in item[hit]], pa.string()),
                            pa.array(start[hit] - block.starts[item[hit]]),
                            pa.array(best[hit]),
                            W.column(batch, "doc_id").take(pa.array(first + text)),
                            pa.array(place[hit] - text_start[text]),
                        ],
                        names=[f.name for f in schema.fields],
                    )

        return run

    found = None
    for block in blocks(benchmark, block_bytes):
        part = docs.select("doc_id", "text").mapInArrow(finder(block), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], schema)
    best = F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "position")).alias("b")
    return found.groupBy("item_id", "start").agg(best).select(
        "item_id", "start", (-F.col("b.less")).alias("length"), "b.doc_id", "b.position"
    )
