"""Token counts that follow edits: a segment tree over the pre-tokens of each document.

A text is split into pre-tokens, each of which a tokenizer encodes on its own. The leaves of a
document's tree are the code points and tokens of its pre-tokens. An edit re-splits only the text it
touches, from a pre-token before it to where the new split meets the old one again; the new leaves
replace the old, and sums are updated on the way to the root.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.llm import reach
from dirgauge.llm import words as W

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pre-token rule of the tokenizer's family (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens whose count a task remembers.
REMEMBERED = 1_000_000
#: Pre-tokens of one leaf block.
BLOCK = 64

_COUNTERS: dict[str, Counter] = {}


class Counter:
    """Tokens of single pre-tokens, remembered."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN).findall
        self.match = regex.compile(PATTERN).match
        self.known: dict[str, int] = {}

    def __call__(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.known[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    @staticmethod
    def of(ranks_path: str) -> Counter:
        if ranks_path not in _COUNTERS:
            _COUNTERS[ranks_path] = Counter(ranks_path)
        return _COUNTERS[ranks_path]


class Tree:
    """A balanced tree of (code points, tokens) over blocks of pre-tokens; blocks may grow and shrink."""

    def __init__(self, text: str, counter: Counter):
        self.count = counter
        pieces = counter.split(text)
        self.blocks = [pieces[i : i + BLOCK] for i in range(0, len(pieces), BLOCK)] or [[]]
        self.width = 1 << (len(self.blocks) - 1).bit_length()
        self.points = [0] * (2 * self.width)
        self.tokens = [0] * (2 * self.width)
        self.encoded = 0
        for i, block in enumerate(self.blocks):
            self.points[self.width + i] = sum(map(len, block))
            self.tokens[self.width + i] = sum(map(counter, block))
        for i in range(self.width - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.points[i] = self.points[2 * i] + self.points[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for b in self.blocks for p in b)

    def _find(self, point: int) -> tuple[int, int]:
        """The block that holds the code point, and the code points before it."""
        i, before = 1, 0
        while i < self.width:
            i *= 2
            if before + self.points[i] <= point and self.points[i + 1]:
                before += self.points[i]
                i += 1
        return i - self.width, before

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace the code points from start to end (clipped to the text) by `new`."""
        start = max(0, min(start, self.points[1]))
        end = max(start, min(end, self.points[1]))
        first, before = self._find(max(0, start - 1))
        # pre-tokens look ahead one code point at most, so two whole ones before the edit are context enough
        while first > 0 and (before == start or sum(1 for _ in self._ahead(first, before, start)) < 2):
            first -= 1
            before -= self.points[self.width + first]
        flat, last = [], first
        covered = before
        while last < len(self.blocks) and (covered <= end or last == first):
            flat += self.blocks[last]
            covered += self.points[self.width + last]
            last += 1
        keep, at = 0, before
        while keep < len(flat) and at + len(flat[keep]) < start:
            at += len(flat[keep])
            keep += 1
        if keep:
            keep -= 1
            at -= len(flat[keep])
        rest = "".join(flat[keep:])
        fresh = rest[: start - at] + new + rest[end - at :]
        edge = start - at + len(new)
        # old pre-token starts behind the edit, in the new text's places
        shift, old, i = len(new) - (end - start), {}, at
        for k in range(keep, len(flat)):
            if i >= end + 1:
                old[i + shift - at] = k
            i += len(flat[k])
        made, place = [], 0
        while True:
            if place >= edge + 1 and place in old:
                tail = flat[old[place] :]
                break
            if place >= len(fresh):
                tail = []
                if last >= len(self.blocks):
                    break
                nxt = self.blocks[last]
                # the split ran up to the end of what was read: read on, from the last pre-token
                if made:
                    place -= len(made[-1])
                    made.pop()
                i = len(fresh)
                for k, piece in enumerate(nxt, len(flat)):
                    old[i] = k
                    i += len(piece)
                flat += nxt
                fresh += "".join(nxt)
                last += 1
                continue
            piece = self.count.match(fresh, place).group()
            made.append(piece)
            place += len(piece)
        self.encoded += len(made)
        self._replace(first, last, flat[:keep] + made + tail)

    def _ahead(self, first: int, before: int, start: int):
        for piece in self.blocks[first]:
            before += len(piece)
            if before >= start:
                return
            yield piece

    def _replace(self, first: int, last: int, pieces: list[str]) -> None:
        """Deal the pieces to the blocks from first to last and update the sums above them."""
        many = last - first
        size = -(-len(pieces) // many) if pieces else 0
        for k in range(many):
            block = pieces[k * size : (k + 1) * size]
            self.blocks[first + k] = block
            self.points[self.width + first + k] = sum(map(len, block))
            self.tokens[self.width + first + k] = sum(map(self.count, block))
        low, high = (self.width + first) // 2, (self.width + last - 1) // 2
        while low >= 1:
            for i in range(low, high + 1):
                self._sum(i)
            low, high = low // 2, high // 2


EDITS = "array<struct<start:bigint,end:bigint,text:string>>"


def recount(docs: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """doc_id, n_edits, n_tokens, n_tokens_after, n_reencoded per row of `docs` (doc_id, text, edits).

    edits: array of (start, end, text) in code points of the text as it is when the edit's turn comes;
    bounds are clipped to the text, a NULL bound is 0, a NULL text or edit inserts or does nothing. A
    NULL text is empty, NULL edits are none. n_reencoded: pre-tokens split anew by the edits.
    """
    reach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(ranks_path)
        for batch in batches:
            out = []
            for text, edits in zip(W.column(batch, "text").to_pylist(), W.column(batch, "edits").to_pylist()):
                edits = [e for e in edits or [] if e is not None]
                tree = Tree(text or "", counter)
                before = tree.total()
                for e in edits:
                    tree.edit(e["start"] or 0, e["end"] or 0, e["text"] or "")
                out.append((len(edits), before, tree.total(), tree.encoded))
            columns = np.array(out, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), *[pa.array(columns[:, i]) for i in range(4)]], names=[f.name for f in schema])

    schema = T.StructType([docs.schema["doc_id"]] + [T.StructField(n, T.LongType()) for n in ("n_edits", "n_tokens", "n_tokens_after", "n_reencoded")])
    return docs.select("doc_id", "text", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(run, schema)


#: What the masking edits replace: addresses, and words with long runs of digits or capitals as keys have.
MASKED = r"[\w.+-]+@[\w-]+\.[\w.]+|\S*(?:\d{5,}|[A-Z0-9]{12,})\S*"
#: The same matches, tried only where one can begin: where a run or a word begins, or right after the match before.
#: So the time is linear in the length of a word.
_BEGINS = regex.compile(r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w-]++\.[\w.]+|(?:\G|(?<!\S))\S*(?:\d{5,}|[A-Z0-9]{12,})\S*", regex.ASCII)
#: Without one of these there is no match.
_HINT = re.compile(r"@|\d{5}|[A-Z0-9]{12}", re.ASCII)


def masked_spans(text: str) -> list[tuple[int, int]]:
    """Where `MASKED` matches in a text, from the left."""
    return [m.span() for m in _BEGINS.finditer(text)] if _HINT.search(text) else []


def masking_edits(docs: DataFrame, mask: str = "[masked]") -> DataFrame:
    """`docs` (doc_id, text) with the edits that mask addresses and keys, last place first.

    NULL and empty texts have no edits. Rows are taken one by one: repeated rows give repeated rows, an
    empty table an empty one, and other columns are left out.
    """
    reach(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"start": a, "end": b, "text": mask} for a, b in reversed(masked_spans(t or ""))] for t in W.column(batch, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([W.column(batch, "doc_id"), W.column(batch, "text"), pa.array(found, kind)], names=["doc_id", "text", "edits"])

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
    schema = T.StructType([docs.schema["doc_id"], docs.schema["text"], T.StructField("edits", T.DataType.fromDDL(EDITS))])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
