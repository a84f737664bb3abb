"""Token sequences for training in several context lengths, without padding.

Documents are routed to tiers by length. Windows are filled from the longest tier down: a document opens a
window of its tier, the gap takes the longest documents of shorter tiers that fit whole, and what then
remains is filled by the head of the shortest document that is long enough, whose rest goes back to its
tier. Full windows are dealt to step groups of equal tokens, so that every step has the same mix of tiers.

Each task packs its own documents, a chunk at a time; no text is shuffled. What fills no whole step, less than
one step's tokens a chunk, goes one level up, where the remains of FAN chunks are packed together, and so on
until one group is left. Only the very last window may be short.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from dirgauge.llm import reach
from dirgauge.llm import words as W
from dirgauge.session import scratch_path

TIERS = (256, 512, 1024, 2048)
#: Tokens of a step group, a multiple of the longest tier.
STEP = 16 * 2048
END = 1
#: Bytes of text that are encoded and packed together.
CHUNK_BYTES = 4 << 20
#: Units of text among which each is encoded once, and bytes of them in one call.
UNITS, PART_BYTES = 1 << 20, 1 << 18
#: Chunks whose remains are packed together, one level up.
FAN = 64

_TOKENIZERS: dict = {}


def tokenizer_of(path: str | None) -> tuple[Tokenizer, tiktoken.Encoding | None]:
    """The tokenizer of a file. The default one comes with the same vocabulary as a rank file, which a
    faster library reads."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        ranks = None
        if path is None:
            with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        special = {t.content: k for k, t in tokenizer.get_added_tokens_decoder().items()}
        fast = ranks and tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        _TOKENIZERS[path] = tokenizer, fast
    return _TOKENIZERS[path]


#: Blanks, and the bytes that a character before a cut may end with.
_BYTES = np.arange(256)
_BLANK = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
_PLAIN = (_BYTES >= 0x21) & (_BYTES <= 0x7E)
_LEAD_2 = (_BYTES >= 0xC3) & (_BYTES <= 0xDF)
#: ASCII, and what the letters from U+00C0 to U+024F are made of.
_LATIN = _PLAIN | _BLANK | (_BYTES >= 0x80) & (_BYTES <= 0xBF) | (_BYTES >= 0xC3) & (_BYTES <= 0xC8)
#: Most bytes of a unit for the faster library.
LONG = 512
_LEAD_3 = (_BYTES == 0xE0) | ((_BYTES >= 0xE4) & (_BYTES <= 0xEF))


def _units(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where units of the texts begin, and the end: at a blank behind a character that is none.

    A pre-token always begins there, so units encode on their own as they do in the text. Characters are
    taken for none if that is sure from their bytes: ASCII ones, and those of two or three bytes whose first
    byte no blank has. Elsewhere a unit goes on.
    """
    cut = np.zeros(len(raw), bool)
    cut[1:] = _PLAIN[raw[:-1]]
    cut[2:] |= _LEAD_2[raw[:-2]] & (raw[1:-1] >= 0x80)
    cut[3:] |= _LEAD_3[raw[:-3]] & (raw[1:-2] >= 0x80) & (raw[2:-1] >= 0x80)
    cut &= _BLANK[raw]
    cut[at[:-1][at[:-1] < at[1:]]] = True
    return np.append(np.flatnonzero(cut), len(raw))


def _is_surely_no_blank(raw: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends there is known not to be a blank."""
    sure = _PLAIN[raw[ends - 1]]
    for size, lead in ((2, _LEAD_2), (3, _LEAD_3)):
        long = ends >= size
        tail = np.ones(long.sum(), bool)
        for k in range(1, size):
            tail &= raw[ends[long] - k] >= 0x80
        sure[long] |= tail & lead[raw[ends[long] - size]]
    return sure


class Encoder:
    """Texts to ids. Every distinct unit of a run of texts is encoded once."""

    def __init__(self, path: str | None = None, end: int = END):
        (self.tokenizer, self.fast), self.end = tokenizer_of(path), end
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, k in vocabulary.items():  # a character of a token stands for a byte
            self.bytes_of[k] = len(token)

    def _run(self, texts: list[str], fast: bool = False) -> list[np.ndarray]:
        if fast:
            return [np.array(self.fast.encode(t, allowed_special="all"), np.uint32) for t in texts]
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_units(self, units: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and how many each unit has.

        Units from a blank to a character that is none are encoded as one text, in which they stay apart as
        they are in theirs; the bytes of the tokens tell which belong to which.
        """
        raw, at = W.flat(units)
        joined = _BLANK[raw[at[:-1]]] & _is_surely_no_blank(raw, at[1:])
        counts, where = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64)
        ids, place = [], 0
        if not joined.all():
            alone = self._run(units.filter(pa.array(~joined)).to_pylist())
            counts[~joined] = [len(x) for x in alone]
            ids, place = alone, sum(map(len, alone))
            where[~joined] = np.cumsum(counts[~joined]) - counts[~joined]
        # both libraries take ASCII and Latin letters alike in any version of Unicode; long units are left to the one
        known = np.logical_and.reduceat(_LATIN[raw], at[:-1]) & (np.diff(at) <= LONG) if self.fast and len(raw) else np.zeros(len(units), bool)
        for fast in (True, False):
            rows = np.flatnonzero(joined & (known == fast))
            ends = np.cumsum((at[1:] - at[:-1])[rows])
            for part in np.split(rows, np.searchsorted(ends, np.arange(PART_BYTES, ends[-1], PART_BYTES))) if len(rows) else []:
                if not len(part):
                    continue
                text, to = W.flat(units.take(pa.array(part)))
                found = self._run([text.tobytes().decode()], fast)[0]
                many = np.diff(np.searchsorted(np.cumsum(self.bytes_of[found]), to, "right"), prepend=0)[1:]
                counts[part] = many
                where[part] = np.cumsum(many) - many + place
                ids.append(found)
                place += len(found)
        return np.concatenate([*ids, np.empty(0, np.uint32)]), np.stack([where, counts])

    def __call__(self, column: pa.Array) -> list[np.ndarray]:
        """The ids of each text (NULL: none) and then `end`."""
        raw, at = W.flat(column)
        bounds = _units(raw, at)
        data, parts, sizes = pa.py_buffer(np.ascontiguousarray(raw)), [], [np.empty(0, np.int64)]
        for first in range(0, len(bounds) - 1, UNITS):
            offsets = bounds[first : first + UNITS + 1].astype(np.int64)
            coded = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), data).dictionary_encode()
            flat, (where, counts) = self._encode_units(coded.dictionary)
            code = coded.indices.to_numpy()
            size = counts[code]
            parts.append(flat[np.repeat(where[code] - (np.cumsum(size) - size), size) + np.arange(size.sum())])
            sizes.append(size)
        ids = np.concatenate([*parts, np.empty(0, np.uint32)])
        before = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        ends = before[np.searchsorted(bounds, at)]
        last = np.array([self.end], np.uint32)
        return [np.concatenate([ids[a:b], last]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def fill(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, [(document, start, length)]), longest tier first, for documents of these lengths.

    All windows are full but the last, if the tokens run out. Every token is in exactly one piece.
    """
    top, windows = tiers[-1], []
    stacks: list[list[tuple[int, int]]] = [[] for _ in range(top + 1)]
    held = 0  # bit n: there are documents, or rests, of n tokens

    def put(document: int, start: int, n: int) -> None:
        nonlocal held
        stacks[n].append((document, start))
        held |= 1 << n

    def take(n: int) -> tuple[int, int, int]:
        nonlocal held
        document, start = stacks[n].pop()
        if not stacks[n]:
            held &= ~(1 << n)
        return document, start, n

    for document, n in reversed(list(enumerate(lengths))):
        whole = n // top
        windows += [(top, [(document, k * top, top)]) for k in range(whole)]
        if n % top:
            put(document, whole * top, n % top)
    for below, tier in reversed(list(zip((0, *tiers), tiers))):
        while (longest := held.bit_length() - 1) > below:
            window, gap = [take(longest)], tier - longest
            while gap:
                if fits := held & ((1 << (gap + 1)) - 1):
                    window.append(take(fits.bit_length() - 1))
                elif held:
                    document, start, n = take((held & -held).bit_length() - 1)
                    window.append((document, start, gap))
                    put(document, start + gap, n - gap)
                else:
                    break
                gap -= window[-1][2]
            windows.append((tier, window))
    return windows


def steps(windows: list, step: int, last: bool) -> tuple[list[list], list]:
    """Groups of windows with `step` tokens each, and the windows left over; with `last` they are groups too.

    Lengths fall by halves, so room in a group is always a multiple of the next window, and the
    emptiest group always takes it. A short window is never in a full group.
    """
    size = [sum(p[2] for p in w) for _, w in windows]
    full = [k for k, (tier, _) in enumerate(windows) if size[k] == tier]
    groups: list[list] = [[] for _ in range(sum(size[k] for k in full) // step)]
    heap = [(0, g) for g in range(len(groups))]
    taken = set()
    for k in full:
        if not heap:
            break
        filled, g = heapq.heappop(heap)
        groups[g].append(windows[k])
        taken.add(k)
        if filled + size[k] < step:
            heapq.heappush(heap, (filled + size[k], g))
    rest = [w for k, w in enumerate(windows) if k not in taken]
    if last and rest:  # fewer tokens than one step, the short window among them
        groups, rest = [*groups, rest], []
    return groups, rest


def _rows(groups: list, rest: list, ids: list[np.ndarray], start: np.ndarray, total: np.ndarray, docs: pa.Array, number: int, level: int, part: int) -> pa.RecordBatch:
    """The pieces of closed groups, then the open ones. `start` and `total`: where each item begins in its
    document, and that document's tokens."""
    which, at, offset, sequence, context, group = [], [], [], [], [], []
    for g, windows in [*enumerate(groups), *[(None, [w]) for w in rest]]:
        for tier, window in windows:
            place = 0
            for item, begin, n in window:
                which.append(item)
                at.append((begin, begin + n))
                offset.append(place)
                sequence.append(None if g is None else number)
                context.append(tier)
                group.append(None if g is None else g)
                place += n
            number += g is not None
    pieces = [ids[i][a:b] for i, (a, b) in zip(which, at)]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces])]).astype(np.int64) * 4
    flat = np.concatenate(pieces).astype("<u4") if pieces else np.empty(0, "<u4")
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
    items, begin = np.array(which, np.int64), np.array([a for a, _ in at], np.int64)
    high = (level << 59) + (part << 31)
    columns = {
        "doc_id": docs.take(pa.array(items)),
        "start": pa.array(start[items] + begin),
        "length": pa.array(np.array([len(p) for p in pieces], np.int64)),
        "ids": packed.cast(pa.binary()),
        "doc_tokens": pa.array(total[items]),
        "sequence_id": pa.array([None if s is None else high + s for s in sequence], pa.int64()),
        "offset": pa.array(np.array(offset, np.int64)),
        "context": pa.array(np.array(context, np.int32)),
        "step_group": pa.array([None if g is None else high + g for g in group], pa.int64()),
        "part": pa.array(np.full(len(pieces), part, np.int64)),
        "place": pa.array(np.arange(len(pieces))),
        "open": pa.array([g is None for g in group], pa.bool_()),
    }
    return pa.RecordBatch.from_pydict(columns)


_FIELDS = [
    ("start", T.LongType()),
    ("length", T.LongType()),
    ("ids", T.BinaryType()),
    ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()),
    ("offset", T.LongType()),
    ("context", T.IntegerType()),
    ("step_group", T.LongType()),
    ("part", T.LongType()),
    ("place", T.LongType()),
    ("open", T.BooleanType()),
]


def pack(
    docs: DataFrame,
    tiers: tuple[int, ...] = TIERS,
    step: int = STEP,
    tokenizer_path: str | None = None,
    end: int = END,
) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset, context, step_group per piece of `docs`
    (doc_id, text; more may be there).

    A document is its ids and then `end`; a NULL text is empty. ids: the piece as little-endian unsigned
    32-bit numbers; start: ids of the document before it; offset: its place in the sequence, which has
    `context` tokens, the last one perhaps fewer. Every step_group but the last has `step` tokens. tiers
    double from one to the next, and `step` is a multiple of the last. Repeated rows are packed each; a NULL
    doc_id is kept. No rows give no pieces.

    The default tokenizer is that of `public_tokenizers`, looked up where the task runs.
    """
    spark = reach(docs.sparkSession)
    kind = docs.schema["doc_id"]
    schema = T.StructType([T.StructField("doc_id", kind.dataType)] + [T.StructField(n, t) for n, t in _FIELDS])

    def first_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, chunk, number, made, held, size = TaskContext.get().partitionId(), 0, 0, 0, [], 0
        encode = Encoder(tokenizer_path, end)

        def close() -> pa.RecordBatch:
            nonlocal number, made, chunk
            table = pa.Table.from_batches(held).combine_chunks()
            ids = encode(table.column("text").combine_chunks())
            lengths = [len(x) for x in ids]
            groups, rest = steps(fill(lengths, tiers), step, False)
            zero, total = np.zeros(len(ids), np.int64), np.array(lengths, np.int64)
            out = _rows(groups, rest, ids, zero, total, table.column("doc_id").combine_chunks(), number, 0, part)
            for name, more in (("step_group", made), ("place", chunk << 40)):  # counted on within the task
                at = out.schema.get_field_index(name)
                out = out.set_column(at, name, pc.add(out.column(at), more))
            number, made, chunk = number + sum(len(g) for g in groups), made + len(groups), chunk + 1
            return out

        for batch in batches:
            for piece in W.pieces(batch, "text"):
                held.append(piece)
                size += len(W.flat(W.column(piece, "text"))[0]) + 64 * piece.num_rows
                if size >= CHUNK_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    path = scratch_path(spark, "packed")

    def store(pieces: DataFrame, level: int) -> None:
        pieces.write.partitionBy("open").parquet(f"{path}/level={level}")

    def stored(level: int, is_open: bool) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{path}/level={level}").where(F.col("open") == is_open)

    store(docs.select("doc_id", "text").mapInArrow(first_level, schema), 0)
    level, parts = 0, None
    while True:
        chunk = F.shiftright("place", 40)
        remains = stored(level, True)
        chunks = remains.select("part", chunk.alias("chunk")).distinct().count()
        if not chunks:
            break
        level, parts = level + 1, -(-chunks // FAN)
        group = F.pmod(F.xxhash64("part", chunk), F.lit(parts)).alias("group")
        store(remains.select(group, *schema.names).groupBy("group").applyInArrow(_next_level(level, parts == 1, tiers, step), schema), level)
        if parts == 1:
            break
    out = stored(0, False)
    for k in range(1, level + 1):
        out = out.unionByName(stored(k, False))
    return out.select("doc_id", *[n for n, _ in _FIELDS[:8]])


def _next_level(level: int, last: bool, tiers: tuple[int, ...], step: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("place", "ascending")]).combine_chunks()
        ids = [np.frombuffer(x, "<u4") for x in table.column("ids").to_pylist()]
        groups, rest = steps(fill([len(x) for x in ids], tiers), step, last)
        start, total = (table.column(c).to_numpy() for c in ("start", "doc_tokens"))
        docs = table.column("doc_id").combine_chunks()
        return pa.Table.from_batches([_rows(groups, rest, ids, start, total, docs, 0, level, table.column("group")[0].as_py())])

    return run
