"""Words and word hashes of whole Arrow columns, inside tasks.

Texts are handled as UTF-8 bytes. A word is a maximal run of word bytes within one text; its hash is
64 bits wide and depends on the (folded) bytes alone. NULL counts as the empty text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of one piece of work; a longer text is a piece of its own and is never cut.
PIECE_BYTES = 1 << 20

_BYTES = np.arange(256)
#: `[^\x20\x09-\x0D]+`
NOT_SPACE = (_BYTES != 0x20) & ~((_BYTES >= 0x09) & (_BYTES <= 0x0D))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM = (
    ((_BYTES >= 0x30) & (_BYTES <= 0x39))
    | ((_BYTES >= 0x41) & (_BYTES <= 0x5A))
    | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
    | (_BYTES >= 0x80)
)

_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_VALUES = _VALUES.copy()
_LOWER_VALUES[0x41:0x5B] = _VALUES[0x61:0x7B]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each, from 0."""
    if pa.types.is_null(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    at = at.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Words:
    hashes: np.ndarray  # uint64, one per word
    starts: np.ndarray  # byte where the word starts
    ends: np.ndarray
    offsets: np.ndarray  # first word of each text, and the end

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))


def split_words(raw: np.ndarray, at: np.ndarray, word_bytes: np.ndarray, lower: bool) -> Words:
    inside = word_bytes[raw]
    full = at[:-1] < at[1:]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][full]] = False
    after[at[1:][full] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    offsets = np.searchsorted(starts, at)
    if not len(starts):
        return Words(np.empty(0, np.uint64), starts, ends, offsets)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    powers = np.multiply.accumulate(np.full(lengths.max(), _STEP, np.uint64))
    values = (_LOWER_VALUES if lower else _VALUES)[raw[inside]]
    values *= powers[np.arange(len(values)) - np.repeat(first, lengths)]
    return Words(mix(np.add.reduceat(values, first) + lengths.astype(np.uint64)), starts, ends, offsets)


def pieces(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about PIECE_BYTES of text each."""
    if not batch.num_rows:
        return
    _, at = flat(batch.column(batch.schema.get_field_index(text)))
    first = 0
    while first < batch.num_rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + PIECE_BYTES, "right")) - 1)
        yield batch.slice(first, last - first)
        first = last


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of `size`-word runs per text, sorted, and the offsets of each text.

    A text of fewer words, but not none, has its whole sequence as the one shingle.
    """
    n = np.diff(words.offsets)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(count)])
    if not at[-1]:
        return np.empty(0, np.uint64), at
    first = np.repeat(words.offsets[:-1] - at[:-1], count) + np.arange(at[-1])
    length = np.repeat(np.minimum(n, size), count)
    total = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    padded = np.concatenate([words.hashes, np.zeros(size, np.uint64)])
    scale = _STEP
    for i in range(size):
        total += np.where(length > i, padded[first + i], np.uint64(0)) * scale
        scale = np.uint64(int(scale) * 0x2545F4914F6CDD1D % 2**64)
    total = mix(total)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        total[a:b].sort()
    new = np.ones(len(total), bool)
    new[1:] = total[1:] != total[:-1]
    new[at[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return total[new], kept[at]
