"""Language identification by partial matching.

Every language has a tree of byte contexts of up to ORDER bytes with the counts of the byte that
follows. A text is coded with each tree: a byte seen in the longest known context costs by its share of
count, otherwise an escape is coded and the next shorter context decides, without the bytes already
excluded; the last resort is an even share of the bytes left (escape method C). The statistics are
frozen, so the exact code length of a byte depends on its ORDER predecessors alone and is looked up.
The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.llm import reach
from dirgauge.llm import words as W
from dirgauge.llm.grams import counter
from dirgauge.session import materialise

ORDER = 3


def _grams(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every byte its ORDER predecessors and itself, as one number; before a text lie line breaks."""
    n = len(at) - 1
    padded = np.full(len(raw) + ORDER * n, 10, np.uint8)
    place = np.arange(len(raw)) + ORDER * (np.repeat(np.arange(n), np.diff(at)) + 1)
    padded[place] = raw
    grams = padded[place].astype(np.uint32)
    for k in range(1, ORDER + 1):
        grams |= padded[place - k].astype(np.uint32) << np.uint32(8 * k)
    return grams, place


def train(docs: DataFrame) -> DataFrame:
    """Counts (lang, gram, n) over all rows of `docs` (text, lang) without NULL in either; none is left out."""
    reach(docs.sparkSession)
    rows = docs.select("text", F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    count = counter(lambda piece: _grams(*W.flat(W.column(piece, "text")))[0])
    parts = rows.mapInArrow(count, "lang string, gram bigint, n bigint")
    return materialise(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ppm")


class Coder:
    """Code lengths, in bits, of all languages."""

    def __init__(self, counts: pa.Table):
        lang = counts.column("lang").combine_chunks().dictionary_encode()
        names = np.array(lang.dictionary.to_pylist(), object)
        turn = np.argsort(names)
        self.langs = names[turn].tolist()
        rank = np.empty(len(turn), np.int64)
        rank[turn] = np.arange(len(turn))
        which = rank[lang.indices.to_numpy(zero_copy_only=False)] if len(names) else np.empty(0, np.int64)
        gram, n = counts.column("gram").to_numpy(), counts.column("n").to_numpy()
        self.trees = [_tree(gram[which == i], n[which == i]) for i in range(len(names))]
        #: Every gram of any tree, with its code in each; the rest is worked out when met.
        self.known = np.unique(gram).astype(np.uint32)
        self.bits = np.stack([_code(t, self.known) for t in self.trees], 1) if self.trees else np.empty((0, 0), np.float32)
        contexts, first = np.unique(self.known >> np.uint32(8), return_index=True)
        self.first = np.append(first, len(self.known))
        self.context = np.full(1 << (8 * ORDER), -1, np.int32)
        self.context[contexts] = np.arange(len(contexts))
        self.dense = len(contexts) <= 1 << 17
        if self.dense:
            self.place = np.full(len(contexts) << 8, -1, np.int32)
            self.place[(np.repeat(np.arange(len(contexts)), np.diff(self.first)) << 8) | (self.known & np.uint32(255))] = np.arange(len(self.known))

    def _find(self, grams: np.ndarray) -> np.ndarray:
        if not self.dense:
            at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
            return np.where(self.known[at] == grams, at, -1)
        context = self.context[grams >> np.uint32(8)]
        found = self.place[(np.maximum(context, 0).astype(np.int64) << 8) | (grams & np.uint32(255))]
        return np.where(context < 0, -1, found)

    def lengths(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Bits of each text (row) in each language (column)."""
        out = np.zeros((len(at) - 1, len(self.langs)))
        full = np.diff(at) > 0
        if not full.any() or not self.langs:
            return out
        grams, _ = _grams(raw, at)
        found = self._find(grams)
        odd = np.flatnonzero(found < 0)
        rare, back = np.unique(grams[odd], return_inverse=True)
        for i, tree in enumerate(self.trees):
            bits = self.bits[found, i]
            if len(odd):
                bits[odd] = _code(tree, rare)[back]
            out[full, i] = np.add.reduceat(bits, at[:-1][full], dtype=np.float64)
        return out


def _tree(gram: np.ndarray, n: np.ndarray) -> list[dict[str, np.ndarray]]:
    """Per order: sorted grams and counts, sorted contexts with the sum and number of their bytes, and
    the same for the next shorter context without the bytes that this one has seen."""
    levels = []
    turn = np.argsort(gram)
    gram, n = gram[turn], n[turn]
    for order in range(ORDER, -1, -1):
        context, first = np.unique(gram >> 8, return_index=True)
        level = {"gram": gram, "n": n, "context": context}
        level["sum"] = np.add.reduceat(n, first) if len(n) else n
        level["kinds"] = np.diff(np.append(first, len(gram)))
        levels.append(level)
        if order:
            short = gram & ((1 << (8 * order)) - 1)
            lower, back = np.unique(short, return_inverse=True)
            sums = np.bincount(back, n, len(lower)).astype(np.int64)
            contexts, begin = np.unique(lower >> 8, return_index=True)
            whole = np.add.reduceat(sums, begin) if len(sums) else sums
            kinds = np.diff(np.append(begin, len(lower)))
            own = np.searchsorted(contexts, context & ((1 << (8 * (order - 1))) - 1))
            seen = np.add.reduceat(sums[back], first) if len(n) else n
            level["rest_sum"], level["rest_kinds"] = whole[own] - seen, kinds[own] - level["kinds"]
            gram, n = lower, sums
    return levels


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _code(tree: list[dict[str, np.ndarray]], grams: np.ndarray) -> np.ndarray:
    """Exact bits of each gram's last byte after its context."""
    grams = grams.astype(np.int64)
    bits = np.zeros(len(grams))
    open_ = np.ones(len(grams), bool)
    begun = np.zeros(len(grams), bool)  # a context was found, and its shorter ones exclude bytes
    total, kinds = np.zeros(len(grams)), np.zeros(len(grams))
    for order, level in zip(range(ORDER, -1, -1), tree):
        gram = grams & ((1 << (8 * (order + 1))) - 1)
        node, known = _lookup(level["context"], gram >> 8)
        at, seen = _lookup(level["gram"], gram)
        if not len(level["gram"]):
            continue
        total = np.where(begun, total, level["sum"][node])
        kinds = np.where(begun, kinds, level["kinds"][node])
        here = open_ & known & (kinds > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            bits += np.where(here & seen, np.log2((total + kinds) / level["n"][at]), 0)
            bits += np.where(here & ~seen, np.log2((total + kinds) / kinds), 0)
        open_ &= ~(known & seen)
        begun |= known
        if order:
            total = np.where(known, level["rest_sum"][node], total)
            kinds = np.where(known, level["rest_kinds"][node], kinds)
    root = len(tree[-1]["gram"])
    return (bits + np.where(open_, np.log2(max(1, 256 - root)), 0)).astype(np.float32)


def predict(docs: DataFrame, counts: DataFrame, keep: list[str]) -> DataFrame:
    """One row per row of `docs` (text): `row` (a struct of the columns in `keep`), lang_pred, score, bits.

    score: the share of the winner's probability among all languages; ties go to the first by code
    point. Texts that are NULL or have no letter, and all texts if nothing was learned, are `und` with
    score 0. bits: code length per byte with the winner.

    All counts go to every task, 12 bytes for each run of ORDER + 1 bytes that a language has. Their number
    grows more slowly than the text, towards what a language spells; it is not cut.
    """
    spark = reach(docs.sparkSession)
    held = spark.sparkContext.broadcast(counts.toArrow())
    both = list(dict.fromkeys([*keep, "text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(held.value)  # about 150 MB that live as long as the task
        langs = np.array([*coder.langs, "und"], object)
        for batch in batches:
            for piece in W.pieces(pa.RecordBatch.from_arrays([*batch.columns, W.column(batch, "row").field("text")], names=["row", "letters", "text"]), "text"):
                raw, at = W.flat(W.column(piece, "text"))
                bits = coder.lengths(raw, at)
                known = W.column(piece, "letters").to_numpy(zero_copy_only=False) & bool(coder.langs)
                best = np.where(known, bits.argmin(1) if coder.langs else 0, len(coder.langs))
                if coder.langs:
                    least = bits.min(1)
                    score = 1 / np.exp2(-np.minimum(bits - least[:, None], 1000)).sum(1)
                else:
                    least = score = np.zeros(len(best))
                row = W.column(piece, "row")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.StructArray.from_arrays([row.field(n) for n in keep], names=keep),
                        pa.array(langs[best], pa.string()),
                        pa.array(np.where(known, score, 0.0)),
                        pa.array(np.where(known, least / np.maximum(np.diff(at), 1), 0.0)),
                    ],
                    names=["row", "lang_pred", "score", "bits"],
                )

    schema = T.StructType(
        [T.StructField("row", T.StructType([docs.schema[c] for c in keep])), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits", T.DoubleType())]
    )
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in both]).alias("row"), letters).mapInArrow(run, schema)


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
