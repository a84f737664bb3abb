"""Interpolated modified Kneser-Ney models over character classes, one per language.

A code point is one of 64 classes: small ASCII letters one by one, capitals together, digits together,
blanks, a few marks one by one, the rest of ASCII together, other code points dealt to what is left. A model has the n-grams of
ORDER classes and all shorter ones. Spark counts them and joins counts, context sums and lower
probabilities shard by shard. 64 ** ORDER bounds what a language can have; no count is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.llm import reach
from dirgauge.llm import words as W
from dirgauge.llm.grams import counter
from dirgauge.session import materialise

ORDER, CLASSES, BITS = 4, 64, 6
#: Bytes of the texts that are scored together. The more, the fewer n-grams are asked for more than once.
PIECE_BYTES = 16 << 20

_ALONE = " \n.,#*$%&|<>"
_OTHER = 26 + len(_ALONE) + 3
_CLASS = np.full(256, 26 + len(_ALONE) + 1, np.uint8)
_CLASS[0x30:0x3A] = 26 + len(_ALONE)
_CLASS[0x41:0x5B] = 26 + len(_ALONE) + 2
_CLASS[0x61:0x7B] = np.arange(26)
for _i, _mark in enumerate(_ALONE):
    _CLASS[ord(_mark)] = 26 + _i


def classes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class of each code point of all texts, and the offsets of each text."""
    lead = (raw & 0xC0) != 0x80
    place = np.flatnonzero(lead)
    out = _CLASS[raw[place]]
    wide = np.flatnonzero(raw[place] >= 0x80)
    if len(wide):
        spelled = np.zeros(len(wide), np.int64)
        padded = np.concatenate([raw, np.zeros(4, np.uint8)])
        length = 1 + (raw[place[wide]] >= 0xC0) + (raw[place[wide]] >= 0xE0) + (raw[place[wide]] >= 0xF0)
        for i in range(4):
            spelled = np.where(i < length, spelled * 64 + (padded[place[wide] + i] & 0x3F), spelled)
        out[wide] = _OTHER + spelled % (CLASSES - _OTHER)
    return out, np.concatenate([[0], np.cumsum(lead)])[at]


def grams(piece: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """For each code point its ORDER - 1 predecessors and itself (line breaks before a text); offsets."""
    value, at = classes(*W.flat(W.column(piece, "text")))
    n, before = len(at) - 1, ORDER - 1
    padded = np.full(len(value) + before * n, _CLASS[10], np.uint8)
    place = np.arange(len(value)) + before * (np.repeat(np.arange(n), np.diff(at)) + 1)
    padded[place] = value
    out = padded[place].astype(np.int32)
    for k in range(1, ORDER):
        out |= padded[place - k].astype(np.int32) << (BITS * k)
    return out, at


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) over all rows of `docs` (lang, text); NULL texts are left out, a NULL lang is ''."""
    reach(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), "text").where("text IS NOT NULL")
    parts = rows.mapInArrow(counter(lambda piece: grams(piece)[0]), "lang string, gram bigint, n bigint")
    return materialise(parts.groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")


def _discounts(counts: DataFrame) -> DataFrame:
    """lang, d1, d2, d3: what a count of one, two, and three or more gives up; within 0 and the count."""
    few = [F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    return (
        counts.groupBy("lang")
        .agg(*few)
        .select(
            "lang",
            *[
                F.when((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col(f"n{i}") > 0), F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"))))
                .otherwise(F.lit(0.5 * i))
                .alias(f"d{i}")
                for i in (1, 2, 3)
            ],
        )
    )


def fit(counts: DataFrame) -> DataFrame:
    """(lang, size, kind, key, bits): the model as rows.

    kind 'gram': the code length of the last class after the others; kind 'back': what reaching the
    shorter context costs, by context. Counts below the highest order are numbers of distinct
    predecessors.
    """
    by_size = {ORDER: counts}
    for size in range(ORDER - 1, 0, -1):
        lower = F.col("gram").bitwiseAND((1 << (BITS * size)) - 1)
        by_size[size] = by_size[size + 1].groupBy("lang", lower.alias("gram")).agg(F.count("*").alias("n"))
    parts, below = [], None
    for size in range(1, ORDER + 1):
        table = by_size[size].withColumn("context", F.shiftright("gram", BITS)).join(_discounts(by_size[size]), "lang")
        given = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        table = table.withColumn("given", given)
        sums = table.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("given").alias("freed"))
        table = table.join(sums, ["lang", "context"])
        if below is None:
            table = table.withColumn("lower_p", F.lit(1.0 / CLASSES))
        else:
            lower = below.select("lang", F.col("gram").alias("lower"), F.col("p").alias("lower_p"))
            table = table.withColumn("lower", F.col("gram").bitwiseAND((1 << (BITS * (size - 1))) - 1)).join(lower, ["lang", "lower"])
        p = (F.col("n") - F.col("given") + F.col("freed") * F.col("lower_p")) / F.col("total")
        below = materialise(table.select("lang", "gram", p.alias("p")), "probabilities")
        back = sums.select("lang", F.lit(size).alias("size"), F.lit("back").alias("kind"), F.col("context").alias("key"), (-F.log2(F.col("freed") / F.col("total"))).alias("bits"))
        parts += [below.select("lang", F.lit(size).alias("size"), F.lit("gram").alias("kind"), F.col("gram").alias("key"), (-F.log2("p")).alias("bits")), back]
    return materialise(reduce(DataFrame.unionByName, parts), "model")


class SortedHashes:
    """All models as sorted arrays of keys with their values, looked up with binary search.

    `known` has every n-gram of any model with its code length in each; a directory by the number of
    the n-gram leads straight to it. Other n-grams back off through the arrays of each size.
    """

    def __init__(self, model: pa.Table):
        names = sorted(set(model.column("lang").to_pylist()))
        self.of = {n: i for i, n in enumerate(names)}
        which = np.array([self.of[n] for n in model.column("lang").to_pylist()], np.int64)
        size, key, bits = (model.column(c).to_numpy() for c in ("size", "key", "bits"))
        gram = np.array([k == "gram" for k in model.column("kind").to_pylist()], bool)
        self.arrays: dict[tuple[int, int, bool], tuple[np.ndarray, np.ndarray]] = {}
        for i in range(len(names)):
            for s in range(1, ORDER + 1):
                for is_gram in (True, False):
                    mine = (which == i) & (size == s) & (gram == is_gram)
                    turn = np.argsort(key[mine])
                    self.arrays[i, s, is_gram] = key[mine][turn], bits[mine][turn]
        self.known = np.unique(key[(size == ORDER) & gram])
        self.directory = np.full(1 << (BITS * ORDER), -1, np.int32)
        self.directory[self.known] = np.arange(len(self.known))
        self.bits = np.stack([self.code(i, self.known) for i in range(len(names))], 1) if names else np.empty((0, 0))

    def code(self, i: int, gram: np.ndarray) -> np.ndarray:
        """Bits of each n-gram in model i, with back-off."""
        gram = gram.astype(np.int64)
        out, open_ = np.zeros(len(gram)), np.ones(len(gram), bool)
        for s in range(ORDER, 0, -1):
            for is_gram, wanted in ((True, gram), (False, gram >> BITS)):
                keys, bits = self.arrays[i, s, is_gram]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                    found = open_ & (keys[at] == wanted)
                    out[found] += bits[at[found]]
                    if is_gram:
                        open_ &= ~found
            gram = gram & ((1 << (BITS * (s - 1))) - 1)
        out[open_] += BITS
        return out.astype(np.float32)

    def lengths(self, gram: np.ndarray, at: np.ndarray, langs: list[str]) -> np.ndarray:
        """Bits of each text under its language's model; NaN for a language without one."""
        out = np.zeros(len(langs))
        model = np.array([self.of.get(x, -1) for x in langs], np.int64)
        full = np.diff(at) > 0
        if full.any() and len(self.of):
            each = np.repeat(np.maximum(model, 0), np.diff(at))
            found = self.directory[gram]
            bits = self.bits[found, each]
            odd = np.flatnonzero(found < 0)
            for i in np.unique(each[odd]).tolist():
                rows = odd[each[odd] == i]
                rare, back = np.unique(gram[rows], return_inverse=True)
                bits[rows] = self.code(i, rare)[back]
            out[full] = np.add.reduceat(bits, at[:-1][full], dtype=np.float64)
        out[model < 0] = np.nan
        return out


def share(model: DataFrame):
    """A function that gives tasks the model. At most CLASSES ** ORDER rows a language of the highest order, and
    no more of any lower, nor contexts, go through the driver and to each worker."""
    spark = reach(model.sparkSession)
    held = spark.sparkContext.broadcast(model.toArrow())
    return lambda: SortedHashes(held.value)


def codes(model: DataFrame, wanted: DataFrame) -> DataFrame:
    """(lang, gram, bits) of each n-gram of `wanted` (lang, gram; each once) under its language's model, as `SortedHashes.code`.

    The rows of the model (`fit`) are joined size by size. An n-gram that has no row adds what its context costs, if
    that has a row, and goes on without its first class. Languages without a model are left out.
    """
    going = wanted.join(model.select("lang").distinct(), "lang", "left_semi")
    going = going.select("lang", "gram", F.col("gram").alias("rest"), F.lit(0.0).alias("bits"))
    parts = []
    for size in range(ORDER, 0, -1):
        known = model.where(F.col("size") == size)
        found = known.where("kind = 'gram'").select("lang", F.col("key").alias("rest"), F.col("bits").alias("own"))
        back = known.where("kind = 'back'").select("lang", F.col("key").alias("context"), F.col("bits").alias("reach"))
        looked = going.join(found, ["lang", "rest"], "left").withColumn("context", F.shiftright("rest", BITS))
        looked = materialise(looked.join(back, ["lang", "context"], "left"), "codes")
        parts.append(looked.where("own IS NOT NULL").select("lang", "gram", (F.col("bits") + F.col("own")).alias("bits")))
        further = F.col("bits") + F.coalesce("reach", F.lit(0.0))
        shorter = F.col("rest").bitwiseAND((1 << (BITS * (size - 1))) - 1)
        going = looked.where("own IS NULL").select("lang", "gram", shorter.alias("rest"), further.alias("bits"))
    parts.append(going.select("lang", "gram", (F.col("bits") + F.lit(float(BITS))).alias("bits")))
    return reduce(DataFrame.unionByName, parts).select("lang", "gram", F.col("bits").cast("float").alias("bits"))


def distinct_grams(texts: pa.Table) -> pa.Table:
    """(piece, lang, gram) once for each n-gram of a language's texts in one piece (piece, lang, text)."""
    parts = []
    for lang, rows in _by_language(texts):
        gram = np.empty(0, np.int32)
        for batch in rows.to_batches():
            for part in W.pieces(batch, "text"):
                gram = np.union1d(gram, grams(part)[0])
        piece = pa.array(np.full(len(gram), texts.column("piece")[0].as_py(), np.int32))
        parts.append(pa.table([piece, pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64))], names=["piece", "lang", "gram"]))
    return pa.concat_tables(parts)


def _by_language(table: pa.Table) -> Iterator[tuple[str, pa.Table]]:
    for lang in table.column("lang").unique().to_pylist():
        yield lang, table.filter(pc.equal(table.column("lang"), lang))


def lengths_of(more: Callable[[pa.RecordBatch], dict[str, np.ndarray]] | None):
    """A cogroup function: doc_id, lang, n_points, bits (a code point; NULL without model or code points) of the texts of one
    piece, from the codes of its n-grams (lang, gram, bits), and what `more` says of each text."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        given, code = dict(_by_language(answers)), np.full(1 << (BITS * ORDER), np.nan, np.float32)
        parts = []
        for lang, rows in _by_language(texts):
            known = given[lang].column("gram").to_numpy() if lang in given else np.empty(0, np.int64)
            if len(known):
                code[known] = given[lang].column("bits").to_numpy()
            for batch in rows.to_batches():
                for part in W.pieces(batch, "text"):
                    gram, at = grams(part)
                    n, bits = np.diff(at), np.zeros(len(at) - 1)
                    full = n > 0
                    if full.any():
                        bits[full] = np.add.reduceat(code[gram], at[:-1][full], dtype=np.float64)
                    if lang in given and np.isnan(bits).any():
                        raise RuntimeError("n-grams without a code: the texts have changed since they were counted")
                    values = pa.array(bits / np.maximum(n, 1), mask=np.isnan(bits) | ~full)
                    found = {"doc_id": W.column(part, "doc_id"), "lang": W.column(part, "lang"), "n_points": pa.array(n.astype(np.int64)), "bits": values}
                    parts.append(pa.table(found | {k: pa.array(v) for k, v in (more(part) if more else {}).items()}))
            code[known] = np.nan
        return pa.concat_tables(parts)

    return run


def score(docs: DataFrame, model: DataFrame, more: Callable[[pa.RecordBatch], dict[str, np.ndarray]] | None = None, fields: Iterable[T.StructField] = ()) -> DataFrame:
    """doc_id, lang, n_points, bits per row of `docs` (doc_id, lang, text; lang is not NULL) under its language's model.

    No task has the model. All n-grams of the texts are counted and joined with the model's rows once (`codes`). Texts are
    dealt out to pieces of about PIECE_BYTES; the distinct n-grams of a piece are joined with their codes and meet its texts
    again. Both sides of that read one shuffle of the texts. Rows alike in doc_id, lang and text share a piece. There `more` adds
    columns (`fields`) from the rows themselves.
    """
    reach(docs.sparkSession)
    coded = materialise(codes(model, count(docs).select("lang", "gram")), "coded")
    volume = docs.agg(F.sum(F.octet_length("text") + 32)).first()[0] or 0
    pieces = -(-volume // PIECE_BYTES) or 1
    piece = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(pieces)).cast("int").alias("piece")
    dealt = docs.select(piece, "doc_id", "lang", "text").repartition("piece")
    asked = dealt.groupBy("piece").applyInArrow(distinct_grams, "piece int, lang string, gram bigint")
    answers = asked.join(coded, ["lang", "gram"]).select("piece", "lang", "gram", "bits")
    own = [docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("n_points", T.LongType()), T.StructField("bits", T.DoubleType())]
    return dealt.groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(lengths_of(more), T.StructType([*own, *fields]))
