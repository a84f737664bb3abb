"""Counting numbered n-grams per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from dirgauge.llm import words as W

#: Distinct n-grams a task holds before it passes its counts on.
HELD = 2_000_000


def counter(grams: Callable[[pa.RecordBatch], np.ndarray]):
    """A mapInArrow function: (lang, gram, n) from batches with `lang` and `text`, in partial counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out():
            for lang, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)],
                    names=["lang", "gram", "n"],
                )

        for batch in batches:
            langs = W.column(batch, "lang")
            for lang in langs.unique().to_pylist():
                for piece in W.pieces(batch.filter(pc.equal(langs, lang)), "text"):
                    gram, n = np.unique(grams(piece), return_counts=True)
                    if lang in held:
                        gram, back = np.unique(np.concatenate([held[lang][0], gram]), return_inverse=True)
                        n = np.bincount(back, np.concatenate([held[lang][1], n]), len(gram)).astype(np.int64)
                    held[lang] = (gram, n)
            if sum(len(gram) for gram, _ in held.values()) > HELD:
                yield from out()
                held.clear()
        yield from out()

    return run
