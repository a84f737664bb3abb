from __future__ import annotations

import random
import re
import time

from dirgauge.llm import token_counts


def test_spans_are_the_matches_of_the_plain_pattern():
    rng = random.Random(8)
    pieces = ["a", "Z", "7", "12345", "ABCDEFGHIJKL", "@", ".", "-", "+", "_", " ", "\n", ",", "(", "é", "漢", "\u00a0", "x@y.z", "@b.c", "\x1c"]
    for _ in range(20_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert token_counts.masked_spans(text) == [m.span() for m in re.finditer(token_counts.MASKED, text, re.ASCII)], text


def test_masking_and_counting_long_words_takes_time_in_proportion(spark):
    start = time.monotonic()
    texts = ["x" * 1_000_000, "a@" * 300_000, "ab+" * 300_000 + "@", "Ab1" * 300_000, "12345 " * 50_000, "Q" * 400_000 + "@"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(len(texts))
    rows = {r.doc_id: r for r in token_counts.recount(token_counts.masking_edits(docs)).collect()}
    assert [rows[i].n_edits for i in range(6)] == [0, 0, 0, 0, 50_000, 1]
    assert time.monotonic() - start < 120  # by the plain pattern, the square of a word's length
