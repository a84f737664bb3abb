"""Passages: all that repeat are found whole but for their ends, and common phrases are left alone."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dirgauge.llm import passages


def made(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_phrases_are_left_alone_and_passages_found_over_most_of_their_words(spark):
    rng = random.Random(8)
    phrase, texts, planted = made(rng, 14), [made(rng, 400) for _ in range(300)], {}
    for i in range(0, 200, 2):  # 51 to 90 words of one document inside the next
        n, at, to = rng.randint(51, 90), rng.randint(0, 300), rng.randint(0, 399)
        texts[i + 1][to:to] = texts[i][at : at + n]
        planted[i], planted[i + 1] = (at, n), (to, n)
    for t in texts[200:]:  # documents that share a phrase only
        to = rng.randint(0, 400)
        t[to:to] = phrase
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    covered = {}
    for r in passages.repeated_passages(df).collect():
        at, n = planted.get(r.doc_id, (0, 0))
        # a paragraph that reaches over an end by a few words is still alike
        assert at - 5 <= r.start and r.start + r.n_words <= at + n + 5 and r.run_words >= passages.MIN_RUN
        covered[r.doc_id] = covered.get(r.doc_id, 0) + r.n_words
    found = [i for i in planted if covered.get(i, 0) >= passages.MIN_RUN]
    assert len(found) >= 0.97 * len(planted) and set(covered) <= set(planted)
    share = sum(covered.values()) / sum(n for _, n in planted.values())
    assert share > 0.6, share


def test_runs(spark):
    rows = [(1, 0, 8), (1, 8, 7), (1, 15, 6), (1, 40, 19), (1, 70, 12), (1, 75, 15), (None, 5, 20), (2, 0, 30), (2, 0, 30)]
    places = spark.createDataFrame(rows, "doc_id bigint, start bigint, n_words bigint").withColumn("cluster_id", F.lit(1))
    got = sorted(((r.doc_id or 0, r.start, r.run_start, r.run_words) for r in passages.passages_of(places, 20).collect()))
    assert got == [(0, 5, 5, 20), (1, 0, 0, 21), (1, 8, 0, 21), (1, 15, 0, 21), (1, 70, 70, 20), (1, 75, 70, 20), (2, 0, 0, 30), (2, 0, 0, 30)]
    assert passages.passages_of(places.limit(0), 20).isEmpty()


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_pairs_with_a_small_set_are_all_found(percent):
    """Every pair of sets that reaches the similarity has a band in common if one set is small."""
    rng, sets = np.random.default_rng(5), set()
    for base in rng.choice(2**60, (60, 16), False).astype(np.uint64):
        for size in range(1, 17):
            for k in range(4):  # one more than the last, and with another shingle in some place
                own = base[:size].copy()
                own[rng.integers(size)] += np.uint64(k)
                sets.add(tuple(np.sort(own).tolist()))
    sets = sorted(sets)
    found = passages._Paragraphs.__new__(passages._Paragraphs)
    found.values = np.array([x for s in sets for x in s], np.uint64)
    found.at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found.ids = np.arange(len(sets), dtype=np.uint64) + np.uint64(1 << 62)
    banded = {}
    for key, owner in zip(*(x.tolist() for x in found.bands(percent))):
        banded.setdefault(key, set()).add(owner)
    joined = {(a, b) for owners in banded.values() for a in owners for b in owners if a < b}
    by_element, alike = {}, set()
    for i, s in enumerate(sets):
        for x in s:
            by_element.setdefault(x, set()).add(i)
    for a, b in {(a, b) for owners in by_element.values() for a in owners for b in owners if a < b}:
        x, y = set(sets[a]), set(sets[b])
        if 100 * len(x & y) >= percent * len(x | y) and min(len(x), len(y)) < passages.BANDED:
            alike.add((a, b))
    assert len(alike) > 50 and alike <= joined
    assert {i for pair in alike for i in pair} <= set(found.matched(percent).tolist())


def test_a_passage_with_one_changed_word_in_a_short_paragraph_is_whole(spark):
    rng = random.Random(12)
    texts = [made(rng, 60) for _ in range(150)]
    changed = [t[:] for t in texts]
    for t in changed:
        del t[-1]  # the last paragraph loses a shingle
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + changed)], "doc_id bigint, text string")
    found = passages._Paragraphs(pa.RecordBatch.from_pydict({"text": [" ".join(t) for t in texts + changed]}))
    last = {}
    for i, (text, start) in enumerate(zip(found.text.tolist(), found.start.tolist())):
        last[text] = (start, set(found.values[found.at[i] : found.at[i + 1]].tolist()))
    near = []
    for i in range(150):
        (a, x), (b, y) = last[i], last[i + 150]
        if a == b and len(x & y) >= 0.8 * len(x | y) and len(x) <= 9:
            near.append((i, a))
    assert len(near) > 5
    got = {(r.doc_id, r.start): r.cluster_id for r in passages.repeated_passages(df).collect()}
    for i, start in near:
        assert (i, start) in got and got[i, start] == got[i + 150, start]
