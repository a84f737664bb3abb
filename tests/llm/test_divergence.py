"""The divergence of sources against a sum over every term and every pair."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from compare import compare, connect
from dirgauge.llm import divergence, queries
from llm.conftest import lower

SMALL = "/root/testdata/sf0.001"


def brute(docs):
    counts, seen, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        words = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(text))
        groups[lang].add(source)
        counts[lang, source].update(words)
        seen[lang].update(set(words))
    out = set()
    f = lambda p, q: (p - q) ** 2 // q
    ranked = lambda pairs: enumerate(sorted(pairs, key=lambda x: (-x[1], x[0].encode())), 1)
    for lang, sources in groups.items():
        kept = [t for t, n in seen[lang].items() if n >= 3]

        def shares(count):
            whole = sum(count[t] for t in kept) + len(kept)
            return {t: 1 + 10**9 * (count[t] + 1) // whole for t in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            out |= {(lang, s, "pair", x, v, r) for r, (x, v) in ranked(pairs)}
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            out |= {(lang, s, "term", x, v, r) for r, (x, v) in ranked(terms) if r <= 200}
    return out


def check(df):
    rows = [tuple(r) for r in divergence.divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(df.select("text", "lang", "source").collect())


def test_divergence_equals_brute_force(docs):
    check(docs)


def test_divergence_of_odd_rows(odd, none):
    check(odd)
    assert divergence.divergence(none).isEmpty()


def test_divergence_of_many_sources_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 50)
    rng = random.Random(4)
    rows = [(" ".join(rng.choice("aé") * rng.randint(1, 40) for _ in range(rng.randint(0, 60))), rng.choice(["x", None]), f"s{rng.randint(0, 25)}") for _ in range(800)]
    rows += [("a b c a", "alone", "s"), ("a b c", "alone", "s"), ("a", "alone", "s"), ("x " * 10**5, "few", "s1"), ("x", "few", "s2"), ("1 2", "few", "s3")]
    check(spark.createDataFrame(rows, "text string, lang string, source string").repartition(5).withColumns({c: F.lit(1) for c in ("term", "n", "i", "v", "value")}))


def test_terms_of_any_bytes(spark):
    texts = ["Aaé\u0000B@c[d`e{f\u007fg  x\U0001f642Y", "don't STOP-now_x", "", " ", None, "ÉA"]
    check(spark.createDataFrame([(t, "l", s) for t in texts for s in "abc"], "text string, lang string, source string"))


def test_divergence_equals_its_sql(spark):
    assert compare(queries.op12_divergence(spark, SMALL), connect(SMALL), queries.oracle_sql()["op12_divergence"]) == ""


def test_sums_wider_than_64_bits_are_kept(monkeypatch):
    import numpy as np
    import pyarrow as pa

    i, p, z = np.array([0, 1]), np.array([10**9, 10**9]), np.array([1, 1])
    n = 10
    out = divergence._summed(pa.array(["l"]), np.zeros(n, np.int64), i, p, z, np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, 100))
    f = lambda s, t: (s - t) ** 2 // t
    assert [int(v) for v in out.column(3).to_pylist()] == [n * 100 * (f(10**9, 10**9) - f(10**9, 1) - f(1, 10**9) + f(1, 1))] * 2
