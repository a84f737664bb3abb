import inspect
import math
import random

from dirgauge.llm import perplexity_rules, trusted_text
from dirgauge.llm.quantiles import quantiles

SHARES = [0.0, 0.25, 0.5, 0.75, 0.95, 1.0]


def test_quantiles_are_those_of_the_sorted_rows(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice("ab"), rng.random()) for i in range(30_000)] + [(i, "c", 0.5) for i in range(2_000)] + [(None, "d", 1.0), (1, "", -1.0)]
    found = quantiles(spark.createDataFrame(rows, "doc_id bigint, lang string, bits double").repartition(5), "lang", "bits", SHARES, "doc_id")
    values = {}
    for _, lang, bits in rows:
        values.setdefault(lang, []).append(bits)
    expected = {k: [sorted(v)[max(math.ceil(s * len(v)), 1) - 1] for s in SHARES] for k, v in values.items()}
    assert {r.lang: r.q for r in found.collect()} == expected


def test_no_band_comes_from_an_approximate_quantile():
    for module in (perplexity_rules, trusted_text):
        assert "percentile_approx" not in inspect.getsource(module)


def test_no_rows_have_no_quantiles(spark):
    assert quantiles(spark.createDataFrame([], "doc_id bigint, lang string, bits double"), "lang", "bits", SHARES, "doc_id").isEmpty()
