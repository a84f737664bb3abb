"""Each operator against a brute-force version, and over odd and empty tables."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from compare import compare, connect
from dirgauge.llm import (
    components,
    kneser_ney,
    licences,
    mixing,
    near_dups,
    passages,
    perplexity_rules,
    ppm,
    prefix_join,
    queries,
    sharding,
    suffix_arrays,
    token_counts,
    trusted_text,
)
from llm.conftest import lower, plain_words

SMALL = "/root/testdata/sf0.001"


def bench_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


@pytest.mark.parametrize("block_bytes", [suffix_arrays.BLOCK_BYTES, 3_000])
def test_marks_equal_a_search_for_every_window(spark, docs, block_bytes):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    bench = bench.unionByName(spark.createDataFrame([(900, "the"), (901, None), (902, "..."), (900, "the")], bench.schema))
    windows = defaultdict(set)
    for item, text in bench.collect():
        w = bench_words(text)
        for k in range(max(1, len(w) - 12)):
            if w:
                windows[tuple(w[k : k + 13])].add(str(item))
    sizes = {len(w) for w in windows}
    texts = dict(docs.select("doc_id", "text").collect())
    out = suffix_arrays.mark_contaminated(docs, bench, ["doc_id"], block_bytes)
    rows = out.select("row.doc_id", "n_words", suffix_arrays.n_hit().alias("n_hit"), "items").collect()
    assert len(rows) == len(texts) and any(r.n_hit for r in rows)
    for r in rows:
        w = bench_words(texts[r.doc_id])
        hit, items = set(), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    items |= found
                    hit.update(range(k, k + size))
        assert (r.n_words, r.n_hit, list(r["items"])) == (len(w), len(hit), sorted(items))


def test_longest_matches(spark, docs):
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet").limit(5)
    items = {str(i): bench_words(t) for i, t in bench.collect()}
    words = {i: bench_words(t) for i, t in docs.select("doc_id", "text").collect()}
    found = {(r.item_id, r.start): r for r in suffix_arrays.longest_matches(docs, bench).collect()}
    for item, w in items.items():
        for start in range(0, len(w), 7):
            best = 0
            for d in words.values():
                for k in range(len(d)):
                    n = 0
                    while start + n < len(w) and k + n < len(d) and d[k + n] == w[start + n]:
                        n += 1
                    best = max(best, n)
            r = found.get((item, start))
            assert (r.length if r else 0) == best
            if r:
                assert words[r.doc_id][r.position : r.position + best] == w[start : start + best]


def test_code_lengths_are_those_of_partial_matching(spark, docs):
    trees = ppm.train(docs.where(~ppm.held_out()))
    counts = defaultdict(Counter)
    for lang, gram, n in trees.collect():
        b = gram.to_bytes(4, "big")
        for k in range(4):
            counts[lang, b[3 - k : 3]][b[3]] += n

    def code(lang, data):
        data, total = b"\n\n\n" + data, 0
        for i in range(3, len(data)):
            gone, done = set(), False
            for k in (3, 2, 1, 0):
                left = {s: n for s, n in counts.get((lang, data[i - k : i]), {}).items() if s not in gone}
                if not left:
                    continue
                whole = sum(left.values()) + len(left)
                if data[i] in left:
                    total, done = total + math.log2(whole / left[data[i]]), True
                    break
                total += math.log2(whole / len(left))
                gone |= set(left)
            if not done:
                total += math.log2(256 - len(gone))
        return total

    langs = sorted({lang for lang, _ in counts})
    rows = ppm.predict(docs, trees, ["doc_id", "text", "lang"]).select("row.*", "lang_pred", "score", "bits").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    for r in rows[::40]:
        data = r.text.encode()
        lengths = {x: code(x, data) for x in langs}
        best = min(langs, key=lengths.get)
        assert r.lang_pred == best and r.bits == pytest.approx(lengths[best] / len(data), rel=1e-4)


def test_a_rare_language_keeps_its_counts(spark):
    """Three French texts beside many English and German ones, with more counts than a bound of 5,000 would leave."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text IS NOT NULL")
    few = docs.where("lang = 'fr'").orderBy("doc_id").limit(3)
    trees = ppm.train(docs.where("lang IN ('en', 'de')").unionByName(few))
    assert trees.count() > 5_000
    rest = docs.where("lang = 'fr'").join(few.select("doc_id"), "doc_id", "left_anti")
    found = ppm.predict(rest, trees, ["doc_id"])
    assert found.where("lang_pred = 'fr'").count() > 0.9 * rest.count()


def test_probabilities_of_a_context_sum_to_one(spark, docs):
    table = kneser_ney.fit(kneser_ney.count(docs)).toArrow()
    model = kneser_ney.SortedHashes(table)
    import numpy as np

    for context in (0, 12345, 64**3 - 1, int(model.known[100]) >> 6):
        p = 2.0 ** -model.code(0, np.arange(64) + (context << 6)).astype(float)
        assert p.sum() == pytest.approx(1, abs=1e-4)


def test_code_lengths_are_those_of_modified_kneser_ney(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("aabcd e,A1é") for _ in range(rng.randint(0, 60))) for _ in range(30)]
    df = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    model = kneser_ney.SortedHashes(kneser_ney.fit(kneser_ney.count(df)).toArrow())
    grams, at = kneser_ney.grams(pa.RecordBatch.from_pydict({"text": texts}))
    digits = lambda g, n: tuple(int(g) >> 6 * k & 63 for k in reversed(range(n)))
    counts = {4: Counter(digits(g, 4) for g in grams)}
    for n in (3, 2, 1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discount = {}
    for n, c in counts.items():
        few = Counter(c.values())
        y = few[1] / (few[1] + 2 * few[2]) if few[1] else 0
        for i in (1, 2, 3):
            whole = few[1] and few[2] and few[i]
            discount[n, i] = max(0.05, min(i - 0.05, i - (i + 1) * y * few[i + 1] / few[i])) if whole else 0.5 * i

    def p(gram):
        n = len(gram)
        if not n:
            return 1 / 64
        same = {g: c for g, c in counts[n].items() if g[:-1] == gram[:-1]}
        if not same:
            return p(gram[1:])
        freed = sum(discount[n, min(c, 3)] for c in same.values())
        own = same.get(gram, 0)
        return (own - (discount[n, min(own, 3)] if own else 0) + freed * p(gram[1:])) / sum(same.values())

    tried = [int(g) for g in grams[:60]] + [rng.randrange(64**4) for _ in range(60)]
    for g, bits in zip(tried, model.code(0, pa.array(tried).to_numpy()).tolist()):
        assert bits == pytest.approx(-math.log2(p(digits(g, 4))), rel=1e-4)


def test_perplexity_rejects_shouting_and_noise_and_keeps_clean_texts(spark):
    rng = random.Random(7)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    sound = perplexity_rules.apply_rules(docs).where("NOT base_failed AND 50 * n_symbols < n_words").select("doc_id")
    some = [(r.doc_id, r.text, r.lang) for r in docs.join(sound, "doc_id").orderBy("doc_id").collect()]
    loud = [(10**6 + i, t.upper(), x) for i, t, x in some[::20]]
    noise = [(2 * 10**6 + i, "".join(rng.sample(t, len(t))), x) for i, t, x in some[::40]]
    out = perplexity_rules.apply_rules(docs.unionByName(spark.createDataFrame(loud + noise, docs.schema)))
    kept = {r.doc_id: r.kept for r in out.where("NOT base_failed").collect()}
    share = lambda rows: sum(kept.get(i, False) for i, _, _ in rows) / len(rows)
    assert share(some) >= 0.97 and share(loud) <= 0.25 and share(noise) == 0


def test_base_rules(spark, docs):
    for r in perplexity_rules.apply_rules(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        w = plain_words(r.text)
        threes = Counter(zip(w, w[1:], w[2:]))
        hit = {k + i for k in range(len(w) - 2) if threes[tuple(w[k : k + 3])] > 1 for i in range(3)}
        lines = [x for x in r.text.split("\n") if plain_words(x)]
        expected = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text)), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)


@pytest.mark.parametrize("piece_bytes", [kneser_ney.PIECE_BYTES, 3_000])
def test_scores_by_joins_are_those_of_the_whole_model(spark, docs, odd, monkeypatch, piece_bytes):
    monkeypatch.setattr(kneser_ney, "PIECE_BYTES", piece_bytes)
    lang = F.coalesce("lang", F.lit("")).alias("lang")
    rows = docs.select("doc_id", lang, "text").unionByName(odd.select("doc_id", lang, "text"))
    few = kneser_ney.fit(kneser_ney.count(docs.where("doc_id % 7 = 0 AND lang <> 'de'").select("lang", "text")))
    whole = kneser_ney.SortedHashes(few.toArrow())
    texts = rows.toArrow().combine_chunks()
    gram, at = kneser_ney.grams(texts.to_batches()[0])
    bits = whole.lengths(gram, at, texts.column("lang").to_pylist()) / np.maximum(np.diff(at), 1)
    none = np.isnan(bits) | (np.diff(at) == 0)
    expected = zip(texts.column("doc_id").to_pylist(), texts.column("lang").to_pylist(), np.diff(at).tolist(), bits.tolist(), none.tolist())
    out = kneser_ney.score(rows, few)
    assert sorted(map(tuple, out.collect()), key=str) == sorted([(d, x, n, None if no else b) for d, x, n, b, no in expected], key=str)
    assert none.any() and not none.all()
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()  # the texts are shuffled once


def test_no_task_has_the_model_of_trusted_text(spark, monkeypatch):
    def whole(*_):
        raise AssertionError("the whole model")

    monkeypatch.setattr(kneser_ney, "share", whole)
    monkeypatch.setattr(kneser_ney, "SortedHashes", whole)
    assert queries.op5_trusted_text(spark, SMALL).where("perplexity > 1").count() > 100


def test_no_task_has_the_model_of_the_rules(spark, monkeypatch):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "text").toArrow().combine_chunks()
    whole = kneser_ney.SortedHashes

    def none(*_):
        raise AssertionError("the whole model")

    monkeypatch.setattr(kneser_ney, "share", none)
    monkeypatch.setattr(kneser_ney, "SortedHashes", none)
    made, fit = [], kneser_ney.fit
    monkeypatch.setattr(kneser_ney, "fit", lambda counts: made.append(fit(counts)) or made[0])
    found = {r.doc_id: r.perplexity for r in queries.op4_perplexity_rules(spark, SMALL).collect()}
    gram, at = kneser_ney.grams(d.to_batches()[0])
    bits = whole(made[0].toArrow()).lengths(gram, at, d.column("lang").to_pylist()) / np.maximum(np.diff(at), 1)
    for i, b, n in zip(d.column("doc_id").to_pylist(), bits.tolist(), np.diff(at).tolist()):
        assert found[i] == (pytest.approx(2.0**b, rel=1e-12) if n else None)


def test_trusted_text_agrees_with_labels(spark):
    d = "/root/testdata/sf0.01"
    out = queries.op5_trusted_text(spark, d).where(ppm.held_out())
    held = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    right = held.agg(F.avg((F.col("accepted") == (F.col("quality") == 1)).cast("double"))).first()[0]
    assert right > 0.85


def test_mixing_equals_its_sql(spark):
    assert compare(queries.op6_mixing(spark, SMALL), connect(SMALL), queries.oracle_sql()["op6_mixing"]) == ""


def test_mixed_documents_have_the_words_taken(spark, docs):
    taken = mixing.allocate(docs).agg(F.sum("taken")).first()[0]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == taken


def test_sharding_is_stable_and_gapless(spark):
    rows = queries.op7_sharding(spark, SMALL).collect()
    again = queries.op7_sharding(spark, SMALL).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_written_shards_hold_the_records_in_the_order_of_their_slots(spark, docs, tmp_path):
    sharding.write_shards(sharding.shard(docs), str(tmp_path / "shards"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = Counter()
    for k in range(8):
        parts = sorted((tmp_path / "shards" / f"shard={k}").glob("*.parquet"))
        rows = [r for p in parts for r in pq.read_table(p, partitioning=None).to_pylist()]
        assert [r["slot"] for r in rows] == list(range(len(rows)))
        assert all(texts[r["doc_id"]] == r["text"] for r in rows)
        seen.update(r["doc_id"] for r in rows)
    assert seen == Counter(texts.keys())
    by_query = {(r.doc_id, r.size, r.text_crc32) for r in queries.op7_sharding(spark, SMALL).collect()}
    assert by_query == {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts.items()}


def test_rows_alike_that_overflow_a_bucket_are_spread(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    same = spark.range(200).select(F.lit(7).alias("doc_id"), F.lit("x").alias("text"))
    out = sharding.shard(same).collect()
    assert len(out) == 200 and sorted(r.slot for r in out) == list(range(200))


def test_texts_are_shuffled_once(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 10)
    same = docs.unionByName(spark.range(200).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (docs, same):
            plan = sharding.shard(rows)._jdf.queryExecution().executedPlan().toString()
            moved = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
            assert "Exchange" not in plan.split("FlatMapGroupsInArrow")[0]
            assert not any("hashpartitioning(draw" in line for line in moved)
            assert len({(r.shard, r.slot) for r in sharding.shard(rows).collect()}) == rows.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_licences(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    lines = {"Released under the MIT License.": "mit", "All rights reserved.": "proprietary", "Licensed under the Apache License, Version 2.0.": "apache-2.0"}
    expected = {(r.doc_id, i): lines[x] for r in docs.collect() for i, x in enumerate((r.text or "").split("\n")) if x in lines}
    found = {(r.doc_id, r.paragraph): r.family for r in queries.op8_licences(spark, d).collect()}
    assert expected and all(found[k] == v for k, v in expected.items())


def test_shared_passages_are_found_and_clean_documents_are_not(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    texts = [[word() for _ in range(300)] for _ in range(40)]
    for i in range(0, 20, 2):  # 51 to 80 words of one document inside the next, at any place
        n, at, to = rng.randint(51, 80), rng.randint(0, 200), rng.randint(0, 299)
        texts[i + 1][to:to] = texts[i][at : at + n]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    rows = passages.repeated_passages(df).collect()
    assert {r.doc_id for r in rows} == set(range(20))
    kept = Counter(r.cluster_id for r in rows if not r.removed)
    assert set(kept) == {r.cluster_id for r in rows} and set(kept.values()) == {1}


def test_passages_among_many_variants_of_one_paragraph(spark):
    rng = random.Random(6)
    whole = lambda texts: passages._Paragraphs(pa.RecordBatch.from_pydict({"text": texts}))
    tries = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(18)) for _ in range(20_000)]
    found = whole(tries)
    uncut = [tries[t] for t in found.text[found.length == 18]]
    middle = max(uncut, key=lambda m: (whole([f"a{i} {m} z{i}" for i in range(100)]).length == 20).sum())
    made = [f"a{i // 6} {middle} z{i}" for i in range(24_000)]
    found = whole(made)
    by_first = defaultdict(list)
    for t in found.text[found.length == 20]:
        by_first[t // 6].append(made[t])
    texts = [t for ts in by_first.values() if len(ts) > 1 for t in ts[:2]]  # 15 of 17 shared with the partner, 14 of 18 with others
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    cluster = {r.doc_id: r.cluster_id for r in passages.repeated_passages(df).collect()}
    assert len(texts) > 200 and set(cluster) == set(range(len(texts)))
    assert all(cluster[i] == cluster[i + 1] for i in range(0, len(texts), 2)) and len(set(cluster.values())) == len(texts) // 2


def test_components_of_near_duplicates(spark, docs):
    sets = {}
    for i, text in docs.select("doc_id", "text").collect():
        w = plain_words(lower(text))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    out = near_dups.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(s), root(i)) for i, s in sets.items()}


def test_near_duplicates_among_many_documents_of_one_template(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(1_000):  # two words changed, and in the partner two more; the others lie under 0.85
        text = list(words)
        for _ in range(2):
            for p in rng.sample(range(150), 2):
                text[p] = f"x{i}-{len(texts)}-{p}"
            texts.append(list(text))
    sets = [{tuple(t[k : k + 5]) for k in range(146)} for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            both = len(sets[a] & sets[b])
            if root[a] != root[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = [low if r == high else r for r in root]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    assert dict(near_dups.near_duplicates(df).select("doc_id", "component_id").collect()) == dict(enumerate(root))


def _versions(spark, n, words, changes):
    """n texts, each one template with some words of its own in place of its."""
    rng = random.Random(9)
    texts = []
    for i in range(n):
        text = [f"w{k}" for k in range(words)]
        for p in rng.sample(range(words), changes):
            text[p] = f"x{i}-{p}"
        texts.append((i, " ".join(text)))
    return spark.createDataFrame(texts, "doc_id bigint, text string")


def test_pairs_inside_a_group_of_copies_are_not_made(spark, monkeypatch):
    made, whole = [], near_dups._confirmed
    monkeypatch.setattr(near_dups, "_confirmed", lambda pairs, *more: made.append(pairs.count()) or whole(pairs, *more))
    df = _versions(spark, 600, 300, 2)  # two texts share 0.87 to 0.98
    assert {r.component_id for r in near_dups.near_duplicates(df).collect()} == {0}
    assert sum(made) < 2 * 600


def test_sets_of_a_template_that_stay_under_the_similarity_are_not_joined(spark):
    """18 of 200 elements are a set's own; two sets share 0.835."""
    rows = [(i, i, list(range(182)) + [1000 * (i + 1) + k for k in range(18)]) for i in range(500)]
    sets = spark.createDataFrame(rows, "id bigint, group bigint, elements array<bigint>")
    assert prefix_join.prefixes(sets, 85).where("most >= n").isEmpty() and prefix_join.candidate_pairs(sets, 85).isEmpty()


@pytest.mark.parametrize("percent", [80, 85])
def test_prefix_join_loses_no_pair(spark, percent):
    rng = random.Random(percent)
    sets = []
    for _ in range(60):
        base = rng.sample(range(10_000), rng.randint(1, 160))
        for _ in range(rng.randint(2, 9)):
            other = [e for e in base if rng.random() > 0.08] + [rng.randint(0, 300) for _ in range(rng.randint(0, 4))]
            sets.append(set(other) or {1})
    group = [rng.randint(0, 400) for _ in sets]
    df = spark.createDataFrame([(i, g, sorted(s)) for i, (g, s) in enumerate(zip(group, sets))], "id bigint, group bigint, elements array<bigint>")
    found = {tuple(r) for r in prefix_join.candidate_pairs(df, percent).collect()}
    both = lambda a, b: len(sets[a] & sets[b])
    reach = lambda a, b: 100 * both(a, b) >= percent * (len(sets[a]) + len(sets[b]) - both(a, b))
    expected = {(a, b) for b in range(len(sets)) for a in range(b) if group[a] != group[b] and reach(a, b)}
    assert len(expected) > 100 and expected <= found


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(100)]
    out = dict(components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert out == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(100)}}


@pytest.mark.parametrize("held, stored", [(100_000, 1), (40, 3)])
def test_few_edges_are_contracted_at_once(spark, monkeypatch, held, stored):
    rng, labels = random.Random(3), []
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(1000, 1000 + i) for i in range(60)] + [(rng.randint(2000, 2100), rng.randint(2000, 2100)) for _ in range(90)]
    frame = spark.createDataFrame([(f"{a:05}".encode(), f"{b:05}".encode()) for a, b in edges], "a binary, b binary").repartition(7)
    store = components.materialise
    monkeypatch.setattr(components, "materialise", lambda df, label: (labels.append(label), store(df, label))[1])
    monkeypatch.setattr(components, "HELD", held)
    out = {int(a): int(b) for a, b in components.components(frame).collect()}
    parent = {}
    for a, b in edges:
        for x in (a, b):
            parent.setdefault(x, x)
    for _ in range(300):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert out == {x: parent[x] for x in touched}
    assert len(labels) == 1 if stored == 1 else len(labels) >= stored


def test_token_trees_follow_any_edit():
    counter, rng = token_counts.Counter.of(token_counts.RANKS), random.Random(3)
    signs = "ab C1\n é.'s  "
    draw = lambda sizes: "".join(rng.choice(signs) for _ in range(rng.choice(sizes)))
    for _ in range(500):
        text = draw([0, 3, 30, 300, 900])
        tree = token_counts.Tree(text, counter)
        for _ in range(4):
            a = rng.randint(0, len(text) + 2)
            b, new = a + rng.choice([0, 1, 3, 40, 200]), draw([0, 1, 5, 30])
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.total() == len(counter.encoding.encode_ordinary(text))


def test_masking_edits_are_the_matches(spark, docs):
    for r in token_counts.masking_edits(docs).collect():
        spans = [(m.start(), m.end()) for m in re.finditer(token_counts.MASKED, r.text, re.ASCII)]
        assert [(e.start, e.end) for e in reversed(r.edits)] == spans


OPERATORS = {
    "decontaminate": lambda d: suffix_arrays.decontaminate(d, d.sparkSession.createDataFrame([(None, "two"), (1, None)], "item_id bigint, text string")),
    "language": lambda d: ppm.predict(d, ppm.train(d), d.columns),
    "recount": lambda d: token_counts.recount(token_counts.masking_edits(d)),
    "rules": perplexity_rules.apply_rules,
    "trusted": lambda d: trusted_text.classify(d, d.sparkSession.createDataFrame([(1, 1), (1, None), (None, 1)], "doc_id bigint, quality int")),
    "allocate": mixing.allocate,
    "mix": mixing.mix,
    "shard": sharding.shard,
    "passages": passages.repeated_passages,
    "near": near_dups.near_duplicates,
    "dedup": near_dups.deduplicate,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(odd, name):
    rows = OPERATORS[name](odd).collect()
    n = len(rows)
    if name in ("language", "recount", "rules", "trusted", "allocate", "shard", "near"):
        assert n == odd.count()
    if name == "dedup":  # the repeated and the upper-case row go, three texts without words stay
        assert n == 6
    if name == "decontaminate":
        assert sorted(str(r.doc_id) for r in rows) == ["2", "3", "4", "5", "6"]
    if name == "rules":
        assert all(not r.kept and r.n_words == 0 for r in rows if r.doc_id in (2, 3, 4))
    if name == "language":
        assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.row.doc_id in (2, 3, 4))
    if name == "passages":
        assert rows == []  # a run of one word is one paragraph


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(none, name):
    assert OPERATORS[name](none).collect() == []


def test_licences_of_odd_rows(odd, none):
    classifier = licences.train(odd)
    assert licences.scan(none, classifier).collect() == []
    assert all(r.family == "unknown" for r in licences.scan(odd, classifier).collect())


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert set(docs.columns) < set(out.columns) and 0 < out.count()
    assert out.groupBy("shard").agg((F.max("slot") + 1 - F.count("*")).alias("gap")).where("gap <> 0").isEmpty()
