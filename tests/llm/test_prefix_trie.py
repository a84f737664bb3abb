"""The conversation trie against a trie built turn by turn."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from compare import compare, connect
from dirgauge.llm import prefix_trie, queries
from llm.conftest import plain_words

SMALL = "/root/testdata/sf0.001"
SCHEMA = "conv_id bigint, turn bigint, role string, text string"
NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members, children = defaultdict(list), defaultdict(set)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
            if d:
                children[ts[: d - 1]].add(ts[:d])
    out, below = set(), {}
    for node in sorted(members, key=len, reverse=True):
        m = members[node]
        words = len(plain_words(node[-1][1])) if node else 0
        leaves = sum(below[x][0] for x in children[node]) or 1
        saved = (len(m) - 1) * words + sum(below[x][1] for x in children[node])
        below[node] = leaves, saved
        ends = ",".join(map(str, sorted(c for c in m if whole[c] == node)))
        parent = min(members[node[:-1]]) if node else None
        out.add((min(m), len(node), parent, len(m), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def check(df, **options):
    rows = [tuple(r[n] for n in NAMES) for r in prefix_trie.prefix_trie(df, **options).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(map(tuple, df.select("conv_id", "turn", "role", "text").collect()))


ODD = [
    *[(c, t, "user", f"hello {t}") for c in (0, 1, 2, 3, 20, 21, 41) for t in range(5)],
    *[(5, t, "user", "same") for t in (3, 3, 3, None, None)],
    (6, 1, "b", "x y"),  # equal turns go by role and text
    (6, 1, "a", "z"),
    (6, 1, "a", "b b b"),
    (6, 1, "a", None),
    (7, 1, None, "x"),
    (7, 2, None, None),
    (100, 0, "user", "alone"),  # turnless once its head is taken from a conversation that is not there
    (119, 0, "user", "alone"),
    (-3, 0, "user", "below zero"),
    (-3, 1, "user", "  \n"),
    (0, 9, "user", "word " * 20_000),
    (None, 1, "user", "nobody"),
    (1, 0, "user", "hello 0"),
]


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.read.parquet(f"{SMALL}/conversations.parquet")


def test_trie_equals_brute_force(conversations):
    check(conversations)


def test_trie_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    check(df.select("*", *[F.lit("x").alias(n) for n in ("depth", "f01", "part", "pos", "h", "b", "e1", "words", "length")]))


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA)).isEmpty()


def test_a_conversation_over_several_ranges_and_a_list_of_ids_over_several_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BYTES", 50)
    rows = [(40, t, "user", f"t{t % 7}") for t in range(400)]
    rows += [(c, t, "user", f"t{t}") for c in range(100, 400) for t in range(4)]
    rows += [(c, t, "user", f"t{t % 7}") for c in (41, 42, 43) for t in range(200)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(16))


def test_hashes_that_collide_are_replaced(spark, conversations, monkeypatch):
    whole = prefix_trie._hashed
    tried = []

    def weak(df, seed):
        tried.append(seed)
        rows = whole(df, seed)
        return rows.withColumns({e: F.col(e) % 3 for e in ("e1", "e2")}) if seed == 0 else rows

    monkeypatch.setattr(prefix_trie, "_hashed", weak)
    check(conversations)
    assert 1 in tried


def test_trie_equals_its_sql(spark):
    assert compare(queries.op11_prefix_trie(spark, SMALL), connect(SMALL), queries.oracle_sql()["op11_prefix_trie"]) == ""
