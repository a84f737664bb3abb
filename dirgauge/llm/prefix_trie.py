"""The prefix trie of conversations that share their first turns, from composable fingerprints.

A rebuilt conversation is a head taken from another one and a tail of its own. No rebuilt text is made.
A turn's fingerprint has LANES parts; that of n turns is the sum of turn i times r^i in a prime field.
Together with n these form a monoid: (n, u) followed by (m, v) is (n + m, u + v r^n). So running products
are taken once over the stored turns, in sorted ranges whose products are carried from one range to the
next, and the fingerprint of every prefix of a rebuilt conversation follows from the product of the other
one's head and two products of its own by arithmetic on a few numbers.

Prefixes with equal length and fingerprint are one node. That is verified: the members of a node must
agree in the hash of their last turn (then they agree in the fingerprint one turn earlier as well), and
stored turns with equal hashes are compared in full where they are stored. Should either fail, the trie is made
again with other hashes.

Sums over subtrees need no walk through the tree. A node is owned by its smallest member, which then also owns
all nodes further down its path; so the nodes below a node are, member by member, a piece of that
member's path, and their sum is a sum over members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dirgauge.llm import reach
from dirgauge.llm import words as W
from dirgauge.operators.joins import heavy_keys, lookup_join
from dirgauge.session import materialise

#: Conversations c - c % SHARE to c share a head; its turns are crc32(c) % HEADS.
SHARE, HEADS = 20, 4
#: `[^\x20\x09-\x0D]+`
WORD = r"[^\x20\x09-\x0D]+"

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_597_334_677, 1_852_477_109, 2_045_171_893)
LANES = range(len(BASES))
TRIES = 8
#: Bytes of one piece of a long list of ids.
ID_BYTES = 1 << 16

_U = [f"u{i}" for i in LANES]
_Q = [f"q{i}" for i in LANES]
_KEY = ["depth", "f01", "f23"]


def _hashed(conversations: DataFrame, seed: int) -> DataFrame:
    """conv_id, turn, role, text (never NULL) and two hashes of role and text."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        "turn",
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    return rows.withColumn("e1", F.xxhash64(F.lit(2 * seed), "role", "text")).withColumn("e2", F.xxhash64(F.lit(2 * seed + 1), "role", "text"))


def _powers(base: int, n: np.ndarray) -> np.ndarray:
    """base ** n in the field, for an array of n."""
    out, square, n = np.ones(len(n), np.int64), base, n.copy()
    while n.any():
        out = np.where(n & 1, out * square % PRIME, out)
        square = square * square % PRIME
        n >>= 1
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to their places and running products, as if every range began a conversation."""
    part = TaskContext.get().partitionId()
    last, count, words, sums = None, 0, 0, [0] * len(BASES)
    for batch in batches:
        if not batch.num_rows:
            continue
        conv = W.column(batch, "conv_id").to_numpy()
        n = len(conv)
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = conv[0] != last
        start = np.flatnonzero(new) if new[0] else np.concatenate([[0], np.flatnonzero(new)])
        size = np.diff(np.concatenate([start, [n]]))
        first = np.repeat(start, size)
        going = np.zeros(n, np.int64)  # 1 in the rows that go on with the conversation of the batch before
        if not new[0]:
            going[: size[0]] = 1
        pos = np.arange(n) - first + 1 + going * count

        def running(values: np.ndarray, before: int) -> np.ndarray:
            total = np.cumsum(values)
            return total - (total[first] - values[first]) + going * before

        spoken = W.column(batch, "words").to_numpy()
        total = running(spoken, words)
        columns = [np.full(n, part, np.int64), conv, pos, spoken, total]
        elements = [W.column(batch, e).to_numpy().view(np.uint64) for e in ("e1", "e2")]
        lanes = [x for e in elements for x in ((e & np.uint64(PRIME)).astype(np.int64) % PRIME, (e >> np.uint64(33)).astype(np.int64) % PRIME)]
        after, before = [], []
        for i in LANES:
            term = (lanes[i] + 1) * _powers(BASES[i], pos) % PRIME
            after.append(running(term, sums[i]) % PRIME)
            before.append((after[i] - term) % PRIME)
        last, count, words, sums = conv[-1], int(pos[-1]), int(total[-1]), [int(a[-1]) for a in after]
        columns += after + before
        names = ["part", "conv_id", "pos", "words", "total", *_U, *_Q]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c.astype(np.int64)) for c in columns] + [W.column(batch, "e1"), W.column(batch, "e2")], names=names + ["e1", "e2"]
        )


def _carried(scanned: DataFrame) -> DataFrame:
    """The products of whole conversations: what came before a range is put before its first one.

    One row per task of the sort comes to the driver.
    """
    state = F.struct("conv_id", "pos", "total", *_U)
    ends = scanned.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(state).alias("end")).orderBy("part").collect()
    carries, open_ = [], None
    for row in ends:
        end = row["end"].asDict()
        if open_ and open_["conv_id"] == row["first"]:
            powers = [pow(BASES[i], open_["pos"], PRIME) for i in LANES]
            carries.append((row["part"], open_["conv_id"], open_["pos"], open_["total"], *[open_[u] for u in _U], *powers))
            if end["conv_id"] == row["first"]:
                end["pos"] += open_["pos"]
                end["total"] += open_["total"]
                for i, u in enumerate(_U):
                    end[u] = (open_[u] + end[u] * powers[i]) % PRIME
        open_ = end
    if not carries:
        return scanned.drop("part")
    names = ["part", "c_conv", "c_pos", "c_total", *[f"c_{u}" for u in _U], *[f"c_r{i}" for i in LANES]]
    table = scanned.sparkSession.createDataFrame(carries, ", ".join(f"{n} bigint" for n in names))
    on = F.coalesce(F.col("c_conv") == F.col("conv_id"), F.lit(False))
    shifted = {c: F.when(on, F.col(c) + F.col(f"c_{c}")).otherwise(F.col(c)) for c in ("pos", "total")}
    for i in LANES:
        for c in (_U[i], _Q[i]):
            shifted[c] = F.when(on, (F.col(f"c_{_U[i]}") + F.col(c) * F.col(f"c_r{i}")) % PRIME).otherwise(F.col(c))
    return scanned.join(F.broadcast(table), "part", "left").withColumns(shifted).drop(*names)


def running_products(hashed: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), words, total (words so far), u* and q* (products with and without the turn),
    e1, e2 for every turn. Turns go by `turn`, NULL first; equal ones by role, then text."""
    spark = reach(hashed.sparkSession)
    ties = materialise(hashed.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("t_conv"), F.col("turn").alias("t_turn")), "ties")
    words = F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words")
    order = ["conv_id", "turn"]
    if not ties.isEmpty():  # only then must texts go through the sort
        same = (F.col("conv_id") == F.col("t_conv")) & F.col("turn").eqNullSafe(F.col("t_turn"))
        hashed = hashed.join(ties, same, "left")
        hashed = hashed.withColumns({f"by_{c}": F.when(F.col("t_conv").isNotNull(), F.col(c)) for c in ("role", "text")})
        order += ["by_role", "by_text"]
    rows = materialise(hashed.select(*order, "e1", "e2", words), "turns")
    names = ["part", "conv_id", "pos", "words", "total", *_U, *_Q, "e1", "e2"]
    scanned = rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_scan, ", ".join(f"{n} bigint" for n in names))
    return materialise(_carried(materialise(scanned, "scan")), "products")


def _pick(name: str, k: Column, heads: int) -> Column:
    """The value of a column of head k, 0 for none."""
    out = F.lit(0).cast("bigint")
    for i in range(heads - 1, 0, -1):
        out = F.when(k == i, F.coalesce(F.col(f"{name}_{i}"), F.lit(0))).otherwise(out)
    return out


def _pack(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("bigint"), 31).bitwiseOR(low.cast("bigint"))


def _members(products: DataFrame, share: int, heads: int) -> tuple[DataFrame, dict]:
    """A row for each prefix of each rebuilt conversation, the empty one included, and the conversations
    that hold more turns than an even task."""
    own_head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    kept = [*_U, "total", "e1", "e2"]
    first = [F.max(F.when(F.col("pos") == k, F.col(c))).alias(f"{c}_{k}") for k in range(1, heads) for c in kept]
    convs = products.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("total").alias("said"), *first)
    convs = materialise(convs.withColumn("h", own_head).withColumn("b", F.expr(f"conv_id - conv_id % {share}")), "conversations")
    base = convs.select(F.col("conv_id").alias("b"), F.col("n").alias("b_n"), *[F.col(f"{c}_{k}").alias(f"b_{c}_{k}") for k in range(1, heads) for c in kept])
    both = convs.join(base, "b", "left").withColumn("hp", F.least("h", F.coalesce("b_n", F.lit(0))))
    at, lost = F.least("h", "n"), F.col("h") - F.col("hp")
    mult = [F.element_at(F.array(*[F.lit(pow(r, -k, PRIME)) for k in range(heads)]), (lost + 1).cast("int")) for r in BASES]
    for i in LANES:
        both = both.withColumn(f"m{i}", mult[i])
        head = _pick(f"b_{_U[i]}", F.col("hp"), heads)
        both = both.withColumn(f"a{i}", (head + PRIME - _pick(_U[i], at, heads) * F.col(f"m{i}") % PRIME) % PRIME)
    both = both.withColumn("more", _pick("b_total", F.col("hp"), heads) - _pick("total", at, heads))
    both = both.withColumn("length", F.col("hp") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).withColumn("whole", F.col("said") + F.col("more"))
    both = materialise(both, "rebuilt")

    def node(depth, f, p, e1, e2, words, total):
        nothing = F.lit(None).cast("bigint")
        below = [_pack(p[0], p[1]), _pack(p[2], p[3])] if p else [nothing, nothing]
        values = [depth, _pack(f[0], f[1]), _pack(f[2], f[3]), *below, e1, e2, words, total]
        return [v.cast("bigint").alias(n) for v, n in zip(values, ("depth", "f01", "f23", "p01", "p23", "e1", "e2", "words", "total"))]

    zero = [F.lit(0)] * len(BASES)
    steps = [F.struct(*node(F.lit(0), zero, None, F.lit(0), F.lit(0), F.lit(0), F.lit(0)))]
    for k in range(1, heads):
        now = [F.col(f"b_{u}_{k}") for u in _U]
        prior = [F.col(f"b_{u}_{k - 1}") for u in _U] if k > 1 else zero
        said = F.col(f"b_total_{k - 1}") if k > 1 else F.lit(0)
        steps.append(F.struct(*node(F.lit(k), now, prior, F.col(f"b_e1_{k}"), F.col(f"b_e2_{k}"), F.col(f"b_total_{k}") - said, F.col(f"b_total_{k}"))))
    head = both.select("conv_id", "length", "whole", F.explode(F.slice(F.array(*steps), F.lit(1), (F.col("hp") + 1).cast("int"))).alias("s"))
    head = head.select("conv_id", "length", "whole", "s.*")

    info = both.select("conv_id", "length", "whole", "hp", "h", "more", *[f"{x}{i}" for x in "ma" for i in LANES])
    heavy = heavy_keys(products, "conv_id")
    tail = lookup_join(products.where(F.col("pos") > own_head), info, "conv_id", heavy, "inner", "pos")
    moved = [[(F.col(c[i]) * F.col(f"m{i}") + F.col(f"a{i}")) % PRIME for i in LANES] for c in (_U, _Q)]
    depth = F.col("pos") + F.col("hp") - F.col("h")
    tail = tail.select("conv_id", "length", "whole", *node(depth, *moved, F.col("e1"), F.col("e2"), F.col("words"), F.col("total") + F.col("more")))
    return materialise(head.unionByName(tail), "members"), heavy


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) to a digest per key, or to pieces of its list where it is long or may go on
    in another range."""
    part = TaskContext.get().partitionId()
    key, buffer, size, broken, seq, first = None, [], 0, False, 0, True
    out: list[tuple] = []

    def close(edge: bool) -> None:
        nonlocal seq
        text = ",".join(buffer)
        if edge or broken:
            out.append((*key, part, seq, text, None))
            seq += 1
        else:
            out.append((*key, part, 0, None, hashlib.sha256(text.encode()).hexdigest()))

    for batch in batches:
        for *found, conv in zip(*[c.to_pylist() for c in batch.columns]):
            if found != key:
                if key is not None:
                    close(first)
                    first = False
                key, buffer, size, broken = found, [], 0, False
            elif size >= ID_BYTES:
                out.append((*key, part, seq, ",".join(buffer), None))
                buffer, size, broken, seq = [], 0, True, seq + 1
            buffer.append(str(conv))
            size += len(buffer[-1]) + 1
        if out:
            yield _piece_batch(out)
            out = []
    if key is not None:
        close(True)
        yield _piece_batch(out)


_PIECES = "depth bigint, f01 bigint, f23 bigint, part int, seq bigint, ids string, ends_sha256 string"


def _piece_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split()[0] for f in _PIECES.split(", ")])


def _digest_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state, out = None, None, []
    for batch in batches:
        for *found, ids in zip(*[W.column(batch, c).to_pylist() for c in (*_KEY, "ids")]):
            if found == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((*key, state.hexdigest()))
                key, state = found, hashlib.sha256()
            state.update(ids.encode())
    if key is not None:
        out.append((*key, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])


def _digests(ends: DataFrame) -> DataFrame:
    """depth, f01, f23, ends_sha256: the digest of the sorted conv_ids of each key.

    Ids are sorted in ranges, which may split a key. A key inside one range is done there. Others leave
    their text in pieces; SHA-256 takes its input one after the other, so the pieces of one key then
    stream through one task, 64 KB at a time.
    """
    order = [*_KEY, "conv_id"]
    lists = materialise(ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_id_lists, _PIECES), "ends")
    pieces = lists.where("ids IS NOT NULL").repartition(*_KEY).sortWithinPartitions(*_KEY, "part", "seq")
    joined = pieces.mapInArrow(_digest_pieces, "depth bigint, f01 bigint, f23 bigint, ends_sha256 string")
    return lists.where("ids IS NULL").select(*_KEY, "ends_sha256").unionByName(joined)


def _is_sound(conversations: DataFrame, products: DataFrame, nodes: DataFrame, seed: int) -> bool:
    """Whether the members of every node are equal: no two different turns in one node or under one hash."""
    if not nodes.where("e1 <> max_e1 OR e2 <> max_e2").isEmpty():
        return False
    shared = materialise(products.groupBy("e1", "e2").agg(F.count("*").alias("n")).where("n > 1").select("e1", "e2"), "shared-turns")
    stored = _hashed(conversations, seed).join(shared, ["e1", "e2"], "left_semi")
    contents = stored.groupBy("e1", "e2", "role", "text").agg(F.count("*").alias("n"))
    return contents.groupBy("e1", "e2").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def prefix_trie(conversations: DataFrame, share: int = SHARE, heads: int = HEADS) -> DataFrame:
    """A row per node of the trie of rebuilt conversations, from `conversations` (conv_id, turn, role, text).

    Conversation c is rebuilt from the first h turns of c - c % share and its own turns after its first
    h, where h = crc32(c in decimal) % heads. conv_id: smallest member of the node; depth: turns;
    parent_conv_id: that of the node one turn shorter; n_convs: members; n_children, n_leaves: child
    nodes, childless nodes at or below it; saved_tokens: over all nodes at or below it, members but one
    times the words of the last text; ends_sha256: of the conv_ids that end there; n_words: words of the
    last text.

    Rows without conv_id belong to no conversation. NULL role or text is empty, NULL turn comes first,
    equal turns go by role, then text; repeated rows are repeated turns. No conversation, no rows.
    """
    for seed in range(TRIES):
        products = running_products(_hashed(conversations, seed))
        members, heavy = _members(products, share, heads)
        ends = F.col("depth") == F.col("length")
        nodes = members.groupBy(*_KEY).agg(
            F.count("*").alias("n_convs"),
            F.min("conv_id").alias("conv_id"),
            F.max("length").alias("longest"),
            F.max("words").alias("n_words"),
            *[F.min(c).alias(c) for c in ("p01", "p23", "e1", "e2")],
            *[F.max(c).alias(f"max_{c}") for c in ("e1", "e2")],
        )
        nodes = materialise(nodes, "nodes")
        if _is_sound(conversations, products, nodes, seed):
            break
    else:
        raise RuntimeError(f"no {TRIES} hashes told all turns apart")

    own = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("own_from"),
        F.sum("n_words").alias("own_words"),
        F.max((F.col("depth") == F.col("longest")).cast("bigint")).alias("leaf"),
        F.min(F.when(F.col("n_convs") == 1, F.col("depth"))).alias("alone_from"),
    )
    met = lookup_join(members, materialise(own, "owners"), "conv_id", heavy, "left", "depth").where("alone_from IS NULL OR depth < alone_from")
    from_here = F.col("whole") - F.col("total") + F.col("words")
    sums = met.groupBy(*_KEY).agg(
        F.sum(F.expr("own_from <= depth + 1 AND depth < length").cast("bigint")).alias("children"),
        F.sum("leaf").alias("leaves"),
        F.sum(F.when(F.expr("own_from <= depth"), 0).otherwise(from_here - F.coalesce("own_words", F.lit(0)))).alias("saved"),
    )
    named = nodes.withColumn("above", F.concat_ws(":", F.col("depth") - 1, "p01", "p23"))
    shared = nodes.where("n_convs > 1").select(F.concat_ws(":", *_KEY).alias("above"), F.col("conv_id").alias("owner"))
    named = lookup_join(named, shared, "above", heavy_keys(named, "above"), "left", "conv_id")
    out = named.join(sums, _KEY, "left").join(_digests(members.where(ends)), _KEY, "left")
    alone = F.col("n_convs") == 1
    return out.select(
        "conv_id",
        "depth",
        F.when(F.col("depth") > 0, F.coalesce("owner", "conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(alone, (F.col("depth") < F.col("longest")).cast("bigint")).otherwise(F.coalesce("children", F.lit(0))).alias("n_children"),
        F.when(alone, F.lit(1)).otherwise(F.coalesce("leaves", F.lit(0))).cast("bigint").alias("n_leaves"),
        F.when(alone, F.lit(0)).otherwise(F.coalesce("saved", F.lit(0))).cast("bigint").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        "n_words",
    )
