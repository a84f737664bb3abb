"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dirgauge.llm import (
    divergence,
    licences,
    mixing,
    near_dups,
    packing,
    passages,
    perplexity_rules,
    ppm,
    prefix_trie,
    sharding,
    suffix_arrays,
    token_counts,
    trusted_text,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = suffix_arrays.mark_contaminated(docs, _table(spark, sf_dir, "benchmark"), ["doc_id"])
    return marked.select(
        "row.doc_id",
        "n_words",
        suffix_arrays.n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        suffix_arrays.is_contaminated().alias("contaminated"),
    )


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = ppm.train(docs.where(~ppm.held_out()))
    found = ppm.predict(docs.select("doc_id", "text"), trees, ["doc_id"]).select("row.doc_id", "lang_pred", "score", "bits")
    return found.select("doc_id", ppm.held_out().alias("held_out"), "lang_pred", "score", F.col("bits").alias("bits_per_byte"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.recount(token_counts.masking_edits(docs))


def op4_perplexity_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity_rules.apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op5_trusted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return trusted_text.classify(docs, _table(spark, sf_dir, "labels"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.allocate(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sharded = sharding.shard(_table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id",
        sharding.text_bytes(F.col("text")).alias("size"),
        sharding.text_crc32(F.col("text")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), 9).alias("grown_shard"),
    )


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.find(docs)


def op9_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(_table(spark, sf_dir, "conversations")).drop("n_words")


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "context", "step_group")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_decontamination,
        op2_language,
        op3_token_counts,
        op4_perplexity_rules,
        op5_trusted_text,
        op6_mixing,
        op7_sharding,
        op8_licences,
        op9_repeated_passages,
        op10_near_duplicates,
        op11_prefix_trie,
        op12_divergence,
        op13_packing,
    )
    return {f.__name__: f for f in found}


_OP6 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, 3 * source_size AS most, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM s
), f AS (
  SELECT *, most < CAST(sum(source_size) OVER () - coalesce(sum(most) OVER b, 0) AS DOUBLE)
            / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) * weight AS at_most
  FROM w
  WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), g AS (
  SELECT source, source_size,
         CASE WHEN at_most THEN CAST(most AS DOUBLE)
              ELSE CAST(sum(source_size) OVER () - sum(CASE WHEN at_most THEN most ELSE 0 END) OVER () AS DOUBLE)
                   / sum(CASE WHEN at_most THEN 0 ELSE weight END) OVER () * weight END AS target
  FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM g
), r AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs,
         CAST(floor(target + 0.5) AS BIGINT) - e.epochs * e.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id NULLS FIRST, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target,
       CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken
FROM r
"""


#: crc32 of the decimal conv_id is taken bit by bit, 8 steps a digit; a node is the chained hash of its turns.
_OP11 = """
WITH RECURSIVE c AS (
  SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS name FROM conversations WHERE conv_id IS NOT NULL
), crc AS (
  SELECT conv_id, name, 0 AS step, 4294967295 AS x FROM c
  UNION ALL
  SELECT conv_id, name, step + 1, xor(y >> 1, CASE WHEN y & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT *, CASE WHEN step % 8 = 0 THEN xor(x, ascii(name[step // 8 + 1])) ELSE x END AS y
        FROM crc WHERE step < 8 * len(name))
), h AS (
  SELECT conv_id, xor(x, 4294967295) % 4 AS h, conv_id - conv_id % 20 AS base FROM crc WHERE step = 8 * len(name)
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT h.conv_id, row_number() OVER (PARTITION BY h.conv_id ORDER BY own, pos) AS d, role, text
  FROM h JOIN (
    SELECT conv_id AS base, pos, role, text, unnest([0, 1]) AS own FROM t) x
  ON CASE WHEN own = 0 THEN x.base = h.base AND pos <= h ELSE x.base = h.conv_id AND pos > h END
), k AS (
  SELECT conv_id, 0 AS d, '' AS node, '' AS above, CAST(0 AS BIGINT) AS words FROM h
  UNION ALL
  SELECT k.conv_id, k.d + 1, sha256(k.node || ' ' || sha256(r.role) || ' ' || sha256(r.text)), k.node,
         len(regexp_extract_all(r.text, '[^\\x20\\x09-\\x0D]+'))
  FROM k JOIN r ON r.conv_id = k.conv_id AND r.d = k.d + 1
), n AS (
  SELECT d, node, above, words, min(conv_id) AS conv_id, count(*) AS n_convs FROM k GROUP BY ALL
), kids AS (
  SELECT d - 1 AS d, above AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), sub AS (
  SELECT k.d, k.node, sum(CASE WHEN kids.node IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.words) AS saved
  FROM n JOIN k ON k.conv_id = n.conv_id AND k.d <= n.d LEFT JOIN kids ON kids.d = n.d AND kids.node = n.node
  GROUP BY ALL
), e AS (
  SELECT d, node, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
  FROM (SELECT conv_id, max(d) AS d, arg_max(node, d) AS node FROM k GROUP BY conv_id) GROUP BY ALL
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, n.n_convs,
       coalesce(kids.n_children, 0) AS n_children, CAST(sub.n_leaves AS BIGINT) AS n_leaves,
       CAST(sub.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM n JOIN sub ON sub.d = n.d AND sub.node = n.node
LEFT JOIN n up ON n.d > 0 AND up.d = n.d - 1 AND up.node = n.above
LEFT JOIN kids ON kids.d = n.d AND kids.node = n.node
LEFT JOIN e ON e.d = n.d AND e.node = n.node
"""


_OP12 = """
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words
  FROM documents
), g AS (
  SELECT DISTINCT lang, source FROM d
), kept AS (
  SELECT lang, term FROM (SELECT lang, unnest(list_distinct(words)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 3
), cells AS (
  SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(words) AS term FROM d)
  SEMI JOIN kept USING (lang, term) GROUP BY ALL
), whole AS (
  SELECT g.lang, g.source, CAST(count(k.term) AS HUGEINT) AS v, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS size
  FROM g LEFT JOIN kept k ON k.lang = g.lang LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  GROUP BY ALL
), p AS (
  SELECT w.lang, w.source, k.term, coalesce(c.n, 0) AS n,
         1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1) // (w.size + w.v) AS p
  FROM whole w JOIN kept k ON k.lang = w.lang
  LEFT JOIN cells c ON c.lang = w.lang AND c.source = w.source AND c.term = k.term
), l AS (
  SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * (sum(n) + 1)
                         // (sum(sum(n)) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q
  FROM p GROUP BY lang, term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p JOIN l USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM u QUALIFY part = 'pair' OR rank <= 200
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_mixing": _OP6, "op11_prefix_trie": _OP11, "op12_divergence": _OP12}
