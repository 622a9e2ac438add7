"""Registered queries of the corpus operators: each applies its operator to its whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import (
    bpe, decontaminate, forest, langid, licenses, negatives, pieces, pii, sharding, spans, spelling, topk, toxicity)
from colloquy.llm.common import documents, held_out, read
from colloquy.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str):
    def put(fn):
        QUERIES[name] = fn
        return fn
    return put


@register("op5_byte_prefix_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 contiguous shards of near equal bytes."""
    ensure_checkpoint_dir(spark)
    return sharding.shard_by_bytes(documents(spark, sf_dir), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@register("op7_trie_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token digests of every document."""
    return bpe.encode_texts(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep=())


@register("op10_segmentation_langid")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; learned where crc32(doc_id) mod 5 is not 0."""
    ensure_checkpoint_dir(spark)
    docs, out = documents(spark, sf_dir), held_out(F.col("doc_id"), 5, 0)
    model = langid.train(docs.where(~out), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.classify(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@register("op2_grammar_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; learned where crc32(doc_id) mod 4 is not 2."""
    ensure_checkpoint_dir(spark)
    docs, labels = documents(spark, sf_dir), read(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(~held_out(F.col("doc_id"), 4, 2)))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE_SQL["op1_positional_index"] = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS p
        FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
cut AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS p
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT DISTINCT doc_id, item_id, s, n FROM cut JOIN win USING (n, p)),
pos AS (SELECT doc_id, CAST(count(DISTINCT k) AS BIGINT) AS n_hit
        FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)"""


@register("op1_positional_index")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of 10-word benchmark windows in every document."""
    found = decontaminate.contamination(documents(spark, sf_dir), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@register("op3_disclosure_pii")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data, and the words that disclose it, in every document."""
    found = pii.find(documents(spark, sf_dir))
    count = [pii.count_kind(F.col("base"), k).alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *count, F.sha2(pii.render(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.render(F.concat("base", "added", "elsewhere")).alias("spans"))


@register("op8_minhash_forest")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group and number of links of every document."""
    return forest.near_duplicates(documents(spark, sf_dir))


ORACLE_SQL["op4_norm_sorted_topk"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER w AS INTEGER) AS rank, c.vec_id AS vec_id,
       CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
WINDOW w AS (PARTITION BY q.vec_id ORDER BY list_dot_product(q.e, c.e) DESC, c.vec_id)
QUALIFY row_number() OVER w <= 20"""


@register("op4_norm_sorted_topk")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every 20th vector."""
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@register("op6_sentence_spans")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences of repeated runs."""
    return spans.remove_repeats(documents(spark, sf_dir), report=True)


@register("op9_patience_licenses")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices in every document."""
    return licenses.scan_licenses(documents(spark, sf_dir))


# crc32 of '<doc_id>:<run>' as a fold over the bits of its UTF-8 bytes (code points up to U+00FF), lowest first
ORACLE_SQL["op11_reduced_spelling"] = """
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(unnest(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{00FF}]{5,}')),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents WHERE text IS NOT NULL),
counted AS (SELECT id, w, count(*) AS n FROM runs GROUP BY ALL),
bytes AS (SELECT id, w, n, flatten(list_transform(string_split(id || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)]
         ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM counted),
hashed AS (SELECT w, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(b, lambda x:
         [CAST(x & 1 AS BIGINT), (x >> 1) & 1, (x >> 2) & 1, (x >> 3) & 1, (x >> 4) & 1, (x >> 5) & 1, (x >> 6) & 1, (x >> 7) & 1]))),
         lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384)), CAST(4294967295 AS BIGINT)) AS h FROM bytes),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 97 = 0
         THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed)
      WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
masked AS (SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS m FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
less AS (SELECT DISTINCT word, n, left(word, i - 1) || substr(word, i + 1) AS m FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM masked a JOIN masked b ON a.m = b.m AND a.word <> b.word
         UNION ALL SELECT l.word, v.word, v.n FROM less l JOIN v ON l.m = v.word
         UNION ALL SELECT v.word, l.word, l.n FROM less l JOIN v ON l.m = v.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
         row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form,
      CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n FROM v LEFT JOIN (SELECT * FROM best WHERE r = 1) b ON v.word = b.word),
walk AS (SELECT word, word AS at FROM f UNION ALL SELECT walk.word, f.form FROM walk JOIN f ON walk.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, walk.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN walk ON f.word = walk.word JOIN f g ON g.word = walk.at AND g.form IS NULL"""


@register("op11_reduced_spelling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near words, form and root of every word of the documents."""
    return spelling.group_variants(spelling.words_of(documents(spark, sf_dir)))


ORACLE_SQL["op12_angular_negatives"] = """
WITH v AS (SELECT DISTINCT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
           list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id, positive_score,
       s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
QUALIFY row_number() OVER w <= 3"""


@register("op12_angular_negatives")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of the first positives of every 50th vector; every 7th label is the next one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(read(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 50 == 0)


@register("op13_piece_prefixes")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece digests of every document."""
    return pieces.encode_texts(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), keep=())
