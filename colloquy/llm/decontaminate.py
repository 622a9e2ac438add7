"""Benchmark decontamination with a distributed positional inverted index.

A benchmark item is cut into windows of consecutive words; a document word inside any occurrence
of a window is hit.  The steps, all in DataFrame functions:

1. count how often the corpus uses each benchmark word (partial counts before the shuffle);
2. windows with a word that the corpus lacks cannot occur and go; the two rarest positions of every
   other window become its anchors;
3. store the postings ``(term, document, position)`` of the anchor terms;
4. shift the list of the rarest anchor by its offset to window starts and intersect it with the
   shifted list of the next one;
5. compare the few remaining starts word by word with the text of their documents, which also
   drops any clash of document keys.

Only postings of anchor terms are shuffled, keyed by term, document and position, so neither a
common word nor a hot document lands in one task.  Benchmark-side tables are broadcast only when
their counted rows are few; beyond that the same joins shuffle.

Defined results: words are runs of digits, letters a-z after lower-casing A-Z, and characters
beyond ASCII; null and empty texts have no words; an item of fewer words than a window is one
window; an item without words has none; items with equal id are one item, and an item with a null
id marks words but is not listed; repeated rows each get the same result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import BROADCAST_ROWS, if_small
from colloquy.session import ensure_checkpoint_dir

WINDOW = 10
_ANCHORS = 2
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    lower = F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


class Benchmark:
    """Windows of a benchmark that the corpus may hold, their items and anchors (checkpointed)."""

    def __init__(self, docs: DataFrame, bench: DataFrame, window: int, item_col: str, bench_text: str, text_col: str):
        ensure_checkpoint_dir(docs.sparkSession)
        w, n = F.col("w"), F.size("w")
        cut = bench.select(F.col(item_col).cast("string").alias("item"), words(F.col(bench_text)).alias("w")).where(n > 0) \
            .select("item", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - (window - 1), F.lit(1))),
                                                  lambda s: F.slice(w, s, window))).alias("words"))
        listed = cut.distinct().checkpoint()
        phrases = listed.select("words").distinct().withColumn("wid", F.monotonically_increasing_id()).checkpoint()
        spelt = phrases.select("wid", F.posexplode("words").alias("at", "term"))
        vocabulary = spelt.select("term").distinct().checkpoint()
        size = vocabulary.count()
        used = docs.select(F.explode(words(F.col(text_col))).alias("term"))
        if size <= BROADCAST_ROWS:
            used = used.join(F.broadcast(vocabulary), "term", "left_semi")
        counts = vocabulary.join(used.groupBy("term").agg(F.count(F.lit(1)).alias("n")), "term", "left") \
            .select("term", F.coalesce("n", F.lit(0)).alias("n")).withColumn("tid", F.monotonically_increasing_id()).checkpoint()
        # a window's own positions: at most ``window`` rows a group
        rarest = Window.partitionBy("wid").orderBy("n", "term", "at")
        ranked = spelt.join(if_small(counts, size), "term").withColumn("rank", F.row_number().over(rarest)) \
            .withColumn("least", F.min("n").over(Window.partitionBy("wid")))
        self.anchors = ranked.where(F.col("least") > 0).where(F.col("rank") <= _ANCHORS) \
            .select("wid", "rank", "tid", "term", "at").checkpoint()
        self.phrases = phrases.join(self.anchors.where("rank = 1").select("wid"), "wid").checkpoint()
        self.items = listed.join(self.phrases, "words").select("wid", "item")
        self.n_anchors, self.n_phrases = self.anchors.count(), self.phrases.count()


def build_postings(docs: DataFrame, terms: DataFrame, n_terms: int, text_col: str = "text") -> DataFrame:
    """``(tid, key, pos)`` of the given ``(term, tid)``; ``docs`` has ``key``.  Positions count from 0."""
    spread = docs.select("key", F.posexplode(words(F.col(text_col))).alias("pos", "term"))
    return spread.join(if_small(terms, n_terms), "term").select("tid", "key", "pos").distinct()


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"))


def _starts(known: Benchmark, index: DataFrame) -> DataFrame:
    """``(wid, key, start)``: where both anchors of a window stand at their distance."""
    first, second = (known.anchors.where(F.col("rank") == r) for r in (1, 2))
    shifted = index.join(if_small(first.select("tid", "wid", "at"), known.n_anchors), "tid") \
        .select("wid", "key", (F.col("pos") - F.col("at")).alias("start")).where(F.col("start") >= 0)
    other = second.select("wid", F.col("tid").alias("tid2"), F.col("at").alias("at2"))
    both = shifted.join(if_small(other, known.n_anchors), "wid", "left")
    alone = both.where("tid2 is null").select("wid", "key", "start")  # windows of one word
    met = both.where("tid2 is not null").withColumn("pos2", (F.col("start") + F.col("at2")).cast("int")) \
        .join(index.select(F.col("tid").alias("tid2"), "key", F.col("pos").alias("pos2")), ["key", "tid2", "pos2"], "left_semi")
    return alone.unionByName(met.select("wid", "key", "start"))


def find_phrases(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", bench_text: str = "text") -> tuple[DataFrame, Benchmark]:
    """Per document with a match: ``(key, n_hit, matches array<struct<wid, start, stop>>)``, stop exclusive."""
    known = Benchmark(docs, bench, window, item_col, bench_text, text_col)
    keyed = _keyed(docs, id_col, text_col)
    index = build_postings(keyed, known.anchors.select("term", "tid").distinct(), known.n_anchors).checkpoint()
    near = _starts(known, index).join(if_small(known.phrases, known.n_phrases), "wid") \
        .groupBy("key").agg(F.collect_list(F.struct("wid", "start", "words")).alias("near")).checkpoint()
    tokens = keyed.join(if_small(near, near.count() * 20), "key").select("key", "near", words(F.col("text")).alias("w"))
    exact = F.filter("near", lambda c: F.slice(F.col("w"), c["start"] + 1, F.size(c["words"])) == c["words"])
    found = tokens.select("key", F.transform(exact, lambda c: F.struct(
        c["wid"].alias("wid"), c["start"].alias("start"), (c["start"] + F.size(c["words"])).alias("stop"))).alias("matches"))
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["stop"] - 1)))))
    return found.where(F.size("matches") > 0).select("key", hit.cast("long").alias("n_hit"), "matches") \
        .dropDuplicates(["key"]).checkpoint(), known


def contamination(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """``(id, n_words, n_hit, n_items, items array<string>)`` for every document."""
    hits, known = find_phrases(docs, bench, window, id_col, text_col, item_col, bench_text)
    listed = hits.select("key", F.explode(F.array_distinct(F.transform("matches", lambda m: m["wid"]))).alias("wid")) \
        .join(known.items, "wid").groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("items"))
    per_key = hits.select("key", "n_hit").join(listed, "key", "left")
    # a row of the result per document, whatever the keys: the left side keeps its rows
    return _keyed(docs, id_col, text_col).select("id", "key", F.size(words(F.col("text"))).cast("long").alias("n_words")) \
        .join(if_small(per_key, hits.count()), "key", "left") \
        .select(F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                F.coalesce("items", F.array().cast("array<string>")).alias("items")) \
        .withColumn("n_items", F.size("items").cast("long"))


def find_near(docs: DataFrame, bench: DataFrame, window: int = WINDOW, span: int = 2 * WINDOW, id_col: str = "doc_id",
              text_col: str = "text", item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """Proximity matches ``(id, item, start)``: some ``span`` consecutive words of the document hold every
    word of a window, in any order.  ``start``: the position of the window's rarest word."""
    known = Benchmark(docs, bench, window, item_col, bench_text, text_col)
    keyed = _keyed(docs, id_col, text_col)
    first = known.anchors.where("rank = 1")
    index = build_postings(keyed, first.select("term", "tid").distinct(), known.n_anchors)
    near = index.join(if_small(first.select("tid", "wid"), known.n_anchors), "tid").join(known.phrases, "wid") \
        .groupBy("key").agg(F.collect_list(F.struct("wid", "pos", "words")).alias("near")).checkpoint()
    tokens = keyed.join(if_small(near, near.count() * 20), "key").select("id", "near", words(F.col("text")).alias("w"))

    def together(c: Column) -> Column:
        starts = F.sequence(F.greatest(c["pos"] - (span - 2), F.lit(1)), c["pos"] + 1)
        return F.exists(starts, lambda s: F.size(F.array_except(c["words"], F.slice(F.col("w"), s, span))) == 0)

    return tokens.select("id", F.explode(F.filter("near", together)).alias("m")) \
        .select("id", F.col("m.wid").alias("wid"), F.col("m.pos").alias("start")).join(known.items, "wid") \
        .select(F.col("id").alias(id_col), "item", "start").distinct()


def keep_clean(docs: DataFrame, bench: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", bench_text: str = "text") -> DataFrame:
    """The documents, all columns kept, in which no window occurs."""
    hits, _ = find_phrases(docs, bench, window, id_col, text_col, item_col, bench_text)
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    return docs.withColumn("__key", key).join(if_small(hits.select(F.col("key").alias("__key")), hits.count()), "__key", "left_anti") \
        .select(*docs.columns)
