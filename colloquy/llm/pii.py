"""Information-theoretic sanitisation of personal data, in DataFrame functions only.

Base entities (email, ip, card, phone) are found by patterns.  Words that stand near an entity can
still give it away, so the corpus is asked how strongly they do: a word ``t`` carries

    disclosure(t, e) = log(p(e, t) / (p(e) p(t))) / -log p(e)

of the information of entity ``e`` (0: none, 1: whoever reads ``t`` knows ``e``), where ``p`` counts
documents: those that hold ``e``, those that hold ``t`` (over the whole corpus), and those that hold
``t`` within ``CONTEXT`` characters of ``e``.  A word counts by the most it discloses of any entity.
In every document, also where no entity is, every occurrence of a word from ``REMOVE`` on is removed
and one from ``GENERALISE`` on is replaced by its kind.  A pair seen in one text only is no evidence
and is left alone.

The corpus is read once for entities (text is kept for documents that have any), once to count the
documents of the context words and once for the places of the disclosing ones; counts are combined
before they are shuffled, and texts move only if the disclosing words are too many to broadcast.

Patterns are possessive or start where a run starts, so long runs cost linear time; they match what
the plain patterns match, leftmost and without overlap.

Defined results: null and empty texts have no spans; a failing match (ip part over 255, card digits
that fail Luhn or are not 16 to 19, phone digits not 8 to 15) is dropped without a retry; repeated
rows repeat their result; entities are compared by kind and exact text; other columns are kept by
``sanitise`` and not read.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import BROADCAST_ROWS, if_small
from colloquy.session import ensure_checkpoint_dir

KINDS = ("email", "ip", "card", "phone")
GENERALISED, REMOVED = "generalised", "removed"
GENERALISE, REMOVE = 0.75, 0.9
CONTEXT = 80
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: A check that is cheap, and the pattern to run where it holds.
_PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++"),
    "ip": (".", r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++"),
    # whole runs of 16 to 19 digits only
    "card": ("", r"[0-9](?<![0-9][0-9])(?<![0-9][\x20-][0-9])(?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])?"  # of a run of digits, so "" is zero
_WORD = r"[^\p{L}]+"
_SPAN = "array<struct<kind:string,start:int,stop:int,value:string>>"


def _passes(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _spans(kind: Column | str, text: Column, pattern: Column) -> Column:
    """Matches with their places: the pieces between them, and they, add up to the text."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc: Column, m: Column) -> Column:
        at = acc["at"] + m["gap"]
        stop = at + F.length(m["value"])
        span = F.struct(kind.alias("kind"), at.alias("start"), stop.alias("stop"), m["value"].alias("value"))
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), found.alias("value")), start,
                       lambda acc, m: F.when(m["value"].isNull(), acc).otherwise(add(acc, m)), lambda acc: acc["out"])


def _check(kind: str, span: Column) -> Column:
    return _passes(kind, span["value"])


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, by kind as listed, then by start."""
    parts = []
    for kind, (mark, pattern) in _PATTERNS.items():
        may = text.contains(mark) & text.rlike(pattern) if mark else text.rlike(pattern)
        found = F.filter(_spans(kind, text, F.lit(pattern)), partial(_check, kind))
        parts.append(F.when(may, found).otherwise(F.array().cast(_SPAN)))
    return F.concat(*parts)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, base, text)`` of every document, checkpointed; text only where there is an entity."""
    ensure_checkpoint_dir(docs.sparkSession)
    t = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"),
                       F.xxhash64(t).alias("of"), base_spans(t).alias("base"), t.alias("text")) \
        .withColumn("text", F.when(F.size("base") > 0, F.col("text"))).checkpoint()


def _contexts(found: DataFrame) -> DataFrame:
    """``(key, of, kind, value, term)``: the whole words near an entity, once per document."""
    s = F.col("s")
    # with one character more: a word that the window cuts goes, one that starts or ends with it stays
    before = F.substring(F.col("text"), F.greatest(s["start"] - CONTEXT - 1, F.lit(0)) + 1, F.least(F.lit(CONTEXT + 1), s["start"]))
    before = F.when(s["start"] > CONTEXT, F.regexp_replace(before, r"^\S*", "")).otherwise(before)
    after = F.substring(F.col("text"), s["stop"] + 1, F.lit(CONTEXT + 1))
    after = F.when(s["stop"] + CONTEXT < F.length("text"), F.regexp_replace(after, r"\S*$", "")).otherwise(after)
    # pieces with digits or @ belong to other entities
    near = F.lower(F.regexp_replace(F.concat(before, F.lit(" "), after), r"\S*[@0-9]\S*", " "))
    return found.where(F.size("base") > 0).select("key", "of", "text", F.explode("base").alias("s")) \
        .select("key", "of", s["kind"].alias("kind"), s["value"].alias("value"), F.explode(F.split(near, _WORD)).alias("term")) \
        .where("term <> ''").distinct()


def disclosures(docs: DataFrame, found: DataFrame, text_col: str = "text", least: float = GENERALISE) -> DataFrame:
    """``(kind, value, term, disclosure)`` of the pairs that reach ``least``."""
    n = found.count()
    contexts = _contexts(found)
    # seen in two texts at least
    pairs = contexts.groupBy("kind", "value", "term") \
        .agg(F.countDistinct("key").alias("together"), F.min("of").alias("a"), F.max("of").alias("b")) \
        .where(F.col("a") != F.col("b")).drop("a", "b").checkpoint()
    holders = found.select("key", F.explode("base").alias("s")) \
        .groupBy(F.col("s.kind").alias("kind"), F.col("s.value").alias("value")).agg(F.countDistinct("key").alias("held"))
    terms = pairs.select("term").distinct().checkpoint()
    n_terms = terms.count()
    held = docs.select(F.explode(F.array_distinct(F.split(F.lower(F.col(text_col)), _WORD))).alias("term"))
    if n_terms <= BROADCAST_ROWS:
        held = held.join(F.broadcast(terms), "term", "left_semi")
    used = held.groupBy("term").agg(F.count(F.lit(1)).alias("used"))
    rate = F.col("held") / F.lit(float(max(n, 2)))
    share = F.col("together") / F.greatest(F.col("used"), F.col("together"))
    # an entity in every document has no information to disclose
    score = F.when(rate < 1, 1 + F.log(share) / -F.log(rate)).otherwise(F.lit(0.0))
    return pairs.join(used, "term").join(holders, ["kind", "value"]).select("kind", "value", "term", score.alias("disclosure")) \
        .where(F.col("disclosure") >= least)


def _term_spans(docs: DataFrame, found: DataFrame, strong: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(key, added, elsewhere)``: places of the disclosing words in all documents that hold any;
    ``added``: of those that stand near their entity there, ``elsewhere``: of all others."""
    n = strong.count()
    strongest = strong.groupBy("term").agg(F.max("disclosure").alias("d"))
    text = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    words = text.select("key", "text", F.explode(F.array_distinct(F.split(F.lower("text"), _WORD))).alias("term"))
    if n <= BROADCAST_ROWS:  # texts don't move
        hits = words.join(F.broadcast(strongest), "term")
    else:
        held = words.select("key", "term").distinct().join(strongest, "term").groupBy("key").agg(F.collect_list(F.struct("term", "d")).alias("terms"))
        hits = text.join(held, "key").select("key", "text", F.inline("terms"))
    word = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}_])(?:"), F.col("term"), F.lit(r")(?![\p{L}\p{N}_])"))
    kind = F.when(F.col("d") >= REMOVE, REMOVED).otherwise(GENERALISED)
    hits = hits.select("key", "term", _spans(kind, F.col("text"), word).alias("places"), F.lit(False).alias("near"))
    near = _contexts(found).join(if_small(strong, n), ["kind", "value", "term"]) \
        .select("key", "term", F.lit(None).cast(_SPAN).alias("places"), F.lit(True).alias("near"))
    per = hits.union(near).groupBy("key", "term").agg(F.first("places", ignorenulls=True).alias("places"), F.max("near").alias("near"))
    pick = lambda which: F.array_sort(F.flatten(F.collect_list(F.when(which, F.col("places")))))
    return per.groupBy("key").agg(pick(F.col("near")).alias("added"), pick(~F.col("near")).alias("elsewhere"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, base, added, elsewhere)`` of every document: base spans, spans of words that disclose an entity
    they stand near, and spans of disclosing words away from their entity."""
    found = detect(docs, id_col, text_col)
    more = _term_spans(docs, found, disclosures(docs, found, text_col).checkpoint(), id_col, text_col).checkpoint()
    none = F.array().cast(_SPAN)
    return found.select("id", "key", "base").join(if_small(more, more.count() * 10), "key", "left") \
        .select(F.col("id").alias(id_col), "key", "base", F.coalesce("added", none).alias("added"), F.coalesce("elsewhere", none).alias("elsewhere"))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def render(spans: Column) -> Column:
    """``kind:start:stop`` of spans, comma-joined: by kind (``KINDS`` as listed, then the others), then start."""
    kinds = F.array(*[F.lit(k) for k in (*KINDS, GENERALISED, REMOVED)])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        F.array_position(kinds, s["kind"]).alias("rank"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(text: Column, spans: Column) -> Column:
    """The text with spans replaced: entities and generalised words by their kind, others by nothing.
    Where spans overlap, the first one that starts stands for all."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    label = lambda k: F.when(k == REMOVED, "").when(k == GENERALISED, "[WORD]").otherwise(F.concat(F.lit("["), F.upper(k), F.lit("]")))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def add(acc: Column, s: Column) -> Column:
        piece = F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), label(s["kind"]))
        return F.struct(F.greatest(acc["at"], s["stop"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    end = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(ordered, begin, add, end))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with sanitised text (null stays null)."""
    marks = find(docs, id_col, text_col).select(F.col("key").alias("__key"), F.concat("base", "added", "elsewhere").alias("__spans")) \
        .where(F.size("__spans") > 0).dropDuplicates(["__key"]).checkpoint()
    keyed = docs.withColumn("__key", F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)))
    joined = keyed.join(if_small(marks, marks.count() * 10), "__key", "left")
    clean = F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(redact(F.col(text_col), F.col("__spans")))
    return joined.withColumn(text_col, clean).select(*docs.columns)
