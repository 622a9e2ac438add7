"""Spelling variant grouping over a reduced alphabet.

Letters are hashed to ``SYMBOLS`` symbols, which turns words into reduced words; two words within one
edit have reduced words within one edit.  Of every distinct reduced word the full one-edit
neighbourhood over the few symbols is generated (itself, every deletion, replacement and insertion),
joined with the reduced vocabulary, and the words behind each pair of reduced words found are
compared as they are written.

A reduced word travels as a 64-bit key (a polynomial in its symbols), so all neighbours follow from
running sums in constant time each, and a very long word costs its length, not its square.  Keys only
propose pairs: every pair is verified on the words, and pairs of keys are made distinct, so equal keys
of different reduced words change nothing.  Rows of neighbours hold two keys, no words.

Nothing is gathered: words are counted with partial sums, the joins are on keys (AQE splits a key that
many words share), and roots are found by pointer jumping, whose rounds grow with the log of the log of
the highest count, as a form has at least twice the count of its word.

Defined results: null and empty texts have no words; a null id counts as empty text in the typo rule;
repeated rows count each; ties in n go to the smallest word in code-point order; no words give an empty
table; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.session import ensure_checkpoint_dir

SYMBOLS = 4
#: Fixed: a run of these is a word; only A-Z are lower-cased.
LETTERS = "A-Za-z\\u00C0-\\u00FF"
#: Neighbours generated at once, and characters up to which the edit distance itself is computed.
CHUNK, SHORT = 1_000_000, 64
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def words_of(docs: DataFrame, min_length: int = 5, min_count: int = 3, typo_every: int = 97, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``(word, n)``: words of ``min_length`` letters or more that occur ``min_count`` times or more.

    Where ``typo_every`` divides the crc32 ``h`` of ``id:word``, letter ``h % length`` is left out first."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(
        F.translate(F.coalesce(text_col, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
        F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))).alias("w"))
    hashed = runs.select("w", F.crc32(F.concat("id", F.lit(":"), "w").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("w")).cast("int")
    word = F.when(F.col("h") % typo_every == 0, F.concat(
        F.substring("w", F.lit(1), at), F.substring("w", at + 2, F.length("w")))).otherwise(F.col("w"))
    return hashed.select(word.alias("word")).where(F.length("word") >= min_length) \
        .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def reduce_word(word: str, symbols: int = SYMBOLS) -> bytes:
    """The reduced word: a hash of each letter, as one of ``symbols`` values from 1 on."""
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32)
    return ((code * np.uint32(2654435761) >> np.uint32(16)) % np.uint32(symbols) + 1).astype(np.uint8).tobytes()


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.full(n, _BASE, np.uint64)]).cumprod(dtype=np.uint64)


def keys(reduced: np.ndarray) -> np.ndarray:
    """The keys of reduced words of one length, the rows of a matrix."""
    return (reduced.astype(np.uint64) * _powers(reduced.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


def neighbours(reduced: np.ndarray, symbols: int = SYMBOLS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(rows, keys)``, in parts: the keys of all reduced words within one edit of each row, itself included, each once."""
    many, length = reduced.shape
    power, back, base = _powers(length), np.uint64(_BACK), np.uint64(_BASE)
    rows = np.arange(many)
    terms = reduced.astype(np.uint64) * power[:-1]
    before = np.zeros((many, length + 1), np.uint64)
    np.cumsum(terms, axis=1, out=before[:, 1:])
    whole = before[:, -1:]
    yield rows, whole[:, 0]
    step = max(1, CHUNK // max(1, many * (2 * symbols + 1)))
    for lo in range(0, length + 1, step):
        at = np.arange(lo, min(lo + step, length + 1))
        inner = at[at < length]
        c, here = reduced[:, inner], before[:, inner]
        # what stands left of each place (0: nothing): of a run of equal symbols one deletion counts
        left = np.where(at > 0, reduced[:, np.maximum(at, 1) - 1], 0)
        new = c != left[:, :len(inner)]
        gone = here + (whole - before[:, inner + 1]) * back
        yield np.nonzero(new)[0], gone[new]
        for s in range(1, symbols + 1):
            other = c != s
            changed = whole + (np.uint64(s) - c.astype(np.uint64)) * power[inner]
            yield np.nonzero(other)[0], changed[other]
            # and of the places beside a symbol one insertion of the same
            other = left != s
            grown = before[:, at] + np.uint64(s) * power[at] + (whole - before[:, at]) * base
            yield np.nonzero(other)[0], grown[other]


def _by_length(words: list[bytes], most: int) -> Iterator[tuple[list[int], np.ndarray]]:
    """``(places, matrix)`` of words of equal length, ``most`` symbols at once (or one word)."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    for n, places in groups.items():
        step = max(1, most // max(1, n))
        for k in range(0, len(places), step):
            part = places[k:k + step]
            yield part, np.frombuffer(b"".join([words[i] for i in part]), np.uint8).reshape(len(part), n)


def _reduced(vocabulary: DataFrame, symbols: int) -> DataFrame:
    """``vocabulary`` with the reduced word, its key, and the letters of the word as bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = b.column(0).to_pylist()
            short = [reduce_word(w, symbols) for w in words]
            key = np.zeros(len(words), np.uint64)
            for places, m in _by_length(short, CHUNK):
                key[places] = keys(m)
            bits = [sum({1 << ord(c) % 63 for c in set(w)}) for w in words]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(short, pa.binary()), pa.array(key.view(np.int64)), pa.array(bits, pa.int64())],
                names=["word", "n", "reduced", "key", "bits"])

    return vocabulary.select("word", "n").mapInArrow(run, "word string, n long, reduced binary, key long, bits long")


def _near_keys(reduced: DataFrame, symbols: int) -> DataFrame:
    """``(key, near)``: pairs of keys of reduced words within one edit, in both directions, equal ones included."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, words = b.column(1).to_numpy(zero_copy_only=False), b.column(0).to_pylist()
            for places, m in _by_length(words, CHUNK // (2 * symbols + 1)):
                of = own[places]
                for rows, near in neighbours(m, symbols):
                    yield pa.RecordBatch.from_arrays([pa.array(of[rows]), pa.array(near.view(np.int64))], names=["key", "near"])

    grown = reduced.select("reduced", "key").distinct().mapInArrow(run, "key long, near long")
    there = reduced.select(F.col("key").alias("near")).distinct()
    return grown.join(there, "near").dropDuplicates(["near", "key"])


def one_edit(a: Column, b: Column) -> Column:
    """Whether exactly one inserted, deleted or replaced code point tells two strings apart.

    Of long strings the common beginning is found by halving steps, and the ends are compared."""
    least = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.array(*[F.lit(1 << i) for i in range(29, -1, -1)]), F.lit(0), lambda at, step: F.when(
        (at + step <= least) & (F.substring(a, F.lit(1), at + step) == F.substring(b, F.lit(1), at + step)), at + step).otherwise(at))
    end = F.lit(1 << 30)

    def rest(x: Column, skip: int) -> Column:
        return F.substring(x, same + F.lit(1 + skip), end)

    shift = F.length(a) - F.length(b)
    long = F.when(shift == 0, (a != b) & (rest(a, 1) == rest(b, 1))) \
        .when(shift == 1, rest(a, 1) == rest(b, 0)).when(shift == -1, rest(a, 0) == rest(b, 1)).otherwise(F.lit(False))
    return F.when(F.greatest(F.length(a), F.length(b)) <= SHORT, F.levenshtein(a, b, 1) == 1).otherwise(long)


def near_words(vocabulary: DataFrame, symbols: int = SYMBOLS) -> DataFrame:
    """``(word, near, near_n)`` for every two words of ``vocabulary (word, n)`` one edit apart, in both directions."""
    ensure_checkpoint_dir(vocabulary.sparkSession)
    reduced = _reduced(vocabulary, symbols).checkpoint()
    pairs = _near_keys(reduced, symbols)
    words = reduced.select("key", "word", "bits")
    other = reduced.select(F.col("key").alias("near"), F.col("word").alias("__near"), F.col("n").alias("near_n"),
                           F.col("bits").alias("__bits"))
    # one edit changes two letters at most
    able = (F.bit_count(F.col("bits").bitwiseXOR(F.col("__bits"))) <= 2) & one_edit(F.col("word"), F.col("__near"))
    return pairs.join(other, "near").drop("near").join(words, "key").where(able) \
        .select("word", F.col("__near").alias("near"), "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` by pointer jumping over ``(word, form)``, a forest."""
    roots = forms.select("word", F.col("form").alias("root")).checkpoint()
    while True:
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        further = roots.join(up, "root", "left").select(
            "word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")).checkpoint()
        if further.where("moved").isEmpty():
            return roots
        roots = further.select("word", "root")


def group_variants(vocabulary: DataFrame, factor: int = 2, symbols: int = SYMBOLS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of every word of ``vocabulary (word, n)``.

    ``form``: the near word of largest n, if that is ``factor`` times the word's n or more;
    ``root``: where following forms ends."""
    ensure_checkpoint_dir(vocabulary.sparkSession)
    vocabulary = vocabulary.select("word", "n").checkpoint()
    best = near_words(vocabulary, symbols).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = vocabulary.join(best, "word", "left").withColumn("__n", -F.col("best.less"))
    is_form = F.col("__n") >= factor * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                         F.when(is_form, F.col("best.near")).alias("form"), F.when(is_form, F.col("__n")).alias("form_n")).checkpoint()
    return found.join(_roots(found.where("form IS NOT NULL")), "word", "left") \
        .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
