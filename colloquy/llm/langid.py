"""Language identification by segmentation-marginalised unigram models.

Every language has a probability for each piece of one fixed public piece vocabulary.  The
probability of a word is the sum over all its segmentations into pieces of the product of their
probabilities, found by the forward algorithm (position by position, for a whole block of words of
one length at a time); that of a text is the product over its words, as pieces never cross a word
boundary.  The language with the highest posterior is predicted.

``train`` fits the probabilities by expectation maximisation on word counts of a bounded sample of
labelled rows (about ``max_rows``, a documented bound); ``classify`` is a narrow map over all rows:
nothing is shuffled, a task holds one block of texts and a bounded table of word scores.

Words are runs of letters of the lower-cased text, with the vocabulary's mark of a word's start;
runs of over ``WORD_CHARS`` letters are scored in parts of that length, all of them.  A letter that
is in no piece counts as a piece of its own with the floor probability.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every row
when no labelled row has a letter; ties go to the language that sorts first; other columns are not
read; repeated rows repeat their result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bounded_sample

UNKNOWN = "und"
WORD_CHARS = 24
#: Words whose scores a Python worker keeps before it starts anew.
CACHE_WORDS = 500_000
#: Rows that a fit takes at most (about, by hash).
TRAIN_ROWS = 20_000
#: Words that the forward algorithm takes together.
_BLOCK_WORDS = 8_192
_FLOOR = 1e-7
_START = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    lower = (text or "").lower()
    found = _WORD.findall(lower)
    if not lower.isascii():  # the pattern also takes numerals such as fractions, which are no letters
        found = [w for w in (x if x.isalpha() else "".join(filter(str.isalpha, x)) for x in found) if w]
    if found and max(map(len, found)) > WORD_CHARS:
        found = [w[i:i + WORD_CHARS] for w in found for i in range(0, len(w), WORD_CHARS)]
    return found


class Pieces:
    """The piece vocabulary as sorted hashes of its strings."""

    def __init__(self, pieces: list[str]) -> None:
        self.pieces = sorted({p for p in pieces if p})
        self.longest = max(map(len, self.pieces))
        hashes = np.array([int(self.hash(np.array([[*map(ord, p)]], np.uint64))[0]) for p in self.pieces], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order

    @staticmethod
    def hash(codes: np.ndarray) -> np.ndarray:
        h = np.zeros(len(codes), np.uint64)
        for j in range(codes.shape[1]):
            h = h * _BASE + codes[:, j] + np.uint64(1)
        return h

    def spans(self, words: list[str]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """``(start, end, rows, piece)`` of every piece found in words of one length, by end then start.
        A single character without a piece has the number of pieces as its piece."""
        codes = np.array([[*map(ord, _START + w)] for w in words], np.uint64)
        n = codes.shape[1]
        hashes = {}
        for start in range(n):
            h = np.zeros(len(codes), np.uint64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = h * _BASE + codes[:, end - 1] + np.uint64(1)
                hashes[start, end] = h
        for end in range(1, n + 1):
            for start in range(max(0, end - self.longest), end):
                h = hashes[start, end]
                at = np.searchsorted(self.hashes, h)
                at[at == len(self.hashes)] = 0
                hit = self.hashes[at] == h
                if end - start == 1:
                    yield start, end, np.arange(len(h)), np.where(hit, self.ids[at], len(self.pieces))
                elif hit.any():
                    rows = np.flatnonzero(hit)
                    yield start, end, rows, self.ids[at[rows]]


def _by_length(words: list[str]) -> Iterator[list[str]]:
    by: dict[int, list[str]] = {}
    for w in words:
        by.setdefault(len(w), []).append(w)
    for group in by.values():
        for i in range(0, len(group), _BLOCK_WORDS):
            yield group[i:i + _BLOCK_WORDS]


def forward(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Natural log of the summed probability of all segmentations: words of one length x languages.
    ``prob``: a row per piece and one for an unknown character, a column per language."""
    n = len(words[0]) + 1
    alpha = np.zeros((n + 1, len(words), prob.shape[1]))
    alpha[0] = 1.0
    for start, end, rows, piece in pieces.spans(words):
        alpha[end, rows] += alpha[start, rows] * prob[piece]
    return np.log(alpha[n])


def expected_counts(pieces: Pieces, words: list[str], weight: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected uses of every piece in words of one length: pieces x languages.  ``weight``: how often
    each language has each word."""
    n = len(words[0]) + 1
    found = list(pieces.spans(words))
    alpha = np.zeros((n + 1, len(words), prob.shape[1]))
    beta = np.zeros_like(alpha)
    alpha[0] = beta[n] = 1.0
    for start, end, rows, piece in found:
        alpha[end, rows] += alpha[start, rows] * prob[piece]
    for start, end, rows, piece in sorted(found, key=lambda x: -x[0]):
        beta[start, rows] += beta[end, rows] * prob[piece]
    out = np.zeros_like(prob)
    share = weight / alpha[n]
    for start, end, rows, piece in found:
        np.add.at(out, piece, alpha[start, rows] * prob[piece] * beta[end, rows] * share[rows])
    return out


class Model:
    """``langs``, the log prior and piece probabilities of each."""

    def __init__(self, langs: list[str], prior: np.ndarray, pieces: Pieces, prob: np.ndarray) -> None:
        self.langs, self.prior, self.pieces, self.prob = langs, prior, pieces, prob
        self.row: dict[str, int] = {}
        self.scores = np.zeros((0, len(langs)))

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.row]
        if len(self.row) + len(new) > CACHE_WORDS:
            self.row, self.scores, new = {}, self.scores[:0], list(words)
        parts = [self.scores]
        for group in _by_length(new):
            for w in group:
                self.row[w] = len(self.row)
            parts.append(forward(self.pieces, group, self.prob))
        self.scores = np.concatenate(parts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        split = [words_of(t) for t in texts]
        self._learn({w for words in split for w in words})
        lang, score = [], []
        for words in split:
            if not words or not self.langs:
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            rows = np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))
            log = self.prior + self.scores[rows].sum(axis=0)
            best = int(log.argmax())
            lang.append(self.langs[best])
            score.append(float(1 / np.exp(log - log[best]).sum()))
        return lang, score


def load_pieces(path: str) -> list[str]:
    """Pieces of a public sentencepiece model, without control and byte pieces."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_byte(i) or p.is_unknown(i))]


def train(rows: DataFrame, vocabulary: str, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
          max_rows: int = TRAIN_ROWS, rounds: int = 2) -> dict:
    """Fits the model on about ``max_rows`` of the labelled rows, all if there are no more."""
    pieces = load_pieces(vocabulary)
    spark = rows.sparkSession
    labelled = rows.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")) \
        .where("lang is not null and text is not null")
    sample = bounded_sample(labelled, ["id"], max_rows, "langid").select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            of: dict[tuple[str, str], int] = {}
            for lang, text in zip(b["lang"], b["text"]):
                for w in words_of(text):
                    of[lang, w] = of.get((lang, w), 0) + 1
            yield pd.DataFrame([(k[0], k[1], n) for k, n in of.items()], columns=["lang", "word", "n"])

    counts = sample.mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word") \
        .agg(F.sum("n").alias("n")).repartition("word").checkpoint()
    prior = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    langs = sorted(prior)
    share = np.array([prior[x] for x in langs], float)
    prob = np.full((len(set(pieces)) + 1, len(langs)), 1.0 / max(1, len(pieces)))
    sent = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds if langs else 0):
        now = spark.sparkContext.broadcast(prob)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            vocab, p, total = _vocabulary(sent.value), now.value, None
            for b in batches:
                weight: dict[str, np.ndarray] = {}
                for lang, w, n in zip(b["lang"], b["word"], b["n"]):
                    weight.setdefault(w, np.zeros(len(langs)))[langs.index(lang)] += n
                for group in _by_length(list(weight)):
                    got = expected_counts(vocab, group, np.array([weight[w] for w in group]), p)
                    total = got if total is None else total + got
            if total is not None:
                at, lang = np.nonzero(total)
                yield pd.DataFrame({"piece": at, "lang": lang, "n": total[at, lang]})

        # at most pieces x languages rows
        got = counts.mapInPandas(expect, "piece int, lang int, n double").groupBy("piece", "lang") \
            .agg(F.sum("n").alias("n")).toPandas()
        total = np.zeros_like(prob)
        total[got["piece"], got["lang"]] = got["n"]
        prob = np.maximum(total / np.maximum(total.sum(axis=0), 1e-300), _FLOOR)
    return {"langs": langs, "prior": np.log(share / share.sum()) if langs else share, "pieces": pieces, "prob": prob}


_VOCABULARIES: dict[int, Pieces] = {}


def _vocabulary(pieces: list[str]) -> Pieces:
    key = hash(tuple(pieces))
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Pieces(pieces)
    return _VOCABULARIES[key]


_MODELS: dict[str, Model] = {}


def classify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, lang_pred, score)`` for every document; the score is the posterior of the prediction."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    key = hashlib.sha1(repr(model["langs"]).encode() + model["prob"].tobytes()).hexdigest()
    rows = docs.select(id_col, text_col)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _MODELS.get(key)
        if m is None:
            v = sent.value
            _MODELS.clear()
            m = _MODELS[key] = Model(v["langs"], v["prior"], _vocabulary(v["pieces"]), v["prob"])
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                lang, score = m.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                                 names=[id_col, "lang_pred", "score"])

    return rows.mapInArrow(run, schema)
