"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, reporting verb, other).  Three
transducers rewrite a clause's symbols, each knowing one thing:

* reported speech: after a reporting verb, an insult or threat is reported;
* negation: within three words after a negation, an insult or threat is negated;
* target: an insult or threat in a clause that has named its target is aimed; a target that
  follows marks the insult before it.

They are composed into one deterministic machine that runs over every clause of the whole text.
Its outputs, each weighted by the strength of the word that caused it, are summed by kind of match
over the clauses, and a logistic model turns the sums into the score.

The insult lexicon (word beginnings and whole words) and the logistic weights are learned from
about ``max_rows`` labelled rows (a documented bound); the scoring is a narrow map over all rows.

Defined results: null and empty texts, and texts without a match, get the score of no match; when
no labelled row is toxic (or all are), the built-in words and prior weights are used; repeated rows
repeat their result; a document with several labels counts as toxic if any is; label rows with a
null id or label are left out; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import bounded_sample, drop_worker_state

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "w", "I", "H", "Y", "N", "R"
SYMBOLS = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)

#: Seed words, by symbol, in English, German, French and Spanish.
SEEDS = {
    INSULT: "idiot idiots moron morons imbecile scum stupid loser losers pathetic worthless disgusting dumb "
            "idiotin dummkopf trottel abschaum imbécile connard salaud ordure idiota imbécil estúpido estúpida escoria",
    THREAT: "kill hurt destroy murder stab shoot beat töten umbringen schlagen tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours u he she him her they them du dich dir dein ihr euch sie er tu toi ton vous votre vos il "
            "elle ils elles tú ti tus usted ustedes él ella ellos ellas",
    NEGATION: "not no never isn aren don doesn won nor without nicht kein keine keiner nie niemals ne pas jamais aucun "
              "nunca ni sin jamás",
    REPORT: "said says say wrote writes claimed claims quoted according reported sagte sagt schrieb behauptete laut "
            "dit écrit affirme selon dijo dice escribió según",
}
#: Kinds of match: aimed insult and threat, plain ones, reported ones, negated ones, a target named after an insult.
KINDS = ("J", "K", "I", "H", "i", "h", "n", "y")
#: Prior weights of the kinds and, last, of the constant.
#: An aimed insult or threat counts as a plain one too, so that its own weight is what aiming adds.
PRIOR = np.array([0.5, 2.0, 3.0, 0.5, 0.5, 0.2, 0.1, 0.5, -3.5])
STEM_CHARS = (4, 5, 6, 7)
#: Scores from here on count as toxic.
THRESHOLD = 0.3
#: Labelled rows that a fit takes at most (about, by hash), the fewest documents that make an entry of
#: the lexicon, and the entries that are candidates for it.
TRAIN_ROWS, MIN_DOCUMENTS, MAX_CANDIDATES = 20_000, 3, 2_000
#: Words whose class a Python worker keeps before it starts anew.
CACHE_WORDS = 150_000
_TOKEN = re.compile(r"[^\W_]+|[.!?;:\n]")
_ENDS = frozenset(".!?;:\n")


class Transducer:
    """A deterministic transducer: ``arcs[state, symbol] = (next state, output)``; a symbol without an
    arc is copied and the state kept."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]]) -> None:
        self.arcs = arcs

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol), (state, symbol))

    def then(self, other: Transducer, symbols: tuple[str, ...] = SYMBOLS) -> Transducer:
        """The composition: ``other`` reads what ``self`` writes.  States are numbered as reached."""
        number, arcs, todo = {(0, 0): 0}, {}, [(0, 0)]
        for pair in todo:
            for s in symbols:
                a, mid = self.step(pair[0], s)
                b, out = other.step(pair[1], mid)
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                arcs[number[pair], s] = number[a, b], out
        return Transducer(arcs)


def reporting() -> Transducer:
    return Transducer({(0, REPORT): (1, OTHER), (1, REPORT): (1, OTHER), (1, INSULT): (1, "i"), (1, THREAT): (1, "h")})


def negation(reach: int = 3) -> Transducer:
    arcs = {}
    for left in range(reach + 1):
        for s in (*SYMBOLS, "i", "h"):
            arcs[left, s] = max(0, left - 1), "n" if left and s in (INSULT, THREAT, "i", "h") else s
        arcs[left, NEGATION] = reach, OTHER
    return Transducer(arcs)


def targeting() -> Transducer:
    # 0: nothing yet; 1: a target is named; 2: an insult or threat without one
    return Transducer({
        (0, TARGET): (1, OTHER), (1, TARGET): (1, OTHER), (2, TARGET): (1, "y"),
        (0, INSULT): (2, INSULT), (0, THREAT): (2, THREAT), (1, INSULT): (1, "J"), (1, THREAT): (1, "K")})


def grammar() -> Transducer:
    return reporting().then(negation()).then(targeting())


class Lexicon:
    """``stems`` and ``whole``: strength of insults by word beginning and by word."""

    def __init__(self, stems: dict[str, float], whole: dict[str, float]) -> None:
        self.stems, self.whole = stems, whole
        self.lengths = sorted({len(s) for s in stems})
        self.seeds = {w: s for s in (THREAT, TARGET, NEGATION, REPORT) for w in SEEDS[s].split()}
        self.cache: dict[str, tuple[str, float]] = {}

    def look_up(self, word: str) -> tuple[str, float]:
        strength = max([self.whole.get(word, 0.0), *(self.stems.get(word[:k], 0.0) for k in self.lengths)])
        return (INSULT, strength) if strength else (self.seeds.get(word, OTHER), 1.0)

    def classes(self, words: set[str]) -> dict[str, tuple[str, float]]:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, out = self.cache, {}
        for w in words:
            c = cache.get(w)
            if c is None:
                c = cache[w] = self.look_up(w)
            if c[0] != OTHER:
                out[w] = c
        return out


class Matcher:
    """Runs the grammar over the clauses of texts."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon, self.machine = lexicon, grammar()

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, dict[str, float]]]:
        """``(start, end, strength by kind)`` of every clause that has a match."""
        text = (text or "").lower()
        known = self.lexicon.classes(set(_TOKEN.findall(text)))
        if not any(c in (INSULT, THREAT) for c, _ in known.values()):
            return
        state, start, found = 0, 0, {}
        step, plain = self.machine.step, (OTHER, 0.0)
        for m in _TOKEN.finditer(text):
            token = m[0]
            if token in _ENDS:
                if found:
                    yield start, m.end(), found
                state, start, found = 0, m.end(), {}
                continue
            symbol, strength = known.get(token, plain)
            state, out = step(state, symbol)
            if out in _KIND_AT:
                found[out] = found.get(out, 0.0) + strength
        if found:
            yield start, len(text), found

    def features(self, text: str | None) -> np.ndarray:
        sums = np.zeros(len(KINDS) + 1)
        sums[-1] = 1.0
        for _, _, found in self.clauses(text):
            for kind, strength in found.items():
                sums[_KIND_AT[kind]] += strength
                if kind in _PLAIN:
                    sums[_KIND_AT[_PLAIN[kind]]] += strength
        sums[:-1] = np.log1p(sums[:-1])
        return sums


_PLAIN = {"J": "I", "K": "H"}
_KIND_AT = {k: i for i, k in enumerate(KINDS)}


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Logistic weights by Newton's method, drawn towards ``PRIOR``."""
    w = PRIOR.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grad)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def grams_of(text: str) -> set[str]:
    """Word beginnings (with a hyphen after them) and whole words of a text."""
    words = {t for t in _TOKEN.findall(text.lower()) if t not in _ENDS}
    return words | {w[:k] + "-" for w in words for k in STEM_CHARS if len(w) > k}


def choose(strength: dict[str, float], holders: list[list[str]], min_new: int) -> list[str]:
    """Entries chosen greedily: the next one explains most toxic documents that none before explains.
    Rare words of a toxic document and its copies so fall to the insult in it."""
    by: dict[str, set[int]] = {}
    for i, names in enumerate(holders):
        for g in names:
            by.setdefault(g, set()).add(i)
    chosen: list[str] = []
    while by:
        best = max(by, key=lambda g: (len(by[g]), strength[g], len(g), g))  # of equals the most specific
        covered = by.pop(best)
        if len(covered) < min_new:
            break
        chosen.append(best)
        by = {g: rest for g, d in by.items() if (rest := d - covered)}
    return chosen


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_rows: int = TRAIN_ROWS) -> dict:
    """Learns lexicon and weights from about ``max_rows`` of the labelled rows, all if there are no more."""
    one = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("y")) \
        .where("__id is not null and y is not null").groupBy("__id").agg(F.max("y").alias("y"))
    few = F.broadcast(bounded_sample(one, ["__id"], max_rows, "toxicity"))  # about max_rows rows
    sample = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).where("text is not null") \
        .join(few, "__id").select("text", "y").dropDuplicates().checkpoint()
    n = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = n.get(1, 0), n.get(0, 0)
    seeds = {w: 2.0 for w in SEEDS[INSULT].split()}
    model = {"stems": {}, "whole": seeds, "weights": PRIOR.copy()}
    if not n_pos or not n_neg:
        return model

    def count(wanted: frozenset[str] | None):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            drop_worker_state()
            for b in batches:
                got: Counter[str] = Counter()
                for text in b["text"]:
                    grams = grams_of(text)
                    got.update(grams if wanted is None else grams & wanted)
                yield pd.DataFrame({"gram": list(got), "n": list(got.values())})
        return run

    toxic = sample.where("y = 1")
    pos = {r["gram"]: r["n"] for r in toxic.mapInPandas(count(None), "gram string, n long").groupBy("gram")
           .agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCUMENTS).collect()}
    neg = {r["gram"]: r["n"] for r in sample.where("y = 0").mapInPandas(count(frozenset(pos)), "gram string, n long")
           .groupBy("gram").agg(F.sum("n").alias("n")).collect()}
    odds = {g: math.log((p + 0.5) / (n_pos + 1)) - math.log((neg.get(g, 0) + 0.5) / (n_neg + 1)) for g, p in pos.items()
            if p > neg.get(g, 0)}
    strength = {g: odds[g] for g in sorted(odds, key=lambda g: (-odds[g] * math.log(pos[g] + 1), g))[:MAX_CANDIDATES]
                if odds[g] > 2}
    names = frozenset(strength)

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"grams": [sorted(grams_of(t) & names) for t in b["text"]]})

    holders = [list(r["grams"]) for r in toxic.mapInPandas(hold, "grams array<string>").where("size(grams) > 0").collect()]
    chosen = choose(strength, holders, MIN_DOCUMENTS)
    model["stems"] = {g[:-1]: strength[g] for g in chosen if g.endswith("-")}
    model["whole"] = {w: odds.get(w, s) for w, s in seeds.items()} | {g: strength[g] for g in chosen if not g.endswith("-")}
    model["whole"] = {w: s for w, s in model["whole"].items() if s > 0}
    lexicon = model["stems"], model["whole"]

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(Lexicon(*lexicon))
        for b in batches:
            yield pd.DataFrame({"x": [matcher.features(t) for t in b["text"]], "y": b["y"]})

    rows = sample.mapInPandas(measure, "x array<double>, y int").groupBy("x", "y") \
        .agg(F.count(F.lit(1)).alias("n")).collect()  # at most the bounded sample
    x = np.array([r["x"] for r in rows]).repeat([r["n"] for r in rows], axis=0)
    y = np.array([r["y"] for r in rows], float).repeat([r["n"] for r in rows])
    model["weights"] = fit_weights(x, y)
    return model


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text",
          keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """``(id, *keep, score)`` for every row: 0 to 1, higher where toxicity is likelier."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = list(dict.fromkeys([id_col, *keep]))
    rows = docs.select(*cols, F.col(text_col).alias("__scored"))
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in cols) + f", `{score_col}` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_state()
        m = sent.value
        matcher = Matcher(Lexicon(m["stems"], m["whole"]))
        for b in batches:
            z = np.array([matcher.features(t.as_py()) @ m["weights"] for t in b.column(len(cols))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40))), pa.float64())],
                                             names=[*cols, score_col])

    return rows.mapInArrow(run, schema)
