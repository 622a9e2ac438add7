"""Spelling variants against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import spelling

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {chr(65 + i): chr(97 + i) for i in range(26)}


def edits(word, letters):
    return {word[:i] + c + word[i + k:] for i in range(len(word) + 1) for k in (0, 1) for c in (*letters, "")
            if i + k <= len(word)} - {word}


def vocabulary(rows, every=97):
    seen = Counter()
    for i, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(LOWER.get(c, c) for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % every == 0:
                word = word[:h % len(word)] + word[h % len(word) + 1:]
            seen[word] += 1
    return {w: n for w, n in seen.items() if len(w) >= 5 and n >= 3}


def grouped(words):
    letters = {c for w in words for c in w}
    near = {w: [x for x in edits(w, letters) if x in words] for w in words}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, words[w], len(near[w]), words.get(form[w])))
    return out


def test_group_variants_against_all_pairs(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(5, 8))): rng.choice([3, 3, 4, 6, 7, 14, 40, 300]) for _ in range(500)}
    for n in (62, 63, 64, 65, 66, 400):  # on both sides of the length from which ends are compared
        word = "".join(rng.choice("abxyz") for _ in range(n))
        words |= {word: 50, word[1:]: 20, word[:-1] + "q": 9, word[:n // 2] + word[n // 2 + 1:]: 4, "q" + word: 3,
                  word[:n // 2] + "q" + word[n // 2:]: 5, word[:n // 3] + "ÿ" + word[n // 3 + 1:]: 8, word[::-1]: 7}
    frame = spark.createDataFrame([(w, n, "x", 1) for w, n in words.items()], "word string, n long, near string, key int")
    for symbols in (1, 4, 9):
        got = [tuple(r) for r in spelling.group_variants(frame, symbols=symbols)
               .select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(got) == len(words) and set(got) == grouped(words)


def test_words_of_documents(spark):
    rng = random.Random(4)
    vocab = ["Maison", "mAisons", "ÀÉchelle", "été", "water", "waters", "x" * 400, "y" * 5]
    rows = [(rng.choice([None, i]), " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 30)))) for i in range(400)]
    rows += [(7, None), (8, ""), (9, "one, two; three"), rows[3], rows[3]]
    frame = spark.createDataFrame([(i, t, 1, "h") for i, t in rows], "doc_id long, text string, n int, word string")
    for every in (97, 5):
        got = {r["word"]: r["n"] for r in spelling.words_of(frame, typo_every=every).collect()}
        assert got == vocabulary(rows, every)
    assert {tuple(r) for r in spelling.group_variants(spelling.words_of(frame))
            .select("word", "form", "root", "n", "n_near", "form_n").collect()} == grouped(vocabulary(rows))


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.words_of(empty)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")
    assert spelling.group_variants(spelling.words_of(nothing)).count() == 0


@pytest.mark.parametrize("word", ["aab", "aaaaa", "abcab", "ccb"])
def test_neighbourhood_is_full_and_distinct(word, monkeypatch):
    m = np.frombuffer(word.encode(), np.uint8).reshape(1, -1) - 96

    def one(w):
        return int(spelling.keys(np.frombuffer(w.encode(), np.uint8).reshape(1, -1) - 96)[0])

    want = sorted(one(w) for w in edits(word, "abc") | {word})
    for chunk in (1_000_000, 10):  # all places at once, and place by place
        monkeypatch.setattr(spelling, "CHUNK", chunk)
        assert sorted(int(k) for _, found in spelling.neighbours(m, 3) for k in found) == want


def test_a_very_long_run_takes_linear_time(spark):
    long = "ab" * 50_000
    rows = [(1, f"{long} {long[:-1]} {long}"), (2, f"{long[:-1]} {long} {long[:-1]}"), (3, f"{long} {long}x {long}")]
    frame = spark.createDataFrame(rows * 2, "doc_id long, text string")
    got = {tuple(r) for r in spelling.group_variants(spelling.words_of(frame, typo_every=1 << 40, min_count=5))
           .select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == {(long, None, long, 10, 1, None), (long[:-1], None, long[:-1], 6, 1, None)}
