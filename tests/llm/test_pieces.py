"""Prefix-table encoding against the sentencepiece library."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from colloquy.llm import pieces
from colloquy.llm.common import WordCache

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def encoder():
    return pieces.PrefixEncoder(pieces.load(PATH))


def texts(n, encoder, seed=11):
    rng = random.Random(seed)

    def one():
        size, kind = rng.randint(0, 60), rng.random()
        if kind < 0.3:
            return "".join(rng.choice(" ab.,▁\n-'\t") for _ in range(size))
        if kind < 0.5:
            return "".join(chr(rng.choice([rng.randint(0, 127), rng.randint(128, 0x2fff), rng.randint(0x3000, 0xd7ff),
                                           rng.randint(0xe000, 0x10ffff)])) for _ in range(size))
        if kind < 0.6:
            return " " * rng.randint(0, 40) + rng.choice("ax.") + " " * rng.randint(0, 40)
        return "".join(rng.choice(encoder.text[259:32000]) for _ in range(size)).replace("▁", " ")
    return [one() for _ in range(n)]


def check(encoder, library, some):
    for t, (ids, decoded) in zip(some, [*encoder.encode(some)]):
        want = library.encode(t)
        assert ids == ",".join(map(str, want)), t
        assert decoded == library.decode(want) == encoder.decode(want), t


def test_as_the_library_does(encoder, library):
    for k in range(4):  # later blocks find words known
        check(encoder, library, texts(1500, encoder, k) + ["", " ", "▁", "</s> <0x41> <unk>", "a" * 3000, " " * 2000, "ab" * 5000 + "\x00"])


def test_decode_of_any_ids(encoder, library):
    rng = random.Random(2)
    for _ in range(500):
        ids = [rng.choice([rng.randint(0, 258), rng.randint(3, 258), rng.randint(259, 31999)]) for _ in range(rng.randint(0, 12))]
        assert encoder.decode(ids) == library.decode(ids), ids


def test_pairs_follow_from_ages(encoder):
    rng = random.Random(6)
    for _ in range(3000):
        a, b = rng.randint(259, 31999), rng.randint(259, 31999)
        left, right = encoder.text[a], encoder.text[b]
        assert encoder._stay_apart(a, b) == (encoder._merge([*left, *right]) == [left, right]), (left, right)


def test_a_full_cache_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 20_000)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 50)
    small = pieces.PrefixEncoder(pieces.load(PATH))
    for k in range(3):
        check(small, library, texts(400, small, k))
        assert small.units.size <= 20_000 and len(small.units.known) < 100 and len(small.apart) <= 50


def test_documents(spark, library):
    rows = [(1, "The cat sat.  Twice."), (2, None), (3, ""), (3, "dup"), (3, "dup"), (None, "null id"), (4, "x" * 200_000),
            (5, "日本語のテキスト 😀 𐐷")]
    frame = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, ids string, n_tokens int")
    got = pieces.encode_texts(frame, PATH).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "")
        text = library.decode(ids) if ids else ""
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(text.encode()).hexdigest(), ids, text))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert pieces.encode_texts(frame.limit(0), PATH, keep=()).count() == 0


def test_cache_drops_what_does_not_fit():
    cache = WordCache(700)
    cache.put("a", "1")
    cache.put("b", "2")
    cache.put("c", "3")
    assert cache.known == {"a": "1", "b": "2", "c": "3"}
    cache.end_block()
    assert cache.known == {"a": "1", "b": "2"}
