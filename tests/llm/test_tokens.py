"""BPE against the tokenizers library; shards and language model against plain Python."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from colloquy.llm import bpe, langid, sharding

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(WORDS)
    t.no_truncation()
    t.no_padding()
    return t


def _texts():
    rng = random.Random(3)
    out = ["", " ", None, "It's a test; don't we'LL!", "<|endoftext|>x<|startoftext|> </w> <|ENDOFTEXT|>",
           "ΑΣ Σ İSTANBUL é é ﬁ K", "\x00\x1c\x1da\x85b ​ 日本語 🙂👍🏽", "ab_c__ ...!!!?? 3²½ ª 12345", "a" * 3000, "word " * 4000]
    for _ in range(300):
        out.append("".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéñß'!?._ 0123456789<>|\n") for _ in range(80)))
    return out


def test_trie_encoder_equals_the_library(library):
    encoder = bpe.TrieEncoder(bpe.load(WORDS))
    texts = _texts()
    for text, (ids, decoded) in zip(texts, encoder.encode(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_encode_texts_digests_and_nulls(spark, docs, library):
    rows = [(1, "Hello there, world"), (2, None), (3, ""), (1, "Hello there, world"), (None, "again")]
    got = bpe.encode_texts(docs(rows), WORDS).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Hello there, world", None: "again"}.get(r["doc_id"], "")
        want = library.encode(text, add_special_tokens=False).ids
        assert r["ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert bpe.encode_texts(docs([]), WORDS).count() == 0
    assert bpe.encode_texts(docs(rows), WORDS, keep=("ids",)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert bpe.encode_texts(docs(rows), WORDS, keep=()).count() == 5


def test_the_cache_may_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_BYTES", 1500)
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 20)
    small, large = bpe.TrieEncoder(bpe.load(WORDS)), bpe.TrieEncoder(bpe.load(WORDS))
    texts = [t for t in _texts() if t][:60]
    assert [x for t in texts for x in small.encode([t])] == list(large.encode(texts))


def _shards(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    total = sum(len((t or "").encode()) + 1 for _, t in rows)
    at, slot, out = 0, {}, []
    for i, t in rows:
        size = len((t or "").encode()) + 1
        shard = min(n - 1, (2 * at + size) // -(-2 * total // n))
        out.append((i, size, zlib.crc32((t or "").encode()), shard, slot.setdefault(shard, 0)))
        slot[shard] += 1
        at += size
    return out


@pytest.mark.parametrize("rows", [
    [], [(1, None)], [(i % 7, "é" * (i * 37 % 100)) for i in range(200)], [(5, "same")] * 90 + [(None, "z"), (3, "x" * 5000)]])
def test_shards_equal_prefix_sums(docs, rows):
    got = [tuple(r) for r in sharding.shard_by_bytes(docs(rows), 8).collect()]
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(_shards(rows, 8), key=key)


def test_shards_are_even(docs):
    rows = [(i, "w" * (i * 7919 % 400)) for i in range(2000)]
    size = {}
    for r in sharding.shard_by_bytes(docs(rows), 8).collect():
        size[r["shard"]] = size.get(r["shard"], 0) + r["size"]
    assert max(size.values()) - min(size.values()) <= 2 * 401


def _sum_of_segmentations(word, prob, pieces):
    """Every segmentation spelt out."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        if word[:k] in pieces:
            total += prob[pieces.index(word[:k])] * _sum_of_segmentations(word[k:], prob, pieces)
        elif k == 1:
            total += prob[-1] * _sum_of_segmentations(word[1:], prob, pieces)
    return total


def test_forward_sums_all_segmentations():
    vocab = langid.Pieces(["a", "b", "ab", "▁", "▁a", "ba", "bab", "▁ab"])
    rng = np.random.default_rng(1)
    prob = rng.random((len(vocab.pieces) + 1, 2))
    words = ["abab", "bbab", "azab", "baba"]
    got = langid.forward(vocab, words, prob)
    for w, row in zip(words, got):
        for lang in (0, 1):
            assert np.isclose(np.exp(row[lang]), _sum_of_segmentations("▁" + w, prob[:, lang], vocab.pieces))
    # every segmentation covers each character once
    weight = np.array([[1.0, 2.0]] * 4)
    uses = langid.expected_counts(vocab, words, weight, prob)
    letters = np.array([len(p) for p in vocab.pieces] + [1])
    assert np.allclose(letters @ uses, [4 * 5, 8 * 5])


def test_languages_are_told_apart(spark):
    rng = random.Random(4)
    bag = {"en": "the and of house water green letter speak".split(), "de": "der und haus wasser grün brief sprechen nicht".split()}
    rows = [(i, " ".join(rng.choice(bag[x]) for _ in range(12)), x) for i in range(80) for x in ("en", "de")]
    rows += [(900, "the house", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(frame, PIECES)
    assert model["langs"] == ["de", "en"]
    ask = spark.createDataFrame([(1, "green water and the letter"), (2, "der brief und das wasser"), (3, None), (4, ""), (5, "12 !!"),
                                 (6, "the" * 40), (7, "日本"), (8, "½ ² Ⅷ 3")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in langid.classify(ask, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 6)] == ["en", "de", "und", "und", "und"]
    assert got[3]["score"] == 0 and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[8]["lang_pred"] == "und" and langid.words_of("a½b the²") == ["ab", "the"]
    assert got[6]["lang_pred"] == "en" and got[7]["lang_pred"] in ("de", "en")


def test_language_model_without_rows(spark, docs):
    empty = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    model = langid.train(empty, PIECES)
    assert [tuple(r) for r in langid.classify(docs([(1, "text")]), model).collect()] == [(1, "und", 0.0)]


def test_code_points_of_any_age(library):
    rng = random.Random(8)
    texts = ["".join(chr(rng.choice([rng.randint(0x250, 0x2fff), rng.randint(0xa000, 0xd7ff), rng.randint(0xe000, 0x1ffff),
                                     rng.randint(0x20000, 0x33fff), rng.randint(97, 122)])) for _ in range(12)) for _ in range(1500)]
    texts += ["a" + chr(c) + "B" for c in (0x1c89, 0x10d50, 0x16ea0, 0x1d6a6, 0x558, 0x3fc3f)]
    encoder = bpe.TrieEncoder(bpe.load(WORDS))
    for text, (ids, decoded) in zip(texts, encoder.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == " ".join(map(str, want)), text
        assert decoded == library.decode(want, skip_special_tokens=False)
