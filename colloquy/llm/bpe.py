"""BPE encoding and decoding by a prefix-sharing trie traversal.

A sequence of tokens is the BPE encoding of its text exactly when every two neighbours, encoded
together, stay those two tokens.  So the encoding of a word follows from one fact per prefix: the
last token of the encoding of that prefix.  The distinct words of a block of texts form a trie;
it is walked depth first (the sorted order of the words is that walk), each node keeps the last
token of its prefix, and words that share a prefix share the states of its nodes.

``encode_texts`` is a narrow map over the documents: nothing is shuffled, every task holds one
block of texts and a cache of word encodings within a byte bound, which the next task finds filled.

Text handling is that of the vocabulary file: NFC, runs of white space, lower case by character,
then contractions, letter runs, single digits and runs of other signs; special tokens found in the
raw text are kept as their ids.  (Texts with code points that Python's Unicode version does not know
are normalised and split by the tokenizers library itself, whose version is newer.)  The decoded text is that of a file without a decoder: the tokens
joined by one space.

Defined results: null text is empty; an empty text has no tokens, and both digests are those of
empty text; repeated rows repeat their result; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from colloquy.llm.common import WordCache, text_blocks, worker_state

END = "</w>"
#: Characters for which the standard patterns and those of the vocabulary files may differ.
_RARE = re.compile("[^\\x00-\\x1b -\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]")
#: Fixed: the word pattern of the vocabulary file, and its like for texts without such characters.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|[^\s\w]+(?:_+[^\s\w]*)*|(?:_+[^\s\w]*)+")
#: Bytes of word encodings, twice (ids and tokens), and known token pairs that a Python worker keeps.
CACHE_BYTES, CACHE_PAIRS = 140_000_000, 600_000
#: Characters of text that are taken together into one trie.
BLOCK_CHARS = 1_000_000


def load(path: str) -> dict:
    """The parts of a vocabulary file that encoding needs."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {"vocab": spec["model"]["vocab"], "merges": [tuple(m) for m in spec["model"]["merges"]],
            "pattern": pattern, "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
            "rules": json.dumps({k: spec[k] for k in ("version", "normalizer", "pre_tokenizer")}
                                | {"model": {"type": "BPE", "vocab": {}, "merges": []}})}


def _byte_chars() -> list[str]:
    """The printable stand-in of every byte: itself, or the next character from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shift = iter(range(256, 512))
    return [chr(b if b in kept else next(shift)) for b in range(256)]


class TrieEncoder:
    """Encodes words by their prefixes; texts by their words."""

    def __init__(self, spec: dict, cache_bytes: int | None = None) -> None:
        self.vocab: dict[str, int] = spec["vocab"]
        self.rank = {pair: i for i, pair in enumerate(spec["merges"])}
        self.special: dict[str, int] = spec["special"]
        self.name = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.longest = max(map(len, self.vocab))
        self.pattern = regex.compile(spec["pattern"])
        self.quick = spec["pattern"] == WORD_PATTERN
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.bytes = _byte_chars()
        self.byte_of = {c: b for b, c in enumerate(self.bytes)}
        self.rules = Tokenizer.from_str(spec["rules"])
        self.stays: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.left: dict[int, list | None] = {}
        self.right: dict[int, list | None] = {}
        half = CACHE_BYTES if cache_bytes is None else cache_bytes // 2
        self.ids, self.tokens = WordCache(half), WordCache(half)
        for t, i in self.special.items():
            self.ids.put(" " + t, str(i))
            self.tokens.put(" " + t, t)

    # -- single tokens and pairs ------------------------------------------------------------

    def _symbols(self, token: int) -> list[str]:
        t = self.name[token]
        return [*t[: -len(END) - 1], t[-len(END) - 1:]] if t.endswith(END) and t != END else [*t]

    def _merge(self, parts: list[str], least: int = 1) -> list[str]:
        """Merges until nothing is left to merge, or ``least`` parts are left."""
        while len(parts) > least:
            best = min((self.rank.get(p, len(self.rank)), i) for i, p in enumerate(zip(parts, parts[1:])))
            if best[0] == len(self.rank):
                break
            i = best[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]
        return parts

    def _is_whole(self, token: int) -> bool:
        if (known := self.whole.get(token)) is None:
            known = self.whole[token] = len(self._merge(self._symbols(token))) == 1
        return known

    def _edge(self, token: int, side: int) -> list[tuple[str, int]] | None:
        """What stands at the right (1) or left (0) edge of a token while it is merged, latest first, each with
        when it comes to be (0: a symbol of the text); None where a part is not older than the whole."""
        symbols, out = self._symbols(token), []
        while len(symbols) > 1:
            last = self._merge(symbols, 2)
            order = self.rank.get((last[0], last[1])) if len(last) == 2 else None
            if order is None or (out and order + 1 >= out[-1][1]):
                return None
            out.append((last[0] + last[1], order + 1))
            # the symbols of the part at the edge
            size = n = 0
            inner = symbols if not side else symbols[::-1]
            while size < len(last[side]):
                size += len(inner[n])
                n += 1
            symbols = symbols[:n] if not side else symbols[-n:]
        return [*out, (symbols[0], 0)]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether two tokens, encoded together, stay these two.

        What stands left and right of the border is followed back in time: a pair that stood there
        together would have merged if its merge ranks before the merges that either went into; of equal
        ones the left comes first."""
        key = a << 20 | b
        if (known := self.stays.get(key)) is not None:
            return known
        if len(self.stays) >= CACHE_PAIRS:
            self.stays.clear()
        for edges, token, side in ((self.right, a, 1), (self.left, b, 0)):
            if token not in edges:
                edges[token] = self._edge(token, side)
        left, right = self.right[a], self.left[b]
        if left is None or right is None:
            known = self._merge(self._symbols(a) + self._symbols(b)) == [self.name[a], self.name[b]]
        else:
            known, i, j, rank = True, 0, 0, self.rank
            left_next = right_next = len(rank) + 1
            while True:
                (x, x_age), (y, y_age) = left[i], right[j]
                order = rank.get((x, y))
                if order is not None and order + 1 < left_next and order + 1 <= right_next:
                    known = False
                    break
                if x_age > y_age:
                    left_next, i = x_age, i + 1
                elif y_age:
                    right_next, j = y_age, j + 1
                else:
                    break
        self.stays[key] = known
        return known

    # -- the trie ---------------------------------------------------------------------------

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """The token ids of distinct words (in byte characters), in trie order."""
        get, stays, longest = self.vocab.get, self.stays, self.longest
        # of the node of each prefix of the word before: last token, and where that token starts
        last, begins, before = [-1], [-1], ""
        for word in sorted(words):
            n = len(word)
            shared = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                shared += 1
            shared = min(shared, n - 1, len(last) - 1)
            del last[shared + 1:], begins[shared + 1:]
            for end in range(shared + 1, n + 1):
                # the leaf is the prefix with the mark of a word's end
                part = word[:end] if end < n else word + END
                for start in range(end - longest if end > longest else 0, end):
                    token = get(part[start:])
                    if token is not None:
                        if not start:
                            fits = self._is_whole(token)
                        elif (fits := stays.get(last[start] << 20 | token)) is None:
                            fits = self._stay_apart(last[start], token)
                        if fits:
                            break
                else:
                    raise ValueError(f"the vocabulary has no token for {word[end - 1]!r}")
                last.append(token)
                begins.append(start)
            ids, at = [], n
            while at:
                ids.append(last[at])
                at = begins[at]
            ids.reverse()
            del last[n:], begins[n:]
            before = word
            yield word, ids

    # -- texts ------------------------------------------------------------------------------

    def _pieces(self, text: str) -> list[str]:
        """Words of the normalised text; special tokens after a space, which no word holds."""
        out: list[str] = []
        for p in self.marks.split(text) if any(m in text for m in self.special) else [text]:
            if p in self.special:
                out.append(" " + p)
            elif self.quick and not _RARE.search(p):
                out += _WORDS.findall(p.lower() if p.isascii() else unicodedata.normalize("NFC", p).lower())
            elif any(unicodedata.category(c) == "Cn" for c in set(p)):
                normal = self.rules.normalizer.normalize_str(p)
                out += [bytes(map(self.byte_of.__getitem__, w)).decode() for w, _ in self.rules.pre_tokenizer.pre_tokenize_str(normal)]
            else:
                # lower case by character: no special rule for the sigma that ends a word
                out += self.pattern.findall(unicodedata.normalize("NFC", p).replace("\u03a3", "\u03c3").lower())
        return out

    def _learn(self, words: set[str]) -> None:
        """Adds the encodings of words to the cache."""
        spelt = {w if w.isascii() and w.isalnum() else "".join([self.bytes[b] for b in w.encode()]): w for w in words}
        name = self.name
        for s, ids in self.encode_words(spelt):
            w = spelt[s]
            self.ids.put(w, " ".join(map(str, ids)))
            self.tokens.put(w, " ".join([name[i] for i in ids]))

    def encode(self, texts: list[str | None]) -> Iterator[tuple[str, str]]:
        """``(ids joined by a space, decoded text)`` of every text."""
        split = [self._pieces(t or "") for t in texts]
        ids, tokens = self.ids.known, self.tokens.known
        self._learn({x for pieces in split for x in pieces if x not in ids or x not in tokens})
        for pieces in split:
            yield " ".join(map(ids.__getitem__, pieces)), " ".join(map(tokens.__getitem__, pieces))
        self.ids.end_block()
        self.tokens.end_block()


def encode_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ("ids", "decoded"), cache_bytes: int = 2 * CACHE_BYTES) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` and what ``keep`` names of ``ids`` and ``decoded``.

    ``vocabulary`` is the path of a tokenizer file on the driver (a few MB, sent to the tasks);
    ``cache_bytes`` is what a worker may keep of known words (fewer cost time only)."""
    sent = docs.sparkSession.sparkContext.broadcast(load(vocabulary))
    rows = docs.select(id_col, text_col)
    extra = ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, " \
             f"decoded_sha256 string{extra}"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(c for c in ("ids", "decoded") if c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("bpe", vocabulary, cache_bytes), lambda: TrieEncoder(sent.value, cache_bytes))
        for batch in batches:
            for start, texts in text_blocks((t.as_py() for t in batch.column(1)), BLOCK_CHARS):
                out: list[list] = [[], [], [], [], []]
                for ids, decoded in encoder.encode(texts):
                    out[0].append(ids.count(" ") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if "ids" in keep:
                        out[3].append(np.fromstring(ids, np.int32, sep=" "))
                    if "decoded" in keep:
                        out[4].append(decoded)
                columns = [batch.column(0).slice(start, len(texts)), pa.array(out[0], pa.int64()),
                           pa.array(out[1], pa.string()), pa.array(out[2], pa.string())]
                if "ids" in keep:
                    columns.append(pa.array(out[3], pa.list_(pa.int32())))
                if "decoded" in keep:
                    columns.append(pa.array(out[4], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        pa.default_memory_pool().release_unused()  # the worker lives on

    return rows.mapInArrow(run, schema)
