"""SentencePiece encoding and decoding by a prefix table.

A sequence of pieces is the encoding of its text exactly when every two neighbours, encoded together,
stay those two pieces: the first merge across a border of two pieces would also come, at the same
point, when only those two are encoded.  So every prefix of a text has one last piece.  The table of
last pieces is filled from left to right: an automaton (Aho-Corasick over all pieces) gives the pieces
that end at a place, and the one that is compatible with the last piece of what stands before it is
entered.  The ids are then read backwards from the end.

Merges follow the type of the model: two neighbours merge if their joined text is a piece, the best
score first, then the leftmost.  Texts are cut into units where no piece can lie over the cut (found
from the vocabulary: before a word mark, and between a letter and a mark that follows none in any
piece), so that the table of a unit is filled once for all its occurrences.  Characters that no
piece holds become their bytes.

``encode_texts`` is a narrow map over the documents: nothing is shuffled, every task holds one block of
texts and a cache of units within a byte bound.

Defined results: null text is empty; an empty text has no ids, and both digests are those of empty
text; repeated rows repeat their result; a text without spaces of any length is one unit, in time and
memory linear in it; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from colloquy.llm.common import WordCache, text_blocks, worker_state

SPACE = "▁"
#: Characters of text encoded together, bytes of cached units and number of cached pairs of a worker.
BLOCK_CHARS, CACHE_BYTES, CACHE_PAIRS = 1_000_000, 240_000_000, 800_000
#: Fixed: the types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6

_RUNS = re.compile(f"{SPACE}+[^{SPACE}]*")

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def load(path: str) -> dict:
    """The parts of a model file that encoding needs; other kinds of model are refused."""
    model = model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
    if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte fallback and without user-defined pieces are supported")
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
        raise ValueError("only models that leave texts as they are, but for spaces, are supported")
    return {"pieces": [(p.piece, p.score, p.type) for p in model.pieces]}


class PrefixEncoder:
    """Encodes texts by the last piece of each prefix, and decodes ids."""

    def __init__(self, spec: dict) -> None:
        pieces = spec["pieces"]
        self.score = {p: s for p, s, kind in pieces if kind == NORMAL}
        self.byte = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == BYTE}
        self.kind = [kind for _, _, kind in pieces]
        self.text = [p for p, _, _ in pieces]
        self.value = {i: b for b, i in self.byte.items()}
        ids = {p: i for i, (p, _, kind) in enumerate(pieces) if kind == NORMAL}
        known = {c for p in ids for c in p}
        for c in sorted(known - ids.keys()):  # occurs in pieces only: a symbol without an id of its own
            ids[c] = len(self.text)
            self.text.append(c)
        self.ids = ids
        self.order = {p: n for n, p in enumerate(sorted(self.score, key=lambda p: -self.score[p]), 1)}
        self.parts: dict[str, tuple[str, str]] = {}  # the last merge of a piece of which each part is older
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in ids.items():
            if len(p) == 1:
                self.automaton.add_word(p, i)
                continue
            left, right = (*self._merge([*p], 2), "")[:2]
            if left + right == p and right and self._merge([left, right]) == [p]:  # else it never comes out of merging
                self.automaton.add_word(p, i)
                if max(self._age(left), self._age(right)) < self._age(p) and p.strip(SPACE):
                    self.parts[p] = left, right
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.text]
        self.left: dict[int, list | None] = {}
        self.right: dict[int, list | None] = {}
        self.unknown = re.compile("[^" + "".join(map(re.escape, sorted(known))) + "]")
        self.cut = self._cutter(known)
        self.apart: dict[int, bool] = {}
        self.units = WordCache(CACHE_BYTES)
        self.odd: dict[str, str] = {}

    def _cutter(self, known: set[str]) -> re.Pattern:
        before = defaultdict(set)
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                before[b].add(a)
        if before[SPACE] - {SPACE}:
            return re.compile(r"(?s).+")  # a piece may hold a space inside: one unit
        marks = {c for c in known | set("\n\t\r") if not c.isalnum() and c != SPACE}
        while bad := {c for c in marks if before[c] - marks - {SPACE}}:
            marks -= bad
        m = "".join(map(re.escape, sorted(marks)))
        if not m:
            return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        return re.compile(f"{SPACE}*[^{SPACE}{m}]+|{SPACE}*[{m}][^{SPACE}]*|{SPACE}+")

    # -- pieces and pairs -------------------------------------------------------------------

    def _merge(self, parts: list[str], least: int = 1) -> list[str]:
        """Merges until nothing is left to merge, or ``least`` parts are left."""
        while len(parts) > least:
            found = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
            if not found:
                break
            i = min(found)[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2:]]
        return parts

    def _age(self, part: str) -> int:
        """When a part comes to be: characters are there at the start, pieces follow in order of score."""
        return 0 if len(part) == 1 else self.order[part]

    def _edge(self, token: int, side: int) -> list[tuple[str, int]] | None:
        """What stands at the right (1) or left (0) edge of a piece while it is merged, latest first, with
        its age; None where ages do not tell (parts of equal score)."""
        part, out = self.text[token], []
        while len(part) > 1:
            if part not in self.parts:
                return None
            out.append((part, self._age(part)))
            part = self.parts[part][side]
        return [*out, (part, 0)]

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether two pieces, encoded together, stay these two.

        What stands left and right of the border is followed back in time.  A pair that stood there
        together would have merged if its joined text is a piece older than what either went into;
        of equal merges the left one comes first."""
        if len(self.apart) >= CACHE_PAIRS:
            self.apart.clear()
        for edges, token, side in ((self.right, a, 1), (self.left, b, 0)):
            if token not in edges:
                edges[token] = self._edge(token, side)
        left, right = self.right[a], self.left[b]
        if left is None or right is None:
            fits = self._merge([*self.text[a], *self.text[b]]) == [self.text[a], self.text[b]]
        else:
            fits, i, j, order = True, 0, 0, self.order
            left_next = right_next = len(order) + 1
            while True:
                (x, x_age), (y, y_age) = left[i], right[j]
                age = order.get(x + y)
                if age is not None and age < left_next and age <= right_next:
                    fits = False
                    break
                if x_age > y_age:
                    left_next, i = x_age, i + 1
                elif y_age:
                    right_next, j = y_age, j + 1
                else:
                    break
        self.apart[a << 20 | b] = fits
        return fits

    # -- the prefix table -------------------------------------------------------------------

    def encode_units(self, units: Sequence[str]) -> Iterator[list[int]]:
        """The ids of each unit; a character without a piece gives its bytes."""
        whole = "\0".join(units)
        # last[i]: the last piece of the prefix that ends with character i; -1: a character without a
        # piece, with which all is compatible (a separator is one); behind the end: the empty prefix
        last: list[int | None] = [None] * len(whole) + [-1]
        for m in self.unknown.finditer(whole):
            last[m.start()] = -1
        length, apart = self.length, self.apart
        for end, token in self.automaton.iter(whole):
            if last[end] is None:
                before = last[end - length[token]]
                if before >= 0:
                    fits = apart.get(before << 20 | token)
                    if not (self._stay_apart(before, token) if fits is None else fits):
                        continue
                last[end] = token
        stop, own = -2, len(self.kind)
        for unit in units:
            start = stop + 1
            stop = at = start + len(unit)
            ids: list[int] = []
            while at > start:
                token = last[at]
                if 0 <= token < own:
                    ids.append(token)
                    at -= length[token]
                else:
                    ids += [self.byte[b] for b in reversed(whole[at].encode())]
                    at -= 1
            ids.reverse()
            yield ids

    def _decode(self, ids: Iterable[int]) -> str:
        out, held = [], bytearray()
        for i in ids:
            if self.kind[i] == BYTE:
                held.append(self.value[i])
                continue
            if held:
                out.append(held.decode("utf-8", "each_byte"))
                held.clear()
            if self.kind[i] == NORMAL:
                out.append(self.text[i])
            elif self.kind[i] == UNKNOWN:
                out.append(" ⁇ ")
        return "".join(out) + held.decode("utf-8", "each_byte")

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: pieces in order, runs of bytes as characters, without the space put before the text."""
        out = self._decode(ids)
        return (out[1:] if out.startswith(SPACE) else out).replace(SPACE, " ")

    def _words(self, text: str) -> list[str]:
        """What stands after each space, the one put before the text included; further spaces belong to it."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[-1] == " " or text[0] == " ":
            return [u[1:] for u in _RUNS.findall(SPACE + text.replace(" ", SPACE))]
        return text.split(" ")

    def _learn(self, words: list[str]) -> None:
        """Adds the ids of words, each with its space, to the cache."""
        known = self.units.known
        parts = [self.cut.findall(SPACE + w) for w in words]
        new = [*{p for found in parts for p in found if p[0] != SPACE or p[1:] not in known}]
        ids: dict[str, str] = {}
        for part, found in zip(new, self.encode_units(new)):
            ids[part] = ",".join(map(str, found))
            if (back := self._decode(found)) != part:
                self.odd[part] = back
        for word, found in zip(words, parts):
            self.units.put(word, ",".join([ids[p] if p in ids else known[p[1:]] for p in found]))

    def encode(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """``(ids joined by commas, decoded text)`` of every text."""
        split = [self._words(t) for t in texts]
        known = self.units.known
        self._learn([*{w for found in split for w in found if w not in known}])
        for found in split:
            ids = ",".join(map(known.__getitem__, found))
            # pieces were decoded when they were learned; a word that came back as it was stands for its pieces
            yield ids, self.decode(map(int, ids.split(","))) if self.odd else " ".join(found).replace(SPACE, " ")
        self.units.end_block()


def encode_texts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text",
                 keep: tuple[str, ...] = ("ids", "decoded")) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256)`` and what ``keep`` names of ``ids`` and ``decoded``.

    ``model`` is the path of a model file on the driver (under a MB, sent to the tasks)."""
    sent = docs.sparkSession.sparkContext.broadcast(load(model))
    rows = docs.select(id_col, text_col)
    extra = ", ids array<int>" * ("ids" in keep) + ", decoded string" * ("decoded" in keep)
    schema = f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, " \
             f"decoded_sha256 string{extra}"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(c for c in ("ids", "decoded") if c in keep)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state(("pieces", model), lambda: PrefixEncoder(sent.value))
        for batch in batches:
            for start, texts in text_blocks((t.as_py() for t in batch.column(1)), BLOCK_CHARS):
                out: list[list] = [[], [], [], [], []]
                for ids, decoded in encoder.encode(texts):
                    out[0].append(ids.count(",") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    if "ids" in keep:
                        out[3].append(np.fromstring(ids, np.int32, sep=","))
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
