"""Substring deduplication by sliding runs of sentences.

Every run of ``RUN`` consecutive sentences of every document is hashed.  All runs are joined on
their hash; of each repeated one, the first occurrence (smallest id, then place) stays, and the
sentences that any other occurrence covers are removed.

A sentence ends at ``.``, ``!``, ``?``, their like in other scripts, or a line break; one of over
``SENTENCE_WORDS`` words is cut where its words say so (after those whose hash, with the two before,
is the least of ``CUT_WINDOW`` neighbours), so that a long passage has several parts and the same ones
at any offset; up to a part at either end of it belongs to what stands beside it.  Sentences are
compared by their lower-cased words (of scripts without spaces: characters).

Every text is split once and the hashes of its runs (96 bits, so that no two of 10^13 runs are taken
for one by chance) are checkpointed; only texts that lose sentences are split again.  Of a hash that comes more
than once in a block of ``BLOCK_RUNS`` runs only the first occurrence goes on: the others can't be the first of all,
so they are known to be later ones where they stand.  The rest travels once, as (hash, id, number of its row,
place), and is ranked per hash.  So a run that a third of all documents share is one row per block.
Texts move for the report, else only if the numbers of what goes are too many bytes to broadcast.

Defined results: null texts stay null and empty ones empty, with no sentences; documents of fewer
than ``RUN`` sentences have no runs and stay; null ids sort first; rows equal in id and text are one
document and get the same result; rows of one id with different texts come in the table's order; other columns are not read (``remove_repeats`` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.llm.common import if_small
from colloquy.session import ensure_checkpoint_dir

RUN, SENTENCE_WORDS = 3, 16
#: A cut at least every CUT_WINDOW + CUT_LEAST words; parts before a cut have CUT_LEAST words or more.
CUT_WINDOW, CUT_LEAST = 9, 4
#: Runs (16 bytes each) that a task holds to find the first occurrences among them.
BLOCK_RUNS = 1 << 20
_END = ".!?\n。！？｡．।॥؟۔։።፧။…‼⁇⁈⁉"
_SENTENCE = re.compile(rf"[^{_END}]*(?:[{_END}]+|$)")
#: Kana, ideographs, Thai, Lao, Burmese and Khmer: a character is a word.
_ALONE = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\U00020000-\U0003ffff"
_ASCII_WORD, _WORD = re.compile(r"\w+"), re.compile(rf"(?=\w)[{_ALONE}]|[^\W{_ALONE}]+")


def _cuts(words: list[str]) -> list[int]:
    """Where the parts of a long sentence start: robust winnowing, so the choice depends on near words only."""
    h = [xxhash.xxh3_64_intdigest(f"{a} {b} {c}") for a, b, c in zip(["", "", *words], ["", *words], words)]
    out, least = [0], -1
    for stop in range(CUT_WINDOW, len(words)):
        if least < stop - CUT_WINDOW:
            near = h[stop - CUT_WINDOW:stop][::-1]
            least = stop - 1 - near.index(min(near))  # of equal ones the last
        elif h[stop - 1] < h[least]:
            least = stop - 1
        if least + 1 - out[-1] >= CUT_LEAST:
            out.append(least + 1)
    return out


def sentences(text: str | None) -> list[tuple[int, int, list[str]]]:
    """``(start, stop, words)`` of every sentence that has a word; what has none belongs to the one before."""
    out: list[tuple[int, int, list[str]]] = []
    for m in _SENTENCE.finditer(text or ""):
        start, stop = m.span()
        if start == stop:
            continue
        lower = m[0].lower()
        if lower.isascii():
            pattern, source = _ASCII_WORD, lower
        else:  # a longer lower case moves the places of words: those of the text are taken, lower-cased after
            pattern, source = _WORD, lower if len(lower) == stop - start else m[0]
        words = pattern.findall(source)
        if not words:
            if out:
                out[-1] = out[-1][0], stop, out[-1][2]
            continue
        if source is not lower:
            words = [w.lower() for w in words]
        if len(words) <= SENTENCE_WORDS:
            out.append((start, stop, words))
            continue
        cuts = _cuts(words)
        places = [w.start() for w in pattern.finditer(source)]
        starts = [start + (places[c] if c else 0) for c in cuts] + [stop]
        for i, c in enumerate(cuts):
            out.append((starts[i], starts[i + 1], words[c:cuts[i + 1] if i + 1 < len(cuts) else None]))
    return out


def runs(found: list[tuple[int, int, list[str]]]) -> list[bytes]:
    """The hash of every run, by the number of its first sentence."""
    joined = [" ".join(s[2]) for s in found]
    return [xxhash.xxh3_128_digest(" . ".join(joined[i:i + RUN])) for i in range(len(found) - RUN + 1)]


def _firsts(ids: pa.Array, hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Per document and run, whether it is the first of its hash among all ``hashes``, by id (nulls first), row and place."""
    order = np.roll(pc.array_sort_indices(ids).to_numpy(), ids.null_count)  # stable
    h = np.concatenate([hashes[i] for i in order])
    h1, h2 = _words(h)
    by = np.lexsort((h2, h1))  # stable, so that the first of equal ones is the least
    h1, h2 = h1[by], h2[by]
    first = np.ones(len(h), bool)
    first[by[1:][(h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])]] = False
    parts = np.split(first, np.cumsum([len(hashes[i]) for i in order])[:-1])
    return [parts[i] for i in np.argsort(order)]


def _words(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 bits and 32 more of every hash."""
    return np.ascontiguousarray(h[:, :2]).view(np.int64)[:, 0], h[:, 2]


def _cut(docs: DataFrame) -> DataFrame:
    """``(id, k1, k2, n, h1, h2, later)``: the number of sentences, 64 bits and 32 more of the hash of every run that is the
    first of its hash in its block, and the numbers of the other runs (none for ids that Arrow can't sort)."""
    most, sortable = BLOCK_RUNS, isinstance(docs.schema["id"].dataType, T.AtomicType)

    def done(block: list[tuple[list[pa.Array], list[int], list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        every = [h for _, _, hashes in block for h in hashes]
        firsts = iter(_firsts(pa.concat_arrays([names[0] for names, _, _ in block]), every) if sortable
                      else [np.ones(len(h), bool) for h in every])
        for names, n, hashes in block:
            first = [next(firsts) for _ in n]
            kept = [_words(h[f]) for h, f in zip(hashes, first)]
            yield pa.RecordBatch.from_arrays(
                [*names, pa.array(n, pa.int32()), pa.array([h1 for h1, _ in kept], pa.list_(pa.int64())),
                 pa.array([h2 for _, h2 in kept], pa.list_(pa.int32())),
                 pa.array([np.flatnonzero(~f) for f in first], pa.list_(pa.int32()))], names=["id", "k1", "k2", "n", "h1", "h2", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                n, hashes = [], []
                for t in part.column(3):
                    found = sentences(t.as_py())
                    n.append(len(found))
                    hashes.append(np.frombuffer(b"".join(runs(found)), np.int32).reshape(-1, 4))
                # taken out, as a slice would keep the texts of its batch
                block.append(([part.column(i).take(pa.array(range(len(n)))) for i in range(3)], n, hashes))
                size += len(n) + sum(map(len, hashes))
                if size >= most:
                    yield from done(block)
                    block, size = [], 0
        if block:
            yield from done(block)

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, k1 long, k2 long, n int, h1 array<long>, "
                                "h2 array<int>, later array<int>")


def _keys(id_col: str, text_col: str) -> list[Column]:
    """128 bits for a document's id and text."""
    both = F.col(id_col).cast("string"), F.col(text_col)
    return [F.xxhash64(*both).alias("k1"), F.xxhash64(F.lit("second"), *both).alias("k2")]


def covered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = False) -> DataFrame:
    """``(k1, k2, n, gone array<int>)``: the number of sentences and the numbers of those to remove, for documents that
    have any to remove, or with ``every`` for all (``gone`` null)."""
    ensure_checkpoint_dir(docs.sparkSession)
    cut = _cut(docs.select(F.col(id_col).alias("id"), *_keys(id_col, text_col), F.col(text_col).alias("text"))) \
        .withColumn("doc", F.monotonically_increasing_id()).checkpoint()
    places = cut.where(F.size("h1") > 0).withColumn("at", F.array_except(F.sequence(F.lit(0), F.col("n") - RUN), "later"))
    found = places.select("id", "doc", F.explode(F.arrays_zip("h1", "h2", "at")).alias("h")).select("id", "doc", "h.*")
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id", "doc", "at"))
    later = found.withColumn("nth", nth).where("nth > 1").select("doc", F.array("at").alias("starts")) \
        .unionAll(cut.where(F.size("later") > 0).select("doc", F.col("later").alias("starts")))
    gone = later.groupBy("doc").agg(F.flatten(F.collect_list("starts")).alias("starts")) \
        .select("doc", F.array_sort(F.array_distinct(F.flatten(F.transform(
            "starts", lambda i: F.sequence(i, i + (RUN - 1)))))).alias("gone"))
    # of equal rows the one of the least number, which meets no equal row before it, tells what all lose
    names = cut.groupBy("k1", "k2").agg(F.min("doc").alias("doc"), F.max("n").alias("n"))
    return names.join(gone, "doc", "left" if every else "inner").drop("doc")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", report: bool = False) -> DataFrame:
    """The documents, all columns kept, without the covered sentences.  With ``report`` instead
    ``(id, n_sentences, n_removed, removed, text)``; removed: ``start:stop`` of each span, joined by commas."""
    gone = covered(docs, id_col, text_col, every=report).select(*[F.col(c).alias(f"__{c}") for c in ("k1", "k2", "n", "gone")])
    if not report:
        gone = gone.checkpoint()
        size = gone.agg(F.count("*"), F.sum(F.size("__gone"))).first()
        gone = if_small(gone, size[0], 4 * (size[1] or 0))
    kept = docs.columns if not report else [id_col]
    rows = docs.select(*kept, F.col(text_col).alias("__text"), *[k.alias(f"__k{i}") for i, k in enumerate(_keys(id_col, text_col), 1)]) \
        .join(gone, ["__k1", "__k2"], "left").select(*kept, "__text", "__n", "__gone")
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    if report:
        schema += ", n_sentences int, n_removed int, removed string, text string"

    def clean(text: str | None, gone: list[int] | None) -> tuple[str, str | None]:
        if not gone:
            return "", text
        found, spans, out, at = sentences(text), [], [], 0
        for i in gone:
            start, stop, _ = found[i]
            out.append(text[at:start])
            at = stop
            if spans and spans[-1][1] == start:
                spans[-1][1] = stop
            else:
                spans.append([start, stop])
        return ",".join(f"{a}:{b}" for a, b in spans), "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = len(kept)
            gone = b.column(n + 2).to_pylist()
            done = [clean(t.as_py(), g) for t, g in zip(b.column(n), gone)]
            text = pa.array([d[1] for d in done], pa.string())
            if report:
                columns = [b.column(0), b.column(n + 1), pa.array([len(g or ()) for g in gone], pa.int32()),
                           pa.array([d[0] for d in done], pa.string()), text]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_sentences", "n_removed", "removed", "text"])
            else:
                columns = [text if c == text_col else b.column(i) for i, c in enumerate(kept)]
                yield pa.RecordBatch.from_arrays(columns, names=kept)

    return rows.mapInArrow(run, schema)
