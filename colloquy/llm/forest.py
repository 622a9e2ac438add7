"""N-gram Jaccard self-join of documents with MinHash banding of a fixed depth.

1. ``signatures``: every document's set of five-word shingles becomes a signature of ``TREES`` x
   ``DEPTH`` minima.  Documents with equal shingle sets form a class and go on as one.
2. Each tree is a band: classes that share the first ``prefix_length()`` of its minima are a bucket.
   That length follows from the constants alone: the longest, up to ``DEPTH``, at which a pair at the
   threshold meets in some tree with probability ``RECALL``.  No trie is built, nothing is sorted and
   nothing shortened on data; the minima beyond it only serve the estimate.
3. Inside a bucket all signatures are compared; those whose estimate is within ``SLACK`` of the
   threshold are joined, and connected components over all buckets give the candidate groups, so
   that each class is in one group, whatever number of trees it met others in.
4. Inside a group every pair is verified on the exact shingle sets.  Links are counted, and their
   components are the near-duplicate groups.

A bucket or group of over ``BLOCK`` members is cut into blocks by hash, and every two blocks meet in
a task of their own: a task holds two blocks at most, and gives a row per member (its links, its
smallest local label), never the pairs.

Defined results: words are runs of letters, digits and underscores of the lower-cased text; a text
of fewer than five words is one shingle; null texts and texts without a word are alone; rows equal
in id and text are one document (each row gets its result); other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.llm.common import drop_worker_state, if_small, shuffle_partitions
from colloquy.llm.components import connected
from colloquy.session import ensure_checkpoint_dir

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 16, 6, 0.995
#: Four standard deviations of the estimate at the threshold.
SLACK = 4 * (THRESHOLD * (1 - THRESHOLD) / (TREES * DEPTH)) ** 0.5
BLOCK = 512
#: Words whose hashes a Python worker keeps before it starts anew, and shingles hashed at a time.
CACHE_WORDS, CHUNK = 100_000, 4_096
#: Hashes that the exact check of a block pair takes together.
PART = 1_000_000
_WORD = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def prefix_length(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree with probability ``recall``."""
    d = depth
    while d > 1 and 1 - (1 - threshold ** d) ** trees < recall:
        d -= 1
    return d


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _Words()
#: Odd multipliers, one for each minimum of a signature.
_MULTIPLIERS = np.random.default_rng(5).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    words = _WORD.findall((text or "").lower())
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for i in range(n):
        out = (out ^ (out >> np.uint64(29))) * _MIX + h[i:len(h) - n + 1 + i]
    return np.unique(out ^ (out >> np.uint64(32)))


def signature(hashes: np.ndarray) -> np.ndarray:
    low = np.full(len(_MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), CHUNK):
        low = np.minimum(low, (hashes[i:i + CHUNK, None] * _MULTIPLIERS).min(axis=0))
    return (low >> np.uint64(32)).astype(np.uint32)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, key, set binary, sig binary)``; set and sig are null without a word."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"),
                       F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_worker_state()
        for b in batches:
            sets, sigs = [], []
            for t in b.column(2):
                s = shingles(t.as_py())
                sets.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sets, pa.binary()), pa.array(sigs, pa.binary())],
                                             names=["id", "key", "set", "sig"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, set binary, sig binary")


class _Union:
    """Smallest member of each local component."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            low = np.minimum(self.up[a], self.up[b])
            new = self.up.copy()
            np.minimum.at(new, self.up[a], low)
            np.minimum.at(new, self.up[b], low)
            new = new[new]
            if (new == self.up).all():
                return
            self.up = new


def _estimates(members: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    sig = np.frombuffer(b"".join(members), np.uint32).reshape(len(members), -1)
    hit = np.zeros((len(left), len(right)), np.uint16)
    for j in range(sig.shape[1]):
        hit += sig[left, j][:, None] == sig[right, j]
    return hit / sig.shape[1] >= THRESHOLD - SLACK


def _shared(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many hashes every left and right set share, by products of 0/1 columns of those that two have."""
    both = np.zeros((len(left), len(right)))
    values, at = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.bincount(at, minlength=len(values)) > 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = shared[at]
    column, owner = (np.cumsum(shared) - 1)[at[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, CHUNK):
        i, j = np.searchsorted(column, [start, start + CHUNK])
        m = np.zeros((len(sets), CHUNK), np.float32)
        m[owner[i:j], column[i:j] - start] = 1
        both += m[left] @ m[right].T
    return both


def _exact(members: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    sets = [np.frombuffer(m, np.uint64) for m in members]
    size = np.array([len(s) for s in sets])
    if len(members) <= 12:
        both = np.array([[len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for b in right] for a in left], float)
    else:
        both = np.zeros((len(left), len(right)))
        # ranges of hashes, so that about PART hashes are compared at a time
        parts = -(-int(size.sum()) // PART)
        edges = np.array([i * ((1 << 64) // parts) for i in range(parts)], np.uint64)
        cuts = [[*np.searchsorted(s, edges), len(s)] for s in sets]
        for k in range(parts):
            both += _shared([s[c[k]:c[k + 1]] for s, c in zip(sets, cuts)], left, right)
    # whole numbers: no rounding at the threshold
    return 5 * both >= 4 * (size[left][:, None] + size[right] - both)


def _in_blocks(members: DataFrame, similar: Callable) -> DataFrame:
    """``members (grp, n, key, data)``, n the size of the group: ``(key, label, links)`` for each block pair a
    member is in; label is the smallest key of its component among the pair's similar members, links how
    many are similar to it."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own) \
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select(F.xxhash64("grp", F.least("own", "other"), F.greatest("own", "other")).alias("task"),
                "grp", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), "own", "key", "data")
    spread = dealt.repartition(shuffle_partitions(members.sparkSession), "task") \
        .sortWithinPartitions("task", "grp", "b1", "b2", "key").drop("task")

    def compare(part: list[tuple[int, int, bytes]], same: bool) -> dict[str, list]:
        key = [k for k, _, _ in part]
        side = np.array([s for _, s, _ in part])
        everyone = np.arange(len(part))
        left, right = (everyone, everyone) if same else (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max()))
        if not same and side.min() == side.max():
            return {"key": [], "label": [], "links": []}
        hit = similar([d for _, _, d in part], left, right)
        if same:
            np.fill_diagonal(hit, False)
        links = np.zeros(len(part), np.int64)
        links[left] += hit.sum(axis=1)
        if not same:
            links[right] += hit.sum(axis=0)
        a, b = np.nonzero(hit)
        local = _Union(len(part))
        local.add(left[a], right[b])
        some = np.flatnonzero(links)
        return {"key": [key[i] for i in some], "label": [key[local.up[i]] for i in some], "links": links[some].tolist()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {"key": [], "label": [], "links": []}
        task, part = None, []
        for b in batches:
            grp, b1, b2, own, key, data = (b.column(i) for i in range(6))
            for i in range(b.num_rows):
                now = (grp[i].as_py(), b1[i].as_py(), b2[i].as_py())
                if now != task:
                    if len(part) > 1:
                        for c, v in compare(part, task[1] == task[2]).items():
                            out[c] += v
                    task, part = now, []
                part.append((key[i].as_py(), own[i].as_py(), data[i].as_py()))
            yield pa.RecordBatch.from_pydict(out, schema=_LABELS)
            out = {"key": [], "label": [], "links": []}
        if len(part) > 1:
            yield pa.RecordBatch.from_pydict(compare(part, task[1] == task[2]), schema=_LABELS)

    return spread.mapInArrow(run, "key long, label long, links long")


_LABELS = pa.schema([("key", pa.int64()), ("label", pa.int64()), ("links", pa.int64())])


def _joined(labels: DataFrame) -> DataFrame:
    return connected(labels.select(F.col("key").alias("a"), F.col("label").alias("b")))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, key, grp, n_links, n_copies)`` for every document.  ``grp`` is the key that stands for its
    near-duplicate group, ``n_links`` the other classes at the threshold or more, ``n_copies`` the
    documents of its class."""
    ensure_checkpoint_dir(docs.sparkSession)
    signed = signatures(docs, id_col, text_col).checkpoint()
    classes = signed.where("set is not null").groupBy("set") \
        .agg(F.min("key").alias("rep"), F.first("sig").alias("sig"), F.count(F.lit(1)).alias("n_copies")).checkpoint()
    d = 4 * prefix_length()
    prefix = lambda t: F.xxhash64(t, F.expr(f"substring(sig, cast(t * {4 * DEPTH} + 1 as int), {d})"))
    places = classes.select("rep", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("t")) \
        .select("rep", prefix(F.col("t")).alias("grp"))
    # a table of its own, so that the join with it can split a hot bucket
    full = places.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1").checkpoint()
    met = places.join(if_small(full, full.count()), "grp").join(classes.select("rep", F.col("sig").alias("data")), "rep")
    near = _joined(_in_blocks(met.select("grp", "n", F.col("rep").alias("key"), "data"), _estimates)) \
        .select(F.col("label").alias("grp"), F.col("node").alias("key")).checkpoint()
    sizes = near.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).checkpoint()
    candidates = near.join(if_small(sizes, sizes.count()), "grp").checkpoint()
    n = candidates.count()
    texts = docs.select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"), F.col(text_col).alias("text")) \
        .join(if_small(candidates, n), "key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(
                [shingles(t.as_py()).tobytes() for t in b.column(3)], pa.binary())], names=["grp", "n", "key", "data"])

    exact = texts.select("grp", "n", "key", "text").mapInArrow(sets, "grp long, n long, key long, data binary") \
        .dropDuplicates(["key"])
    checked = _in_blocks(exact, _exact).checkpoint()
    linked = _joined(checked).join(checked.groupBy(F.col("key").alias("node")).agg(F.sum("links").alias("links")), "node") \
        .select(F.col("node").alias("rep"), F.col("label").alias("top"), "links")
    of_class = classes.select("set", "rep", "n_copies").join(linked, "rep", "left") \
        .select("set", F.coalesce("top", "rep").alias("grp"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), "n_copies")
    # texts without a word don't meet in one task: they have no class to be joined with
    alone = signed.where("set is null").select("id", "key", F.col("key").alias("grp"), F.lit(0).cast("long").alias("n_links"),
                                               F.lit(1).cast("long").alias("n_copies"))
    return signed.where("set is not null").join(of_class, "set").select("id", "key", "grp", "n_links", "n_copies").unionByName(alone)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, class_id, n_links, n_copies)``: ``class_id`` is the smallest id of the document's group."""
    grouped = similar_groups(docs, id_col, text_col).checkpoint()
    top = grouped.groupBy("grp").agg(F.min("id").alias("class_id"))
    return grouped.join(top, "grp").select(F.col("id").alias(id_col), "class_id", "n_links", "n_copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns kept, with one of each group: that of the smallest id."""
    grouped = similar_groups(docs, id_col, text_col).checkpoint()
    first = grouped.groupBy("grp").agg(F.min(F.struct("id", "key")).alias("first"))
    per_key = grouped.groupBy("grp", "id", "key").agg(F.count(F.lit(1)).alias("rows")).join(first, "grp") \
        .select("key", (F.col("first.key") == F.col("key")).alias("__stays"), "rows")
    marked = per_key.where(~F.col("__stays") | (F.col("rows") > 1)).select(F.col("key").alias("__key"), "__stays").distinct().checkpoint()
    keyed: Column = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    rows = docs.withColumn("__key", keyed).join(if_small(marked, marked.count()), "__key", "left")
    once = rows.where("__stays is null")
    repeated = rows.where("__stays").dropDuplicates(["__key"])  # equal rows
    return once.unionByName(repeated).select(*docs.columns)
