"""Hard-negative mining by angular triangle filtering.

Directions are few (``REFERENCES``, centres fitted on a bounded sample); of every vector its angles to
all of them are stored.  On the sphere the angle between an anchor and another vector lies between the
largest difference and the smallest sum of their angles to a direction, which gives an interval for
their cosine and, multiplied by the lengths, for their score.  The intervals are widened by more than
rounding can amount to; only pairs whose interval meets the wanted window of scores are multiplied out,
in whole numbers.

Vectors are sorted by label, nearest direction and angle to it and cut into blocks; so a block has
narrow ranges of angles, and two blocks whose ranges say that no pair can be wanted never meet.

* Positives: the best rows of the anchor's label.  The window of an anchor is open above; it starts at
  its k-th best score in the most promising blocks of its label (first pass), the rest follows.
* Negatives: rows of other labels in the window that each positive's score sets.  Within a task the
  window of a positive is narrowed by the best negatives that the task has already seen.

Blocks of anchors and blocks of vectors are equi-joined on the block number; a pair of blocks gives a
few rows for each anchor, and the best of them are chosen by a window with a limit in every task.

Defined results: rows with a null id, label or vector, or a null or non-finite component, take no part;
shorter vectors are padded with zeros; rows equal in id, label and vector are one row; an anchor's own
row is no positive, another row with its id is; ties go to the smaller id; fewer rows than asked for
give fewer; an anchor without positives, or a positive without negatives in its window, gives none;
vectors of length zero score 0 with all; empty tables give none; other columns are not read, whatever
their names.  Labels are whole numbers.  A score must fit 64 bits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import bounded_sample, shuffle_partitions
from colloquy.session import ensure_checkpoint_dir

#: Directions, and rows of the sample that they are fitted on.
REFERENCES, SAMPLE_ROWS = 16, 4_096
#: Vectors and anchors of a block, and the blocks there are at most (besides one for each partition):
#: with more rows than fill them, blocks grow.
VECTORS, ANCHORS, BLOCKS = 2_048, 256, 65_536
#: Blocks that an anchor block meets before the others, and rows that a task holds before it hands them on.
FIRST, HELD_ROWS = 2, 500_000
LEAST = np.iinfo(np.int64).min


def _matrix(v: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(v), dims), np.int64)
    for i, x in enumerate(v):
        out[i, :len(x)] = x
    return out


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(rows of length one, lengths)``; a row of zeros stays."""
    f = m.astype(float)
    norm = np.linalg.norm(f, axis=1)
    return f / np.where(norm > 0, norm, 1)[:, None], norm


def fit_directions(sample: np.ndarray, many: int = REFERENCES, rounds: int = 8) -> np.ndarray:
    """Centres of unit vectors on the sphere: starts far apart, then a few rounds of averaging."""
    units = _units(sample)[0]
    units = units[np.abs(units).any(axis=1)]
    if not len(units):
        return np.eye(1, sample.shape[1])
    picked = [0]
    near = units @ units[0]
    while len(picked) < min(many, len(units)):
        picked.append(int(near.argmin()))
        near = np.maximum(near, units @ units[picked[-1]])
    centres = units[picked]
    for _ in range(rounds):
        own = (units @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, units)
        new, norm = _units(sums)
        centres = np.where(norm[:, None] > 1e-9, new, centres)
    return centres


def _angles(units: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ directions.T, -1, 1))


def _room(dims: int) -> float:
    """More than a computed angle can be wrong by: near 0 and pi the arc cosine magnifies rounding to its root."""
    return 8 * np.sqrt((dims + 4) * 2.3e-16)


def score_bounds(a_angles: np.ndarray, a_norm: np.ndarray, b_angles: np.ndarray, b_norm: np.ndarray,
                 dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest score of every row of ``a`` with every row of ``b``, from angles and lengths alone."""
    low = np.zeros((len(a_angles), len(b_angles)))
    high = np.full_like(low, np.pi)
    for j in range(a_angles.shape[1]):
        x, y = a_angles[:, j, None], b_angles[None, :, j]
        np.maximum(low, np.abs(x - y), out=low)
        both = x + y
        np.minimum(high, np.minimum(both, 2 * np.pi - both), out=high)
    room, norms = _room(dims), a_norm[:, None] * b_norm[None, :]
    slack = 1e-9 * (norms + 1)
    return (norms * np.cos(np.minimum(high + room, np.pi)) - slack, norms * np.cos(np.maximum(low - room, 0)) + slack)


def block_bounds(a_angles: np.ndarray, a_norms: np.ndarray, b_angles: np.ndarray, b_norms: np.ndarray,
                 dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for blocks: ``a_angles (directions, 2)`` and ``a_norms (2)`` are the ranges of one block,
    ``b_angles (blocks, directions, 2)`` and ``b_norms (blocks, 2)`` those of others."""
    gap = np.maximum(b_angles[:, :, 0] - a_angles[None, :, 1], a_angles[None, :, 0] - b_angles[:, :, 1])
    near = np.maximum(gap, 0).max(axis=1)
    least, most = b_angles[:, :, 0] + a_angles[None, :, 0], b_angles[:, :, 1] + a_angles[None, :, 1]
    # the largest of min(s, 2 pi - s) over the sums s of the range
    fold = np.where((least <= np.pi) & (most >= np.pi), np.pi, np.maximum(np.minimum(least, 2 * np.pi - least),
                                                                        np.minimum(most, 2 * np.pi - most)))
    room = _room(dims)
    low, high = np.cos(np.minimum(fold.min(axis=1) + room, np.pi)), np.cos(np.maximum(near - room, 0))
    least, most = a_norms[0] * b_norms[:, 0], a_norms[1] * b_norms[:, 1]
    slack = 1e-9 * (most + 1)
    return np.where(low < 0, most, least) * low - slack, np.where(high < 0, least, most) * high + slack


def _products(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    kind = float if exact else object
    return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)


def _rows(vectors: DataFrame, scale: int, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """``(id, label, v array<bigint>)`` of the rows that take part, each once."""
    ok = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(
        vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(ok).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v")).dropDuplicates(["id", "label", "v"])


BLOCK_SCHEMA = "ids binary, labels binary, v binary, angles binary, norms binary, angle_range binary, label_range array<long>, " \
               "norm_range array<double>"


def _pack(size: int, dims: int, directions: np.ndarray):
    """Sorted rows as blocks."""
    def block(rows: pd.DataFrame) -> pd.DataFrame:
        v = _matrix(rows["v"], dims)
        units, norms = _units(v)
        angles = _angles(units, directions)
        labels = rows["label"].to_numpy(np.int64)
        return pd.DataFrame({
            "ids": [rows["id"].to_numpy(np.int64).tobytes()], "labels": [labels.tobytes()], "v": [v.tobytes()],
            "angles": [angles.tobytes()], "norms": [norms.tobytes()],
            "angle_range": [np.stack([angles.min(axis=0), angles.max(axis=0)], axis=1).tobytes()],
            "label_range": [[int(labels.min()), int(labels.max())]], "norm_range": [[float(norms.min()), float(norms.max())]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for b in batches:
            held = pd.concat([held, b], ignore_index=True)
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:].reset_index(drop=True)
        if len(held):
            yield block(held)

    return run


class _Block:
    """A block as arrays."""

    def __init__(self, ids: bytes, labels: bytes, v: bytes, angles: bytes, norms: bytes) -> None:
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        n = len(self.ids)
        self.v, self.angles, self.norms = (np.frombuffer(v, np.int64).reshape(n, -1), np.frombuffer(angles).reshape(n, -1),
                                           np.frombuffer(norms))


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, of equal ones the smaller ids."""
    if len(score) > 4 * k + 16:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        able = np.flatnonzero(score >= cut)
        return able[np.lexsort((ids[able], -score[able]))[:k]]
    return np.lexsort((ids, -score))[:k]


class _Kept:
    """The best rows so far of each (anchor block, anchor, place), within one task."""

    def __init__(self, k: int) -> None:
        self.k, self.best, self.rows = k, {}, 0

    def least(self, key: tuple[int, int, int]) -> int:
        """From which score on a row can still be among the best."""
        found = self.best.get(key)
        return LEAST if found is None or len(found[0]) < self.k else int(found[0][-1])

    def add(self, key: tuple[int, int, int], score: np.ndarray, ids: np.ndarray) -> None:
        found = self.best.get(key)
        if found is not None:
            self.rows -= len(found[0])
            score, ids = np.concatenate([found[0], score]), np.concatenate([found[1], ids])
        pick = _best(ids, score, self.k)
        self.best[key] = score[pick], ids[pick]
        self.rows += len(pick)

    def hand_on(self) -> pd.DataFrame:
        items = [(*key, int(i), int(s)) for key, (score, ids) in self.best.items() for s, i in zip(score, ids)]
        self.best, self.rows = {}, 0
        return pd.DataFrame(items, columns=["ablock", "anchor", "place", "id", "score"]).astype("int64")


#: (anchors, other block, number of the anchor block, wanted(s) of each anchor, what is kept)
Meet = Callable[[_Block, _Block, int, object, _Kept], None]
FOUND_SCHEMA = "ablock long, anchor long, place long, id long, score long"


def _meetings(plan: DataFrame, anchors: DataFrame, blocks: DataFrame, k: int, meet: Meet) -> DataFrame:
    """``plan (ablock, block, want)`` carried out: every planned pair of blocks, in the task of the block."""
    mine = ["ids", "labels", "v", "angles", "norms"]
    pairs = plan.join(anchors.select("ablock", *[F.col(c).alias(f"a_{c}") for c in mine]), "ablock") \
        .join(blocks.select("block", *mine), "block").select("ablock", "want", *[f"a_{c}" for c in mine], *mine)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = _Kept(k)
        for b in batches:
            for r in b.itertuples(index=False):
                meet(_Block(*r[2:7]), _Block(*r[7:12]), int(r[0]), r[1], kept)
                if kept.rows > HELD_ROWS:
                    yield kept.hand_on()
        yield kept.hand_on()

    order = Window.partitionBy("ablock", "anchor", "place").orderBy(F.desc("score"), "id")
    return pairs.mapInPandas(run, FOUND_SCHEMA).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scores(a: _Block, i: int, b: _Block, able: np.ndarray, exact: bool) -> np.ndarray:
    return _products(a.v[i:i + 1], b.v[able], exact)[0]


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
         scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
         references: int = REFERENCES) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on the id column.  Scores are inner products of ``floor(scale * x)``.
    Positives are the ``positives`` best other rows of the anchor's label; for each, the ``negatives`` best
    rows of other labels with ``low * positive_score <= 100 * score <= high * positive_score``."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = _rows(vectors, scale, id_col, vec_col, label_col).checkpoint()
    norm2 = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    shape = rows.agg(F.max(F.size("v")).alias("dims"), F.max(norm2).alias("norm2"), F.count(F.lit(1)).alias("n")).first()
    dims, exact = max(1, shape["dims"] or 1), (shape["norm2"] or 0.0) < 2.0 ** 53
    # at most about SAMPLE_ROWS rows: the only use of the sample is to place the directions
    sample = bounded_sample(rows, ["id", "label"], SAMPLE_ROWS, "directions").select("v").toPandas()
    directions = fit_directions(_matrix(sample["v"], dims), references)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            angles = _angles(_units(_matrix(b["v"], dims))[0], directions)
            near = angles.argmin(axis=1)
            yield b.assign(cell=near.astype(np.int32), turn=angles[np.arange(len(b)), near])

    parts, order = shuffle_partitions(spark), ["label", "cell", "turn", "id"]
    placed = rows.mapInPandas(place, "id long, label long, v array<bigint>, cell int, turn double").checkpoint()

    def packed(some: DataFrame, size: int, number: str) -> DataFrame:
        return some.repartitionByRange(parts, *order).sortWithinPartitions(*order) \
            .mapInPandas(_pack(size, dims, directions), BLOCK_SCHEMA).withColumn(number, F.monotonically_increasing_id()).checkpoint()

    blocks = packed(placed, max(VECTORS, -(-shape["n"] // BLOCKS)), "block")
    asked = placed.withColumnRenamed("id", id_col).where(is_anchor).withColumnRenamed(id_col, "id")
    anchors = packed(asked, ANCHORS, "ablock")
    # the ranges of every block: BLOCKS + partitions rows at most
    seen = blocks.select("block", "angle_range", "label_range", "norm_range").toPandas()
    ranges = spark.sparkContext.broadcast((
        seen["block"].to_numpy(np.int64), np.array([np.frombuffer(x) for x in seen["angle_range"]]).reshape(len(seen), len(directions), 2),
        np.array([*map(list, seen["label_range"])], np.int64).reshape(-1, 2), np.array([*map(list, seen["norm_range"])], float).reshape(-1, 2)))

    def ranked(r) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For an anchor block: numbers and label ranges of all blocks and the bounds of their scores."""
        number, angles, labels, norms = ranges.value
        least, most = block_bounds(np.frombuffer(r.angle_range).reshape(-1, 2), np.array(r.norm_range), angles, norms, dims)
        return number, labels, least, most

    ranges_of = anchors.select("ablock", "angle_range", "label_range", "norm_range", "labels")

    # -- positives: the most promising blocks first, then what can still reach the k-th best

    def same_label(r, labels: np.ndarray) -> np.ndarray:
        return (labels[:, 0] <= r.label_range[1]) & (labels[:, 1] >= r.label_range[0])

    def first_plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                number, labels, _, most = ranked(r)
                able = np.flatnonzero(same_label(r, labels))
                able = able[np.argsort(-most[able], kind="stable")][:FIRST]
                yield pd.DataFrame({"ablock": r.ablock, "block": number[able], "want": None})

    def meet_positives(a: _Block, b: _Block, number: int, want: bytes | None, kept: _Kept) -> None:
        known = np.full(len(a.ids), LEAST) if want is None else np.frombuffer(want, np.int64)
        least = np.array([max(known[i], kept.least((number, i, 0))) for i in range(len(a.ids))])
        most = score_bounds(a.angles, a.norms, b.angles, b.norms, dims)[1]
        may = (most >= least[:, None]) & (a.labels[:, None] == b.labels[None, :])
        for i, j in np.argwhere((a.ids[:, None] == b.ids[None, :]) & may):
            if (a.v[i] == b.v[j]).all():
                may[i, j] = False  # the anchor's own row
        for i in range(len(a.ids)):
            able = np.flatnonzero(may[i])
            if len(able):
                score = _scores(a, i, b, able, exact)
                reach = score >= least[i]
                if reach.any():
                    kept.add((number, i, 0), score[reach], b.ids[able][reach])

    plan_schema = "ablock long, block long, want binary"
    plan = ranges_of.mapInPandas(first_plan, plan_schema)
    early = _meetings(plan, anchors, blocks, positives, meet_positives).checkpoint()
    # a block's anchors are ANCHORS rows at most, so this list is bounded
    reached = early.where(F.col("rank") == positives).groupBy("ablock").agg(F.collect_list(F.array("anchor", "score")).alias("reached"))

    def second_plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                number, labels, _, most = ranked(r)
                least = np.full(len(np.frombuffer(r.labels, np.int64)), LEAST)
                for anchor, score in r.reached if r.reached is not None else ():
                    least[anchor] = score
                able = np.flatnonzero(same_label(r, labels))
                able = able[np.argsort(-most[able], kind="stable")][FIRST:]
                able = able[most[able] >= least.min()]
                yield pd.DataFrame({"ablock": r.ablock, "block": number[able], "want": [least.tobytes()] * len(able)})

    plan = ranges_of.join(reached, "ablock", "left").mapInPandas(second_plan, plan_schema)
    late = _meetings(plan, anchors, blocks, positives, meet_positives)
    order_of = Window.partitionBy("ablock", "anchor").orderBy(F.desc("score"), "id")
    best = early.drop("rank").unionByName(late.drop("rank")).withColumn("rank", F.row_number().over(order_of)) \
        .where(F.col("rank") <= positives).select("ablock", "anchor", (F.col("rank") - 1).cast("long").alias("place"),
                                                  F.col("id").alias("positive_id"), F.col("score").alias("positive_score")).checkpoint()

    # -- negatives: a window of scores for each positive

    wanted = best.groupBy("ablock").agg(F.collect_list(F.array("anchor", "place", "positive_score")).alias("wanted"))

    def negative_plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                number, labels, floor, ceiling = ranked(r)
                # (anchor, place, lowest, highest) of every window that is not empty
                want = [(int(i), int(p), -(-low * int(s) // 100), high * int(s) // 100) for i, p, s in r.wanted]
                want = np.array(sorted(w for w in want if w[2] <= w[3]), np.int64).reshape(-1, 4)
                alone = (labels[:, 0] == labels[:, 1]) & (r.label_range[0] == r.label_range[1]) & (labels[:, 0] == r.label_range[0])
                able = np.flatnonzero(~alone)
                if len(want):
                    able = able[(ceiling[able] >= want[:, 2].min()) & (floor[able] <= want[:, 3].max())]
                    yield pd.DataFrame({"ablock": r.ablock, "block": number[able], "want": [want.tobytes()] * len(able)})

    def meet_negatives(a: _Block, b: _Block, number: int, want: bytes, kept: _Kept) -> None:
        want = np.frombuffer(want, np.int64).reshape(-1, 4)
        floor, ceiling = score_bounds(a.angles, a.norms, b.angles, b.norms, dims)
        starts = np.searchsorted(want[:, 0], np.arange(len(a.ids) + 1))
        for i in range(len(a.ids)):
            windows = [(int(p), max(int(lo), kept.least((number, i, int(p)))), int(hi)) for _, p, lo, hi in want[starts[i]:starts[i + 1]]]
            windows = [w for w in windows if w[1] <= w[2]]
            if not windows:
                continue
            may = np.zeros(len(b.ids), bool)
            for _, lo, hi in windows:
                may |= (ceiling[i] >= lo) & (floor[i] <= hi)
            able = np.flatnonzero(may & (b.labels != a.labels[i]))
            if not len(able):
                continue
            score = _scores(a, i, b, able, exact)
            for p, lo, hi in windows:
                inside = np.flatnonzero((score >= lo) & (score <= hi))
                if len(inside):
                    kept.add((number, i, p), score[inside], b.ids[able[inside]])

    plan = ranges_of.join(wanted, "ablock").mapInPandas(negative_plan, plan_schema)
    found = _meetings(plan, anchors, blocks, negatives, meet_negatives)

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                ids = np.frombuffer(r.ids, np.int64)
                yield pd.DataFrame({"ablock": r.ablock, "anchor": np.arange(len(ids)), "anchor_id": ids})

    ids = anchors.select("ablock", "ids").mapInPandas(names, "ablock long, anchor long, anchor_id long")
    return found.join(best, ["ablock", "anchor", "place"]).join(ids, ["ablock", "anchor"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
