"""Exact top-k by inner product: norm-sorted blocks, SVD-rotated partial sums, Cauchy-Schwarz bounds.

Vectors are sorted by descending length and cut into blocks.  All are rotated by the right singular
vectors of the whole table (from the sum of their outer products, one small row per pair of
dimensions), which moves most of the length into the first ``HEAD`` coordinates.  A query meets the
longest block first: its k-th best score there is a threshold.  After that

* a block whose longest vector cannot reach a query block's lowest threshold is never joined with it;
* inside a block, vectors too short for ``|q| |c| >= threshold`` are a tail that is cut;
* of the rest, only those are multiplied out whose head product plus the product of the residual
  lengths (the Cauchy-Schwarz bound on what the head leaves out) reaches the threshold.

The products that count are of the whole-number components, so scores are exact.  Blocks of queries
and blocks of vectors are equi-joined on the block number; a task holds one of each.

Defined results: vectors that are null or hold a null or non-finite component, and rows with a null
id, take no part; shorter vectors are padded with zeros; equal rows (id and vector) are one row; a
query's own row is no candidate, another row with its id is; ties go to the smaller id; fewer than
k candidates give fewer rows; other columns are not read.  Products beyond 2^53 are computed in
whole numbers; a score must fit 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.llm.common import shuffle_partitions
from colloquy.session import ensure_checkpoint_dir

HEAD = 16
#: Vectors and queries of a block, and the blocks there are at most (besides one for each partition):
#: with more rows than fill them, blocks grow.
VECTORS, QUERIES, BLOCKS = 2_048, 512, 65_536


def whole(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """``(id, v array<bigint>, norm)`` of the rows that take part."""
    ok = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~F.exists(
        vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(ok).select(F.col(id_col).alias("id"), F.transform(
        vec_col, lambda x: F.floor(x.cast("double") * scale)).alias("v")).dropDuplicates(["id", "v"]) \
        .withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _matrix(v: pd.Series, dims: int) -> np.ndarray:
    out = np.zeros((len(v), dims), np.int64)
    for i, x in enumerate(v):
        out[i, :len(x)] = x
    return out


def _rotation(rows: DataFrame, dims: int) -> np.ndarray:
    """Right singular vectors of all rows, the strongest first."""
    def outer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for b in batches:
            m = _matrix(b["v"], dims).astype(float)
            total += m.T @ m
        i, j = np.triu_indices(dims)
        yield pd.DataFrame({"i": i, "j": j, "s": total[i, j]})

    # at most dims x dims rows
    got = rows.select("v").mapInPandas(outer, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    gram = np.zeros((dims, dims))
    gram[got["i"], got["j"]] = gram[got["j"], got["i"]] = got["s"]
    return np.linalg.eigh(gram)[1][:, ::-1]


def _products(q: np.ndarray, c: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return (q.astype(object) @ c.astype(object).T).astype(np.int64)


def _best(score: np.ndarray, k: int) -> np.ndarray:
    """The k-th highest score of each row; the lowest whole number where there are fewer."""
    if score.shape[1] < k:
        return np.full(len(score), np.iinfo(np.int64).min)
    return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]


def _pack(size: int, dims: int):
    """Rows, in order, as blocks: ``(longest, n, ids, v)``."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.DataFrame()
        for b in batches:
            held = pd.concat([held, b], ignore_index=True)
            while len(held) >= size:
                yield block(held[:size])
                held = held[size:].reset_index(drop=True)
        if len(held):
            yield block(held)

    def block(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"longest": [float(rows["norm"].max())], "ids": [rows["id"].to_numpy(np.int64).tobytes()],
                             "v": [_matrix(rows["v"], dims).tobytes()]})

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, id, score)``: the ``k`` highest inner products of ``floor(scale * x)`` for each
    query row against every other row.  ``is_query`` is a condition on the id column."""
    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = whole(vectors, scale, id_col, vec_col).checkpoint()
    shape = rows.agg(F.max(F.size("v")).alias("dims"), F.max("norm").alias("norm"), F.count(F.lit(1)).alias("n")).first()
    dims, exact = shape["dims"] or 1, (shape["norm"] or 0.0) ** 2 < 2.0 ** 53
    turn = _rotation(rows, dims)
    head = min(HEAD, dims)
    parts, ordered = shuffle_partitions(spark), [F.col("norm").desc(), F.col("id")]
    blocks = rows.repartitionByRange(parts, *ordered).sortWithinPartitions(*ordered) \
        .mapInPandas(_pack(max(VECTORS, -(-shape["n"] // BLOCKS)), dims), "longest double, ids binary, v binary") \
        .withColumn("block", F.monotonically_increasing_id()).checkpoint()
    # the longest vectors: one block
    seeds = rows.orderBy(*ordered).limit(VECTORS).toPandas()
    # and the longest vector of every block: BLOCKS + partitions pairs at most
    longest = blocks.select("block", "longest").toPandas()
    first = spark.sparkContext.broadcast((seeds["id"].to_numpy(np.int64), _matrix(seeds["v"], dims),
                                          longest["block"].to_numpy(np.int64), longest["longest"].to_numpy(float)))

    def seed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, c, numbers, lengths = first.value
        for b in batches:
            out, able = [], []
            for raw_ids, raw, q_longest in zip(b["ids"], b["v"], b["longest"]):
                q_ids, q = np.frombuffer(raw_ids, np.int64), np.frombuffer(raw, np.int64).reshape(-1, dims)
                score = _products(q, c, exact)
                own = (q_ids[:, None] == ids[None, :])
                for i, j in zip(*np.nonzero(own)):
                    if (q[i] == c[j]).all():
                        score[i, j] = np.iinfo(np.int64).min
                out.append(_best(score, k))
                able.append(numbers[lengths * q_longest * (1 + 1e-9) >= float(out[-1].min())])
            yield b.assign(least=[x.tobytes() for x in out], able=able)

    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    queries = asked.repartition(parts, "id").mapInPandas(_pack(QUERIES, dims), "longest double, ids binary, v binary") \
        .mapInPandas(seed, "longest double, ids binary, v binary, least binary, able array<long>") \
        .withColumn("qblock", F.monotonically_increasing_id()).checkpoint()

    able = queries.select("qblock", F.explode("able").alias("block"))
    met = able.join(queries.select("qblock", F.col("ids").alias("qids"), F.col("v").alias("qv"), "least"), "qblock") \
        .join(blocks.select("block", "ids", "v"), "block")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples():
                yield _meet(np.frombuffer(r.qids, np.int64), np.frombuffer(r.qv, np.int64).reshape(-1, dims),
                            np.frombuffer(r.least, np.int64), np.frombuffer(r.ids, np.int64),
                            np.frombuffer(r.v, np.int64).reshape(-1, dims), int(r.qblock), turn, head, k, exact)

    found = met.select("qblock", "qids", "qv", "least", "ids", "v") \
        .mapInPandas(compare, "qblock long, query int, query_id long, id long, score long")
    # a partial limit before the shuffle, then k rows of each block
    order = Window.partitionBy("qblock", "query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


def _meet(q_ids: np.ndarray, q: np.ndarray, least: np.ndarray, ids: np.ndarray, c: np.ndarray, qblock: int,
          turn: np.ndarray, head: int, k: int, exact: bool) -> pd.DataFrame:
    """The candidates of one block that may be among the k best of the queries of another."""
    qf, cf = q.astype(float) @ turn, c.astype(float) @ turn
    q_len, c_len = np.linalg.norm(qf, axis=1), np.linalg.norm(cf, axis=1)
    room = 1e-9 * (q_len.max(initial=0) * c_len.max(initial=0) + 1)  # the bounds are rounded, the scores are not
    # tail: too short for every query (the block is sorted by length)
    n = int(((q_len[:, None] * c_len[None, :]) + room >= least[:, None]).any(axis=0).sum())
    ids, c, cf, c_len = ids[:n], c[:n], cf[:n], c_len[:n]
    bound = qf[:, :head] @ cf[:, :head].T + np.outer(np.linalg.norm(qf[:, head:], axis=1), np.linalg.norm(cf[:, head:], axis=1))
    may = bound + room >= least[:, None]
    own = np.argwhere(q_ids[:, None] == ids[None, :])
    for i, j in own:
        if (q[i] == c[j]).all():
            may[i, j] = False
    out = []
    for i in range(len(q)):
        j = np.flatnonzero(may[i])
        if not len(j):
            continue
        score = _products(q[i:i + 1], c[j], exact)[0]
        pick = np.lexsort((ids[j], -score))[:k]
        out.append(pd.DataFrame({"qblock": qblock, "query": i, "query_id": q_ids[i], "id": ids[j][pick], "score": score[pick]}))
    if not out:
        return pd.DataFrame({"qblock": [], "query": [], "query_id": [], "id": [], "score": []}).astype("int64")
    return pd.concat(out, ignore_index=True)
