"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Hashable, Iterable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.plans.small import BROADCAST_BYTES, BROADCAST_ROWS, if_small  # noqa: F401


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """Rows whose crc32(id as text) leaves ``remainder``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == remainder


def bounded_sample(rows: DataFrame, key: Sequence[Column | str], max_rows: int, salt: str) -> DataFrame:
    """About ``max_rows`` rows (all, if there are no more): those whose key hash lies under the
    share that the count allows.  Deterministic, no sort, nothing gathered in one task."""
    n = rows.count()
    if n <= max_rows:
        return rows
    steps = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.lit(salt), *key), F.lit(steps)) < int(steps * max_rows / n))


def is_held_out(doc_id: object, modulus: int, remainder: int) -> bool:
    """The same choice for one id, outside Spark."""
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % modulus == remainder


def text_blocks(texts: Iterable[str | None], chars: int) -> Iterator[tuple[int, list[str]]]:
    """``(place of the first, texts)`` of blocks of about ``chars`` characters; a null is empty."""
    block: list[str] = []
    start = size = 0
    for i, t in enumerate(texts):
        block.append(t or "")
        size += len(block[-1])
        if size > chars:
            yield start, block
            block, start, size = [], i + 1, 0
    if block:
        yield start, block


class WordCache:
    """What is known of words, in a worker that lives through many tasks.

    Words are kept as they come, which is the frequent ones first, until ``limit`` bytes are used;
    what comes later is known until ``end_block`` only.  So memory has a bound, and a new task finds
    the frequent words known."""

    def __init__(self, limit: int) -> None:
        self.limit, self.size = limit, 0
        self.known: dict[str, str] = {}
        self.passing: list[str] = []

    def put(self, word: str, value: str) -> None:
        """Both strings are taken to be of one byte a character, or wide ones of two."""
        if word in self.known:
            return
        self.known[word] = value
        # the heads of two strings, their characters, and a table entry of a table half full
        size = 270 + len(word) * (1 if word.isascii() else 2) + len(value) * (1 if value.isascii() else 2)
        if self.size + size > self.limit:
            self.passing.append(word)
        else:
            self.size += size

    def end_block(self) -> None:
        for word in self.passing:
            del self.known[word]
        self.passing.clear()


_STATE: dict[Hashable, Any] = {}


def worker_state(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task: that of one ``key`` at a time, made when first asked for."""
    if key not in _STATE:
        drop_worker_state()
        _STATE[key] = make()
    return _STATE[key]


def drop_worker_state() -> None:
    """Gives back what another operator left in this worker."""
    if _STATE:
        _STATE.clear()
        gc.collect()
        try:
            ctypes.CDLL(None).malloc_trim(0)  # glibc keeps freed memory otherwise
        except (OSError, AttributeError):
            pass
