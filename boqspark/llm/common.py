"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession

from ..shared import cut, fresh_path, shared_dir  # noqa: F401

#: ASCII white space between words, as a character class body for Java and Python patterns.
SPACES = r"\x20\x09-\x0D"
WORD_PATTERN = rf"[^{SPACES}]+"
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of bounded rows and bytes, so that long texts do not swell a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def one_thread() -> None:
    """Native libraries inside a task use the task's own core only."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ["RAYON_NUM_THREADS"] = "1"


_kept: dict = {}


def kept(name: str, make):
    """What a worker keeps between tasks (tokenizers, word memos), for one name at a time: workers are used again by the next operator."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def word_hashes() -> "Memo":
    """word (bytes) -> 64-bit hash."""
    import xxhash

    return kept("word hashes", lambda: Memo(xxhash.xxh64_intdigest))


class Memo(dict):
    """word -> encoded bytes. Keeps the first `cap` words for the life of the worker; `make` handles the rest."""

    def __init__(self, make, cap: int = 400_000):
        super().__init__()
        self.make, self.cap = make, cap

    def __missing__(self, word):
        value = self.make(word)
        if len(self) < self.cap and len(word) < 64:
            self[word] = value
        return value


def by_key(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(k, rows) for each key of a task whose rows are sorted by k."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        k = b.column("k").to_numpy()
        heads = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else []
        for lo, hi in zip(heads, [*heads[1:], len(k)], strict=True):
            if held and k[lo] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(k[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, pa.Table.from_batches(held)
