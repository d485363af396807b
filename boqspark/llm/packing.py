"""Packing documents into training sequences by the sum-of-squares rule.

Every Spark task packs the documents of its partition online. A document's ids are cut at the sequence size; the
last piece goes to the open sequence whose fill level makes the sum of squared counts of partially filled
sequences smallest, tracked in an array of counts by level. Sequences that are still open at the end of a partition
(or when more than `max_open` are open, which bounds a task's memory) are joined without a cut, the fullest first, each by the
fullest level that has room for it; only what gaps are then left are filled with cuts from the least full ones, and the last
open sequence is cut into powers of two, which need no padding. `cut_tokens` counts what was moved by cuts.

Defined results: null text = empty text = the end id alone; repeated rows are packed one by one; sequence ids are
unique over the table: partition number * 2**32 + number within the partition; extra columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table
from .word_ids import WORDS, word_ids

SEQUENCE, END_ID = 4096, 2
#: Words that a worker keeps in the pipeline, where workers live on beside the stages that follow.
STAGE_WORDS = 300_000
SCHEMA = "doc_id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long"


class LevelPacker:
    """Open sequences by fill level. Rows out: (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, size: int, first_id: int, max_open: int = 2048):
        self.size, self.next_id, self.max_open = size, first_id, max_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}
        self.n_open = self.cut_tokens = 0
        self.done: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total // self.size * self.size
        for at in range(0, whole, self.size):
            self._close([(doc, at, ids[at : at + self.size], total)])
        if whole < total:
            self._place((doc, whole, ids[whole:], total))

    def _place(self, piece: tuple) -> None:
        """Squared counts change by 2 * (count[h + s] - count[h]) + 2; a new or a filled sequence changes one count only."""
        s, n = len(piece[2]), self.count
        change = 2 * (n[s:] - n[: self.size + 1 - s]) + 2
        change[0] = 2 * n[s] + 1
        change[-1] = 1 - 2 * n[self.size - s]
        change[1:][n[1 : self.size + 1 - s] == 0] = np.iinfo(np.int64).max
        h = int(np.argmin(change))
        if h:
            pieces = self.open[h].pop()
            n[h] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if h + s == self.size:
            self._close(pieces)
            return
        self.open.setdefault(h + s, []).append(pieces)
        n[h + s] += 1
        self.n_open += 1
        if self.n_open > self.max_open:
            self.settle(last=False)

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, ids.tobytes(), total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def settle(self, last: bool = True) -> None:
        """Join what is open by levels, then fill the gaps of the fullest from the least full. Before the end one sequence may stay open."""
        joined: list[list[list[tuple]]] = [[] for _ in range(self.size + 1)]
        levels: list[int] = []  # of joined sequences, ascending
        for h in sorted(self.open, reverse=True):
            for pieces in self.open[h]:
                at = bisect_right(levels, self.size - h)
                if at:
                    level = levels.pop(at - 1)
                    own = joined[level].pop() + pieces
                    level += h
                else:
                    own, level = pieces, h
                if level == self.size:
                    self._close(own)
                else:
                    joined[level].append(own)
                    insort(levels, level)
        queue = deque((level, own) for level in levels for own in joined[level][::-1])
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        while len(queue) > 1:
            level, own = queue.pop()
            while level < self.size and queue:
                room, (h, donor) = self.size - level, queue.popleft()
                moved, left = _split(donor, room)
                own, level = own + moved, level + min(h, room)
                self.cut_tokens += min(h, room)
                if left:
                    queue.appendleft((h - room, left))
            if level < self.size:
                queue.append((level, own))
                break
            self._close(own)
        for level, own in queue:
            if not last:
                self.open[level], self.count[level], self.n_open = [own], 1, 1
                return
            while own:
                part, own = _split(own, 1 << level.bit_length() - 1)
                self._close(part)
                level -= 1 << level.bit_length() - 1


def _split(pieces: list[tuple], n: int) -> tuple[list[tuple], list[tuple]]:
    """The first n ids of the pieces, and the rest."""
    first: list[tuple] = []
    for k, (doc, start, ids, total) in enumerate(pieces):
        if len(ids) >= n:
            rest = [(doc, start + n, ids[n:], total)] if len(ids) > n else []
            return [*first, (doc, start, ids[:n], total)], rest + pieces[k + 1 :]
        first.append(pieces[k])
        n -= len(ids)
    return first, []


def pack(docs: DataFrame, tokenizer_file: str, size: int = SEQUENCE, end_id: int = END_ID, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """A row per piece: doc_id, start, ids (little-endian 32-bit), doc_tokens, sequence_id, offset. words: how many a worker keeps the ids of."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = word_ids(tokenizer_file, words)
        packer = LevelPacker(size, TaskContext.get().partitionId() << 32)
        key_type = None
        for batch in batches:
            key_type = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(keys), 500):
                for k, ids in zip(keys[lo : lo + 500], reader.encode(texts[lo : lo + 500], end_id), strict=True):
                    packer.add(k, ids)
                yield from out(packer, key_type)
        packer.settle()
        if key_type is not None:
            yield from out(packer, key_type)

    def out(packer: LevelPacker, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"]
        types = [key_type, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        rows, packer.done = packer.done, []
        for lo in range(0, len(rows), 1000):
            columns = list(zip(*rows[lo : lo + 1000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return rows.mapInArrow(run, SCHEMA.format(kind=kind)).withColumnRenamed("doc_id", key)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select(
        "doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digest(pack(docs, public_tokenizers.path("word_bpe_49k.json"), words=STAGE_WORDS))
