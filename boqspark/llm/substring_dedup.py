r"""Removal of passages that stand in the corpus before: windows of 20 words whose words also start earlier.

Routing as in `anchors`: stretches of windows with one repeated anchor meet in the shard of the anchor. Each shard builds a
compressed FM-index over all its stretches, equal ones too; backward search over the wavelet matrix gives the matching
statistics of the streamed stretches: for an end, the longest part before it that also stands at an earlier place. The last end
of a stretch comes first: what its part covers needs no further look, so a stretch that stands earlier as a whole takes one
search. Then come the ends before that part. Parts of 20 words or more are reported as intervals, which go back to their
documents. Hashes tell exact copies of whole documents only; all else is compared word by word by the index.

Defined results: null text = no words; words `[^\x20\x09-\x0D]+` as they are; order of places: doc_id (null first),
then start; rows with the same doc_id and different texts are compared like other documents, their order within the
id is that of a hash of the text; identical rows (id and text) count as one document and get the same result; texts
under 20 words are never touched; extra columns are dropped by `find_repeats` and kept by the pipeline stage.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import Windows, ranges, repeats, with_repeats
from .common import small_batches, table
from .fm_index import NOWHERE, FMIndex

WINDOW, GRAM, SHARD_BYTES = 20, 10, 8_000_000


def numbered(pieces: list[bytes]) -> np.ndarray:
    """The words of the pieces as numbers from 1, a 0 after each piece. No word holds a line feed, which stands for the 0 and comes first."""
    words = pc.split_pattern(pa.array([b"\n " + b" \n ".join(pieces) + b" \n"], pa.large_binary()), " ").values
    return words.dictionary_encode().indices.to_numpy()[1:].astype(np.int64)


def judge(rows: list[tuple], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first window and window after the last of what also starts at an earlier place."""
    o, t1, start, size = (np.array([r[i] for r in rows], np.int64) for i in (2, 3, 4, 5))
    pair = np.array([r[:2] for r in rows], np.int64).reshape(-1, 2)
    group = np.cumsum(np.r_[True, (np.diff(pair, axis=0) != 0).any(axis=1)][: len(rows)])
    by = np.lexsort((start, t1, o, group))
    fresh = np.ones(len(rows), bool)  # rows of repeated documents once
    fresh[by[1:]] = np.any([np.diff(x[by]) != 0 for x in (start, t1, o, group)], axis=0)
    kept = np.flatnonzero(fresh & (np.bincount(group, weights=fresh)[group] > 1))
    if not len(kept):
        return kept, kept, kept
    symbols = numbered([rows[k][6] for k in kept.tolist()])
    size = size[kept]
    begin = np.r_[0, np.flatnonzero(symbols == 0)[:-1] + 1]
    row, offset = np.repeat(np.arange(len(kept)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    order = np.full(len(symbols), NOWHERE)
    order[(begin[row] + offset)[np.lexsort((start[kept][row] + offset, t1[kept][row], o[kept][row]))]] = np.arange(len(row))
    index = FMIndex(symbols, reach=int(size.max()) - 1 + window, order=order)
    longest = index.statistics(symbols, begin + size - 1 + window, order, window)
    first = np.where(longest > 0, size - 1 + window - longest, size)  # window from which on the last part covers all
    left = offset < np.minimum(first, size - 1)[row]
    row, offset = row[left], offset[left]
    hit = index.statistics(symbols, begin[row] + offset + window, order, window) > 0
    own, lo, hi = ranges(row[hit], offset[hit])
    last = np.flatnonzero(longest)
    return kept[np.r_[last, own]], np.r_[first[last], lo], np.r_[size[last], hi]


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ord, t1, whole (an exact copy of an earlier document), spans (start, stop in words): a row per document with a repeat."""
    small_batches(docs.sparkSession)
    return repeats(docs, key, text, Windows(WINDOW, GRAM), judge, SHARD_BYTES)


def cut_words(text: bytes, whole: bool, spans: list[dict] | None) -> tuple[int, int, str]:
    """Words, words removed, and the words left joined by one space."""
    words = text.split()
    n = len(words)
    if whole:
        return (n, n, "") if n >= WINDOW else (n, 0, b" ".join(words).decode())
    if spans:
        change = np.zeros(n + 1, np.int64)
        for s in spans:
            change[s["start"]] += 1
            change[s["stop"]] -= 1
        words = [w for w, c in zip(words, np.cumsum(change)[:n].tolist(), strict=True) if not c]
    return n, n - len(words), b" ".join(words).decode()


_MADE = ("_sd_words", "_sd_removed", "_sd_kept")


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _sd_words, _sd_removed and _sd_kept: words, words removed, and the words left joined by one space."""
    def cut_(texts: list[bytes], wholes: list, spans: list) -> list[pa.Array]:
        out = [cut_words(*r) for r in zip(texts, wholes, spans, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)]

    return with_repeats(docs, find_repeats(docs, key, text), key, text, cut_, dict(zip(_MADE, ("long", "long", "string"), strict=True)))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", F.col("_sd_words").alias("n_words"), F.col("_sd_removed").alias("n_removed"), F.sha2(F.col("_sd_kept").cast("binary"), 256).alias("kept_sha256")
    )


def stage_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated passages cut out; a text without any stays as it is. n_chars follows the text."""
    out = without_repeats(docs)
    text = F.when(F.col("_sd_removed") > 0, F.col("_sd_kept")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_sd_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
