r"""Removal of byte strings that stand in a document before: 50 bytes that also start in a document of smaller doc_id.

Routing as in `anchors`: stretches of 50-byte windows with one repeated anchor meet in the shard of the anchor. A shard sorts
suffixes by a mergesort with hash comparisons (`suffix_sort`), checked against the bytes:
 * first the stretches as wholes: of equal ones, those of later documents are repeated from end to end, without a look at
   their windows;
 * then all windows of the stretches that are left, for anchors that still have different ones: in each group of equal
   windows those of documents after the first repeat.
Matches never cross documents, and are judged on the input: a window counts whether or not it is removed itself.

Defined results: null text = no bytes; order of documents: doc_id, null first; rows of one doc_id, whether equal or different, are not
before each other: nothing in them repeats because of each other; texts under 50 bytes are never touched; what is kept may be no
valid UTF-8, as bytes are cut, and is binary; extra columns are kept (the operator's own columns start with `_sb_`); an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import ByteWindows, ranges, repeats, with_repeats
from .common import small_batches, table
from .suffix_sort import HashedText, grouped

WINDOW, GRAM, SHARD_BYTES = 50, 24, 2_000_000


def judge(rows: list[tuple], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretch, first window and window after the last of what also starts in a document of smaller ord."""
    pieces = [r[6] for r in rows]
    text = b"".join(pieces)
    size = np.array([len(p) for p in pieces])
    begin = np.cumsum(size) - size
    o = np.array([r[2] for r in rows], np.int64)
    pair = np.array([r[:2] for r in rows], np.int64).reshape(-1, 2)
    group = np.cumsum(np.r_[True, (np.diff(pair, axis=0) != 0).any(axis=1)][: len(rows)])
    hashed = HashedText(text)
    # whole stretches
    order, new = grouped(text, begin, size, [size, group], own=hashed)
    kind = np.empty(len(rows), np.int64)
    kind[order] = np.cumsum(new) - 1
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(o[order], heads) if len(heads) else o
    gone = np.flatnonzero(o > least[kind])
    # the windows of one stretch of each kind, where a group has several kinds
    example = order[heads]
    many = np.bincount(group[example], minlength=int(group.max(initial=0)) + 1) > 1
    example = example[many[group[example]]]
    n = size[example] - window + 1
    own = np.repeat(np.arange(len(example)), n)
    offset = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
    at = begin[example][own] + offset
    padded = np.frombuffer(text + bytes(8), np.uint8).astype(np.uint64)
    head = np.zeros(len(at), np.uint64)
    for j in range(8):
        head = head << np.uint64(8) | padded[at + j]
    order, new = grouped(text, at, np.full(len(at), window), [head, group[example][own]], own=hashed)
    first = least[kind[example]][own]
    heads = np.flatnonzero(new)
    before = np.empty(len(at), bool)
    if len(at):
        before[order] = first[order] > np.repeat(np.minimum.reduceat(first[order], heads), np.diff(np.r_[heads, len(at)]))
    hit = np.flatnonzero(before) if len(at) else np.empty(0, np.int64)
    which, lo, hi = ranges(own[hit], offset[hit])
    # the stretches that are as the examples and of the same ord
    left = np.flatnonzero(o == least[kind])
    left = left[np.argsort(kind[left], kind="stable")]
    a, b = (np.searchsorted(kind[left], kind[example][which], side) for side in ("left", "right"))
    times = b - a
    member = left[np.repeat(a, times) + np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)]
    return np.r_[gone, member], np.r_[np.zeros(len(gone), np.int64), np.repeat(lo, times)], np.r_[(size - window + 1)[gone], np.repeat(hi, times)]


def cut_bytes(text: bytes, whole: bool, spans: list[dict] | None) -> tuple[int, int, int, bytes]:
    """Bytes, bytes removed, spans removed, bytes kept."""
    n = len(text)
    if whole:
        return (n, n, 1, b"") if n >= WINDOW else (n, 0, 0, text)
    kept, at = [], 0
    for s in spans or []:
        kept.append(text[at : s["start"]])
        at = s["stop"]
    left = b"".join([*kept, text[at:]])
    return n, n - len(left), len(spans or []), left


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _sb_bytes, _sb_removed, _sb_spans (how many) and _sb_kept (binary)."""
    small_batches(docs.sparkSession)
    found = repeats(docs, key, text, ByteWindows(WINDOW, GRAM), judge, SHARD_BYTES)

    def cut_(texts: list[bytes], wholes: list, spans: list) -> list[pa.Array]:
        out = [cut_bytes(*r) for r in zip(texts, wholes, spans, strict=True)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]

    return with_repeats(docs, found, key, text, cut_, dict(zip(_MADE, ("long", "long", "long", "binary"), strict=True)))


_MADE = ("_sb_bytes", "_sb_removed", "_sb_spans", "_sb_kept")


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(F.col(f"_sb_{c}").alias(f"n_{c}") for c in ("bytes", "removed", "spans")), F.sha2("_sb_kept", 256).alias("kept_sha256"))
