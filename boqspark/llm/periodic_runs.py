r"""Periodic runs: stretches in which a passage is said again and again, each with its smallest period.

Words are numbered within a batch; a dictionary of basic factors then names, per power of two, every factor of so many
words that stands more than once in its document (all others can be in no repeat and get no name). At each length the
successor of a factor, if it comes within twice that length, proposes the distance as a period: neighbouring places
with one distance are one proposal, as their occurrences form one arithmetic progression. A proposal is extended both
ways by the names, from the longest factors down, and equal runs are told once.

A run of period q and 3 * q words or more holds a factor of L words, q <= L < 2 * q, and its successor q words on; so all
runs are proposed, and a proposed distance is the smallest period of what it extends to, as any smaller one would have
brought a nearer successor. Documents are independent: one pass, no shuffle, memory bounded by a batch of words.

Defined results: null text = no words, no runs; words `[^\x20\x09-\x0D]+` as they are; a null doc_id has no planted
repeat in the query; rows with the same doc_id, and identical rows, are looked at each for itself; extra columns are kept
(the operator's own columns start with `_pr_`); an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

LEAST_WORDS, LEAST_TIMES = 24, 3
#: Log of the least factor whose successors propose periods: runs of a small period have LEAST_WORDS words, which hold it.
FIRST_LEVEL = 3
#: Words looked at together; a longer document is looked at alone.
BATCH_WORDS = 500_000
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def basic_factors(doc: np.ndarray, word: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per power of two: the name of the factor at each place (-1 where it stands once in its document), the named places
    and the distance to their successors (0 without one)."""
    n = len(word)
    at = np.arange(n)
    key = doc * (int(word.max(initial=0)) + 1) + word
    span = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        own, at = key[order], at[order]
        same = own[1:] == own[:-1]
        many = np.r_[same, False] | np.r_[False, same]
        ahead = np.r_[np.where(same, np.diff(at), 0), 0] if len(at) else at
        name = np.cumsum(np.r_[True, ~same])[many]
        at, ahead = at[many], ahead[many]
        if not len(at):
            return
        names = np.full(n, -1, np.int32)
        names[at] = name
        back = np.argsort(at)
        at, ahead = at[back], ahead[back]
        yield names, at, ahead
        at = at[at + span < n]
        at = at[(names[at + span] >= 0) & (doc[at] == doc[at + span])]
        key = names[at].astype(np.int64) * (len(own) + 1) + names[at + span]
        span *= 2


def _extent(names: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool) -> np.ndarray:
    """Words that agree from i and j on, or right before i and j."""
    n, out = len(names[0]), np.zeros(len(i), np.int64)
    for k in range(len(names) - 1, -1, -1):
        shift = -(out + (1 << k)) if back else out
        a, b = i + shift, j + shift
        inside = (a >= 0) & (b < n)
        own, other = names[k][np.where(inside, a, 0)], names[k][np.where(inside, b, 0)]
        out += (inside & (own >= 0) & (own == other)).astype(np.int64) << k
    return out


def runs_of(doc: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Rows (first place, words, period) of all runs, by place, then period. doc: number of the document of each place, word: number of its word."""
    names, proposals = [], []
    for level, (name, at, ahead) in enumerate(basic_factors(doc.astype(np.int64), word.astype(np.int64))):
        names.append(name)
        if level < FIRST_LEVEL:
            continue
        near = (ahead > 0) & (ahead <= 2 << level)
        at, ahead = at[near], ahead[near]
        first = np.r_[True, (np.diff(at) != 1) | (np.diff(ahead) != 0)][: len(at)]
        proposals.append(np.stack([at[first], ahead[first]]))
    if not proposals:
        return np.empty((0, 3), np.int64)
    at, period = np.concatenate(proposals, axis=1)
    left, right = _extent(names, at, at + period, True), _extent(names, at, at + period, False)
    found = np.stack([at - left, left + right + period, period], axis=1)
    found = found[found[:, 1] >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)]
    return np.unique(found[:, [0, 2, 1]], axis=0)[:, [0, 2, 1]]


def _batch(texts: list[list[bytes]]) -> tuple[pa.Array, list[str]]:
    """Runs of each text, and its words without what a run repeats."""
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes) - sizes
    number: dict[bytes, int] = {}
    word = np.fromiter((number.setdefault(w, len(number)) for t in texts for w in t), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(texts)), sizes)
    found = runs_of(doc, word)
    own = doc[found[:, 0]] if len(found) else np.empty(0, np.int64)
    change = np.zeros(len(word) + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    dropped = np.cumsum(change) > 0
    collapsed = []
    for k, t in enumerate(texts):
        gone = dropped[begin[k] : begin[k] + sizes[k]]
        collapsed.append(b" ".join([w for w, x in zip(t, gone.tolist(), strict=True) if not x] if gone.any() else t).decode())
    offsets = np.searchsorted(own, np.arange(len(texts) + 1)).astype(np.int32)
    columns = [found[:, 0] - begin[own], found[:, 1], found[:, 2]]
    fields = [pa.array(c, pa.int64()) for c in columns]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"])), collapsed


def with_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", rewrite: Callable[[list[bytes], int | None], list[bytes]] | None = None) -> DataFrame:
    """docs with _pr_runs (start, length, period in words, by start, then period), and _pr_collapsed: the words that no run
    holds after its first period, joined by one space. `rewrite` gets each text's words and key and gives the words to look at."""
    small_batches(docs.sparkSession)
    names = docs.columns
    at, key_at = names.index(text), names.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts: list[list[bytes]] = []
            held = begin = 0
            keys = b.column(key_at).to_pylist() if rewrite else []
            for i in range(b.num_rows):
                words = (b.column(at)[i].as_py() or "").encode().split()
                texts.append(rewrite(words, keys[i]) if rewrite else words)
                held += len(words)
                if held >= BATCH_WORDS or i == b.num_rows - 1:
                    runs, collapsed = _batch(texts)
                    part = b.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([*part.columns, runs, pa.array(collapsed, pa.string())], [*names, "_pr_runs", "_pr_collapsed"])
                    begin, texts, held = i + 1, [], 0

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"_pr_runs {RUNS}", "_pr_collapsed string"])
    return docs.mapInArrow(run, schema)


def strongest(runs: Column) -> Column:
    """The run of most periods, exactly compared; of equals the first by start, then period. Null without any."""
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    more = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    return F.aggregate(runs, none, lambda best, r: F.when(more(best, r), r).otherwise(best))


def planted(words: list[bytes], key: int | None) -> list[bytes]:
    """The query's own test case: in a tenth of the documents, told by their ids, the words from a place on repeat with a period."""
    h = 1 if key is None else zlib.crc32(str(key).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=planted)
    best, lines = strongest(F.col("_pr_runs")), F.transform("_pr_runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    out = out.withColumns({"_best": best, "_lines": F.concat_ws("", F.transform(lines, lambda x: F.concat(x, F.lit("\n"))))})
    return out.select(
        "doc_id",
        F.size("_pr_runs").cast("long").alias("n_runs"),
        *(F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(F.col("_lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("_pr_collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
