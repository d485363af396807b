"""Exact best matches without all pairs: blocks of queries meet blocks of the pool, bounds decide what is scored.

Both searches are threshold algorithms within a block: what a candidate can reach at most is known before it is scored, and
scoring ends where that falls under the k-th score found. Blocks have a bounded number of rows, so that neither side has to fit
in one task or be broadcast; the best of all blocks meet in a window. `floor` lets a query state what is too little from the start.
"""

from __future__ import annotations

import heapq
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import similarity as sim

#: Rows of a block of queries (of fewer, where there are tasks enough) and of the pool.
QUERY_ROWS, LEAST_ROWS, POOL_ROWS = 2048, 64, 16_384
#: What rounding to two decimals can make of a score, to four, and to six.
_CENT, _TENTHOUSANDTH, _MILLIONTH = 0.0101, 1.01e-4, 2e-6


# --- edit similarity with partial alignment ---


def _lcs(bits: dict[str, int], size: int, text: str) -> int:
    """Longest common subsequence of a text with the one whose character places are in bits, one integer a row."""
    row = full = (1 << size) - 1
    for ch in text:
        if (at := bits.get(ch)) is not None:
            hit = row & at
            row = (row + hit | row - hit) & full
    return size - row.bit_count()


def edit_score(a: str | None, b: str | None) -> float:
    """The greater of 200 LCS / (|a| + |b|) of the whole texts and of the shorter with the best part of the longer; 0 if one is empty."""
    a, b = (a or "").strip(), (b or "").strip()
    if not a or not b:
        return 0.0
    if len(a) > len(b):
        a, b = b, a
    best = 0.0
    for short, long in ((a, b), (b, a)) if len(a) == len(b) else ((a, b),):
        bits: dict[str, int] = {}
        for i, ch in enumerate(short):
            bits[ch] = bits.get(ch, 0) | 1 << i
        m, n = len(short), len(long)
        best = max(best, 200 * _lcs(bits, m, long) / (m + n))
        for i in range(1 - m, n):
            part = long[max(0, i) : min(n, i + m)]
            if 200 * len(part) / (m + len(part)) > best:
                best = max(best, 200 * _lcs(bits, m, part) / (m + len(part)))
    return best


def edit_similarity(a: str, b: str) -> Column:
    def scored(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([edit_score(*t) for t in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(scored, "double")(a, b)


class Names:
    """Names of a block with, for each character, the names that hold it and how often."""

    def __init__(self, names: list[str]):
        self.names = names
        self.lengths = np.array([len(n) for n in names], np.int64)
        held: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, n in enumerate(names):
            for ch, c in Counter(n).items():
                held[ch].append((i, c))
        self.places = {ch: tuple(np.array(x) for x in zip(*rows, strict=True)) for ch, rows in held.items()}

    def common(self, name: str) -> np.ndarray:
        """How many characters each name has in common with this one, whatever their order."""
        common = np.zeros(len(self.names), np.int64)
        for ch, c in Counter(name).items():
            if ch in self.places:
                at, n = self.places[ch]
                common[at] += np.minimum(n, c)
        return common

    def bounds(self, name: str) -> np.ndarray:
        """At most so much is the edit score of each name: of m characters of the shorter text c are common, so its best part matches c of
        c characters."""
        common = self.common(name)
        return 200.0 * common / np.maximum(np.minimum(self.lengths, len(name)) + common, 1)

    def whole_bounds(self, name: str) -> np.ndarray:
        """At most so much is the ratio of the whole texts."""
        return 200.0 * self.common(name) / np.maximum(self.lengths + len(name), 1)

    def ratios(self, name: str, k: int | None, least: float) -> list[tuple[int, float]]:
        """Number and ratio of the k best names (of all, without k) from `least` on, and of those that rounding may bring level; by falling bounds."""
        bits: dict[str, int] = {}
        for i, ch in enumerate(name):
            bits[ch] = bits.get(ch, 0) | 1 << i
        bound = self.whole_bounds(name)
        best: list[float] = []
        found: list[tuple[int, float]] = []
        for i in np.argsort(-bound, kind="stable").tolist():
            floor = max(least, best[0] if k and len(best) == k else 0.0) - _TENTHOUSANDTH
            if bound[i] <= 0 or bound[i] < floor:
                break
            score = 200 * _lcs(bits, len(name), self.names[i]) / (len(name) + len(self.names[i]))
            if score > 0 and score >= floor:
                found.append((i, score))
                if k:
                    (heapq.heappushpop if len(best) == k else heapq.heappush)(best, score)
        floor = max(least, best[0] if k and len(best) == k else 0.0) - _TENTHOUSANDTH
        return [x for x in found if x[1] >= floor]


class NodeBlock:
    """Nodes of a pool by name: (level weight, is l3, spec, ids) for each."""

    def __init__(self, rows: list[dict]):
        kinds: dict[str, list[tuple]] = defaultdict(list)
        for r in rows:
            kinds[r["name"].strip()].append((sim.LEVEL_WEIGHT.get(r["level"], 0.5), r["level"], (r["spec"] or "").strip(), r["ids"]))
        self.names = Names(list(kinds))
        self.kinds = list(kinds.values())
        self.with_spec: dict[str, set[int]] = defaultdict(set)  # names with a node of level three of this spec
        for i, own in enumerate(self.kinds):
            for _, level, spec, _ in own:
                if level == "l3" and spec:
                    self.with_spec[spec].add(i)
        self.by_name: dict[str, tuple[np.ndarray, np.ndarray, dict[int, float]]] = {}
        self.by_spec: dict[tuple[str, str], float] = {}
        self.scored = 0

    def _order(self, name: str) -> tuple[np.ndarray, np.ndarray, dict[int, float]]:
        if name not in self.by_name:
            self.by_name.clear()  # queries come sorted by name
            bound = self.names.bounds(name)
            order = np.argsort(-bound, kind="stable")
            self.by_name[name] = bound, order[: int((bound > 0).sum())], {}
        return self.by_name[name]

    def best(self, name: str, spec: str, k: int, floor: float, excluded: frozenset[int]) -> list[tuple]:
        """(dict_id, level, name score, spec score, exact) of the k best names, nodes that rounding may bring level with them too."""
        name, spec = name.strip(), spec.strip()
        bound, order, known = self._order(name)
        most = 30.0 if spec else 0.0
        top = lambda x: min(100.0, 0.7 * x + most + (30 if x > 90 else 0))
        kth: list[float] = []
        found: list[tuple[float, tuple]] = []
        sure = self.with_spec.get(spec, set()) if spec else set()

        def look(i: int) -> None:
            if i not in known:
                known[i] = edit_score(name, self.names.names[i])
                self.scored += 1
            own, least = known[i], max(floor, kth[0] if len(kth) == k else 0.0) - _CENT
            if i not in sure and top(own) < least:
                return
            best = 0.0
            for weight, level, s, ids in self.kinds[i]:
                free = next((d for d in ids if d not in excluded), None)
                if free is None:
                    continue
                exact = level == "l3" and bool(spec) and s == spec
                if (spec, s) not in self.by_spec:
                    self.by_spec[spec, s] = edit_score(spec, s)
                near = self.by_spec[spec, s]
                score = 100.0 if exact else min(100.0, (sim.NAME_SHARE * own + sim.SPEC_SHARE * near) * weight + (30 if own > 90 else 0))
                if score > 0 and score >= least:
                    found.append((score, (free, level, own, near, exact)))
                best = max(best, score)
            if best > 0:
                (heapq.heappushpop if len(kth) == k else heapq.heappush)(kth, best)

        for i in sure:
            look(i)
        for i in order.tolist():
            if top(bound[i]) < max(floor, kth[0] if len(kth) == k else 0.0) - _CENT:
                break
            if i not in sure:
                look(i)
        least = max(floor, kth[0] if len(kth) == k else 0.0) - _CENT
        return [row for score, row in found if score >= least]


def _dealt(left: DataFrame, right: DataFrame, by_left: str, by_right: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of bounded size on both sides; every pair of blocks meets (qb, vb)."""
    n, tasks = max(1, left.count()), left.sparkSession.sparkContext.defaultParallelism
    nq, nv = max(-(-n // QUERY_ROWS), min(tasks, -(-n // LEAST_ROWS))), -(-max(1, right.count()) // POOL_ROWS)
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    return left.select("*", block(by_left, nq).alias("qb"), every(nv).alias("vb")), right.select("*", block(by_right, nv).alias("vb"), every(nq).alias("qb"))


def edit_top_k(queries: DataFrame, pool: DataFrame, k: int, spare: int = 0) -> DataFrame:
    """qid, dict_id, score of the nodes of the k best names of each query, by name and spec (`sim.match_score`), in every block; not all
    ranks are given, but all that the k best of different names need.

    queries: qid, name, spec, and if there are floor (least score) and excluded (ids that do not count, `spare` at most).
    pool: dict_id, level, name, spec. Nodes alike in level, name and spec count as one, with its least ids.
    """
    has = lambda c, default: F.col(c) if c in queries.columns else default
    q = queries.select("qid", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("spec", F.lit("")).alias("spec"), has("floor", F.lit(0.0)).alias("floor"), has("excluded", F.array().cast("array<bigint>")).alias("excluded"))
    rank = F.row_number().over(sim.Window.partitionBy("level", "name", "spec").orderBy("dict_id"))
    kinds = pool.select("level", F.trim("name").alias("name"), F.trim(F.coalesce("spec", F.lit(""))).alias("spec"), "dict_id").withColumn("_n", rank).filter(F.col("_n") <= spare + 1)
    kinds = kinds.groupBy("level", "name", "spec").agg(F.array_sort(F.collect_list("dict_id")).alias("ids"))
    left, right = _dealt(q, kinds, "name", "name")

    def best(asked: pa.Table, nodes: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and nodes.num_rows:
            block = NodeBlock(nodes.to_pylist())
            for r in sorted(asked.to_pylist(), key=lambda r: r["name"]):
                out += [(r["qid"], *row) for row in block.best(r["name"], r["spec"], k, r["floor"] or 0.0, frozenset(r["excluded"] or ()))]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, _TYPES, strict=True)], _NAMES)

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(best, "qid long, dict_id long, level string, name_score double, spec_score double, exact boolean")
    return found.select("qid", "dict_id", sim.match_score(F.col("name_score"), F.col("spec_score"), F.col("level"), F.col("exact")).alias("score"))


_NAMES = ["qid", "dict_id", "level", "name_score", "spec_score", "exact"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]


def ratio_pairs(left: DataFrame, right: DataFrame, l_text: str, r_text: str, k: int | None = None, least: float = 0.0) -> DataFrame:
    """l_text, r_text, score: of the pairs with a positive ratio of the whole texts, those from `least` on, with k those that the k best of each
    text of left need (in every block). Repeated texts count once, null ones not at all."""
    texts = lambda df, c: df.select(c).filter(F.col(c).isNotNull()).distinct()
    a, b = _dealt(texts(left, l_text), texts(right, r_text), l_text, r_text)

    def best(asked: pa.Table, pool: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and pool.num_rows:
            names = Names(pool.column(r_text).to_pylist())
            for text in asked.column(l_text).to_pylist():
                out += [(text, names.names[i], score) for i, score in names.ratios(text, k, least)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.string(), pa.string(), pa.float64()), strict=True)], [l_text, r_text, "score"])

    found = a.groupBy("qb", "vb").cogroup(b.groupBy("qb", "vb")).applyInArrow(best, f"`{l_text}` string, `{r_text}` string, score double")
    return found.filter(F.col("score") >= least)


# --- cosine over sparse vectors ---


class Postings:
    """Vectors of a block by term, with the greatest weight of each term."""

    def __init__(self, terms: list[list[str]], weights: list[np.ndarray]):
        number: dict[str, int] = {}
        term = np.array([number.setdefault(t, len(number)) for own in terms for t in own], np.int64)
        doc, w = np.repeat(np.arange(len(terms)), [len(t) for t in terms]), np.concatenate([*weights, np.empty(0)])
        order = np.lexsort((doc, term))
        edges = np.searchsorted(term[order], np.arange(len(number) + 1))
        self.size = len(terms)
        self.rows = {t: (doc[order[edges[i] : edges[i + 1]]], w[order[edges[i] : edges[i + 1]]]) for t, i in number.items()}
        self.most = {t: float(w.max()) for t, (_, w) in self.rows.items()}
        self.met = 0

    def best(self, terms: list[str], weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Vectors and scores (percent): the k best at least, and what rounding may bring level. Terms by falling bound; once the k-th score
        is over what is left, only vectors that can still pass it are looked up."""
        own = sorted(((w * self.most[t], t, w) for t, w in zip(terms, weights.tolist(), strict=True) if t in self.rows), reverse=True)
        rest = np.cumsum([0.0, *(100 * b for b, _, _ in own[::-1])])[::-1]
        scores, some, bar = np.zeros(self.size), None, 0.0
        for j, (_, t, w) in enumerate(own):
            doc, own_w = self.rows[t]
            if some is None:
                scores[doc] += 100 * w * own_w
                self.met += len(doc)
                bar = np.partition(scores, -k)[-k] - _MILLIONTH if self.size > k else 0.0
                if bar > rest[j + 1]:
                    some = np.flatnonzero(scores + rest[j + 1] >= bar)
            else:
                at = np.minimum(np.searchsorted(doc, some), len(doc) - 1)
                scores[some] += np.where(doc[at] == some, 100 * w * own_w[at], 0.0)
                self.met += len(some)
                bar = np.partition(scores[some], -k)[-k] - _MILLIONTH
                some = some[scores[some] + rest[j + 1] >= bar]
        found = np.flatnonzero((scores > 0) & (scores >= bar)) if some is None else some[scores[some] >= bar]
        return found, scores[found]


def cosine_top_k(a: DataFrame, b: DataFrame, a_key: str, b_key: str, k: int) -> DataFrame:
    """a_key, b_key, rank, score (percent, six decimals): the k nearest of b for each vector of a, both key, term, w; ties to the smaller key; a pair of equal keys is one like others."""
    rows = lambda df, key: df.groupBy(key).agg(F.collect_list(F.struct("term", "w")).alias("v")).select(F.col(key).alias("key"), F.col("v.term").alias("terms"), F.col("v.w").alias("w"))  # noqa: E731  # terms of one text
    left, right = _dealt(rows(a, a_key), rows(b, b_key), "key", "key")

    def best(asked: pa.Table, nodes: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if asked.num_rows and nodes.num_rows:
            keys = nodes.column("key").to_numpy()
            block = Postings(nodes.column("terms").to_pylist(), [np.array(w) for w in nodes.column("w").to_pylist()])
            for q, terms, w in zip(asked.column("key").to_pylist(), asked.column("terms").to_pylist(), asked.column("w").to_pylist(), strict=True):
                at, score = block.best(terms, np.array(w), k)
                out.append((np.full(len(at), q), keys[at], score))
        columns = [np.concatenate([o[j] for o in out]) if out else [] for j in range(3)]
        return pa.table({"q": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.int64()), "score": pa.array(columns[2], pa.float64())})

    found = left.groupBy("qb", "vb").cogroup(right.groupBy("qb", "vb")).applyInArrow(best, "q long, v long, score double")
    found = found.withColumn("score", F.round("score", 6)).filter("score > 0").select(F.col("q").alias(a_key), F.col("v").alias(b_key), "score")
    return sim.top_k(found, a_key, k, by=b_key)
