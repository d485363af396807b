r"""Similarity join of documents on their word n-grams: universe partition and pigeonhole, verified exactly.

Sets of 5-word shingles with Jaccard similarity of at least 0.75 differ in at most (|r| + |s|) / 7 shingles.
 1. Partition. Sets of one size band hash their shingles into a fixed number of segments, more than the larger set
    of a pair can differ in, so that a linked pair shares a segment as a whole. A set takes part in its own band and,
    if a partner may be larger than the band, in the next. Small bands also index every segment with one shingle
    left out. A band in which some set leaves too few segments filled is cut finer and sketched again.
 2. Allocation by cost. A segment that nobody else has costs nothing: a set with more such segments than the allowed
    difference (a third of its size) has no partner in this band and drops out. The others leave out their weakest
    groups, as far as two partners still have one in common.
 3. Hubs. Within a group of sets that share a segment, every set is compared with the others around the least set
    (the hub), in blocks of bounded size: exact intersections by matrix products, links out as a forest. Blocks of one
    hub are first joined inside and with the hub, then, where components still differ, with each other.
 4. Components of the links by rounds of least labels, in Spark.
Equal sets are one class throughout, so exact copies cost nothing and no group is expanded into pairs. Shingles and
sets are known by 64- and 128-bit hashes.

Defined results: words are A-Z lower-cased `[^\x20\x09-\x0D]+`; fewer than five words: the whole sequence is the only
shingle; null text and texts without words have an empty set and link with nothing; repeated rows share a component;
a null doc_id is never a component's id unless all are null; extra columns are dropped by `components`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, cut, small_batches, table, word_hashes

SHINGLE, BLOCK, SMALL_BAND, BAND_RATIO, PER_SEGMENT = 5, 768, 200, 3, 2.2
#: Signatures that a task holds before it sends them, and shingles that one block of sets to be compared may hold.
RUN, BLOCK_SHINGLES = 2_000_000, 1_000_000
#: Signatures of a bucket that are unpacked at a time.
OPEN = 500_000
#: A key with more rows than this, and more than the BROADCAST_ROWS-th part of all, is joined by broadcast: there are BROADCAST_ROWS of them at most.
HOT = 1000
BROADCAST_ROWS = 1_000_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_EDGES = np.array([1 * BAND_RATIO**i for i in range(36)], np.int64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, n)
    k = min(SHINGLE, n)
    g = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        g *= _ODD
        g += h[j : j + n - k + 1]
    return np.unique(_mixed(g))


def name_of(s: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set."""
    return int(s.sum().astype(np.int64)), int((_mixed(s * _ODD).sum() ^ np.uint64(len(s))).astype(np.int64))


def bands_of(size: int) -> list[int]:
    own = int(np.searchsorted(_EDGES, size, side="right")) - 1
    return [own, own + 1] if 4 * size >= 3 * int(_EDGES[own + 1]) else [own]


def n_segments(band: int, finer: int) -> int:
    top = int(_EDGES[band + 1]) - 1
    return finer * (2 * top if top < SMALL_BAND * BAND_RATIO else int(top / PER_SEGMENT) + 1)


def signatures(s: np.ndarray, band: int, finer: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Values of the filled segments, of segments with one shingle left out, and whether enough are filled to find every smaller partner."""
    m = n_segments(band, finer)
    seg = _mixed(s + np.uint64(band * 7919 + finer)) % np.uint64(m)
    order = np.argsort(seg, kind="stable")
    seg, own = seg[order], s[order]
    heads = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
    sums = np.add.reduceat(own, heads)
    salt = _mixed(seg + np.uint64(band << 40))
    whole = _mixed(sums + salt[heads])
    less = np.zeros(0, np.uint64)
    count = np.diff(np.r_[heads, len(own)])
    need = 2 * len(s) // 7 + 1
    if m > int(_EDGES[band + 1]):  # a small band
        many = np.repeat(count, count) > 1
        less = _mixed(np.repeat(sums, count)[many] - own[many] + salt[many])
        return whole, less, len(heads) + int((count > 1).sum()) >= need
    return whole, less, len(heads) >= need


_NAMES = ["k", "a1", "a2", "ord", "n", "band", "total", "shared", "blob"]
_SKETCH = "k long, a1 long, a2 long, ord long, n long, band int, total int, shared int, blob array<binary>"


def _batch(size: int, **columns) -> pa.RecordBatch:
    types = {"band": pa.int32(), "total": pa.int32(), "shared": pa.int32(), "blob": pa.list_(pa.binary())}
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types.get(c, pa.int64())) if c in columns else pa.nulls(size, types.get(c, pa.int64())) for c in _NAMES], _NAMES)


def _task(a1: np.ndarray, parts: int) -> np.ndarray:
    return (_mixed(a1.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


class _Run:
    """Signatures of some distinct sets, a bounded number of them, packed by bucket when full."""

    def __init__(self) -> None:
        self.seen: set[tuple[int, int]] = set()
        self.a1, self.bands, self.values, self.owners, self.kinds, self.size = [], [], [], [], [], 0

    def add(self, a1: int, band: int, whole: np.ndarray, less: np.ndarray) -> None:
        for v, kind in ((whole, 1), (less, 0)):
            self.values.append(v)
            self.owners.append(np.full(len(v), len(self.a1), np.uint32))
            self.kinds.append(np.full(len(v), kind, np.uint8))
            self.size += len(v)
        self.a1.append(a1)
        self.bands.append(band)

    def packed(self, buckets: int) -> Iterator[pa.RecordBatch]:
        if not self.a1:
            return
        value = np.concatenate(self.values)
        bucket = ((value >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint64)
        by = np.argsort(bucket << np.uint64(32) | value & np.uint64(0xFFFFFFFF), kind="stable")  # within a bucket by value
        value = value[by].astype(np.uint32)
        owner, kind = np.concatenate(self.owners)[by], np.concatenate(self.kinds)[by]
        edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
        del bucket, by
        head = [np.array(self.a1, np.int64), np.array(self.bands, np.int8)]
        for k in range(buckets):
            at = slice(int(edges[k]), int(edges[k + 1]))
            if at.stop > at.start:
                own, local = np.unique(owner[at], return_inverse=True)
                parts = [value[at], local.astype(np.uint32 if len(own) > 65535 else np.uint16), np.packbits(kind[at]), *(h[own] for h in head)]
                yield _batch(1, k=[k], blob=[[p.tobytes() for p in parts]])


def _sketch(batches: Iterator[pa.RecordBatch], parts: int, buckets: int, finer: dict[int, int], only: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
    """Rows in: ord, text. Out: a row per document (name and size of its set; spread evenly by `k`), a row per distinct set
    of a run (with totals, by the task of the set), and the signatures, packed by bucket."""
    run, n_rows = _Run(), TaskContext.get().partitionId() if TaskContext.get() else 0
    for b in batches:
        rows, sets = [], []
        for o, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            s = shingles(text)
            a1, a2 = name_of(s)
            poor, counts = None, [0, 0]
            if len(s) and (a1, a2) not in run.seen:
                run.seen.add((a1, a2))
                own = bands_of(len(s))
                for band in own:
                    if only is not None and band not in only:
                        continue
                    whole, less, enough = signatures(s, band, finer.get(band, 1))
                    if not enough and band == own[0]:
                        poor = band
                    counts[band - own[0]] = len(whole)
                    run.add(a1, band, whole, less)
                sets.append((a1, a2, len(s), *counts))
                if run.size > RUN:
                    yield from run.packed(buckets)
                    run = _Run()
            rows.append((o, a1, a2, len(s), poor))
        if rows:
            o, a1, a2, n, poor = zip(*rows, strict=True)
            yield _batch(len(rows), k=(n_rows + np.arange(len(rows))) % parts, a1=a1, a2=a2, ord=o, n=n, band=poor)
            n_rows += len(rows)
        if sets:
            a1, a2, n, total, upper = zip(*sets, strict=True)
            yield _batch(len(sets), k=_task(np.array(a1, np.int64), parts), a1=a1, a2=a2, n=n, total=total, shared=upper)
    yield from run.packed(buckets)


def _groups(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of buckets in, sorted by bucket; out: what each set shares in a bucket and the hubs of those groups, packed for the task of the set. Other rows pass."""
    for _, rows in by_key(batches):
        blobs = rows.column("blob").is_valid()
        yield from rows.filter(pc.invert(blobs)).to_batches()
        if packed := rows.filter(blobs).column("blob").to_pylist():
            yield from _group(packed, parts)


def _group(blobs: list[list[bytes]], parts: int) -> Iterator[pa.RecordBatch]:
    """One bucket, as it was sent; unpacked in ranges of its values, so that only a bounded part of it is open at a time."""
    a1s = [np.frombuffer(blob[3], np.int64) for blob in blobs]
    shift = np.cumsum([0, *map(len, a1s)])
    values = [np.frombuffer(blob[0], np.uint32) for blob in blobs]
    a1, band = np.concatenate(a1s), np.concatenate([np.frombuffer(blob[4], np.int8) for blob in blobs])
    # one number per set and band, in the order of names; a set that several runs sketched counts once
    order = np.lexsort((band, a1))
    fresh = np.r_[True, (a1[order][1:] != a1[order][:-1]) | (band[order][1:] != band[order][:-1])]
    number = np.empty(len(a1), np.uint32)
    number[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    once = np.zeros(len(a1), bool)
    once[first] = True
    a1, band = a1[first], band[first]
    steps = max(1, -(-sum(map(len, values)) // OPEN))
    edges = [np.searchsorted(v, np.arange(steps + 1, dtype=np.uint64) * np.uint64(1 << 32) // np.uint64(steps)) for v in values]
    shared = np.zeros(len(a1), np.int64)
    found = []
    for i in range(steps):
        cuts = [slice(int(e[i]), int(e[i + 1])) for e in edges]
        value = np.concatenate([v[c] for v, c in zip(values, cuts, strict=True)])
        local = [np.frombuffer(blob[1], np.uint32 if len(a) > 65535 else np.uint16)[c].astype(np.uint32) + np.uint32(s) for blob, a, s, c in zip(blobs, a1s, shift, cuts, strict=False)]
        owner = np.concatenate(local)
        kind = np.concatenate([np.unpackbits(np.frombuffer(blob[2], np.uint8), count=len(v))[c] for blob, v, c in zip(blobs, values, cuts, strict=True)])
        mine = once[owner]
        value, owner, kind = value[mine], number[owner[mine]], kind[mine]
        order = np.lexsort((owner, band[owner], value))
        value, owner, kind = value[order], owner[order], kind[order]
        if not len(value):
            continue
        heads = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (band[owner[1:]] != band[owner[:-1]])])
        count = np.diff(np.r_[heads, len(value)])
        keep = np.repeat(owner[heads] != owner[np.r_[heads[1:], len(owner)] - 1], count)  # at least two different sets
        hub = np.repeat(owner[heads], count)[keep]
        owner, kind = owner[keep], kind[keep]
        shared += np.bincount(owner, weights=kind, minlength=len(a1)).astype(np.int64)
        pairs, at = np.unique(owner.astype(np.int64) * (len(a1) + 1) + hub, return_inverse=True)
        found.append((pairs, np.bincount(at.ravel(), weights=kind, minlength=len(pairs)).astype(np.int32)))  # whole segments with this hub
    if not found:
        return
    pairs, weight = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    del found
    pair_owner, pair_hub = pairs // (len(a1) + 1), pairs % (len(a1) + 1)
    pair_task = _task(a1[pair_owner], parts)
    by = np.lexsort((pair_owner, pair_task))
    pair_owner, pair_hub, pair_task, weight = pair_owner[by], pair_hub[by], pair_task[by], weight[by]
    for t in np.unique(pair_task).tolist():
        mine = slice(*np.searchsorted(pair_task, [t, t + 1]))
        own, n_hubs = np.unique(pair_owner[mine], return_counts=True)
        columns = [a1[own], band[own], shared[own].astype(np.int32), n_hubs.astype(np.int32), a1[pair_hub[mine]], weight[mine]]
        yield _batch(1, k=[t], blob=[[c.tobytes() for c in columns]])


def _live(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets and their shares in, sorted by k; out: (hub, set) rows, k = -1 and the hub in `ord`, for sets that can have a partner. Document rows pass."""
    for _, rows in by_key(batches):
        blobs, named = rows.column("blob").is_valid(), rows.column("total").is_valid()
        yield from rows.filter(pc.invert(pc.or_(blobs, named))).to_batches()
        sets, packed = rows.filter(named), rows.filter(blobs).column("blob").to_pylist()
        if packed and sets.num_rows:
            names = np.stack([sets.column(c).to_numpy().astype(np.int64) for c in ("a1", "a2", "n", "total", "shared")], axis=1)
            yield from _live_sets(np.unique(names, axis=0), packed)


def _live_sets(sets: np.ndarray, packed: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
    types = (np.int64, np.int8, np.int32, np.int32, np.int64, np.int32)
    a1, band, shared, n_hubs, hubs, weight = (np.concatenate([np.frombuffer(blob[i], t) for blob in packed]) for i, t in enumerate(types))
    packed.clear()
    names, number = np.unique(np.stack([a1, band.astype(np.int64)], axis=1), axis=0, return_inverse=True)
    number = number.ravel()
    met = np.bincount(number, weights=shared).astype(np.int64)
    row = np.repeat(number, n_hubs)
    order = np.argsort(row, kind="stable")
    row, hubs, weight = row[order], hubs[order], weight[order]
    at = np.searchsorted(row, np.arange(len(names) + 1))
    own_band = np.searchsorted(_EDGES, sets[:, 2], side="right") - 1
    edges: list[np.ndarray] = []
    held = 0
    for above in (0, 1):  # a set's own band, and the next
        total = sets[:, 3 + above]
        key = np.stack([sets[:, 0], own_band + above], axis=1)
        place = _find(names, key)
        ok = (total > 0) & (place >= 0)
        ok[ok] = 3 * (total[ok] - met[place[ok]]) <= sets[ok, 2]  # more segments alone than the allowed difference: no partner
        for i in np.flatnonzero(ok).tolist():
            mine = slice(at[place[i]], at[place[i] + 1])
            own = _needed(hubs[mine], weight[mine], int(sets[i, 0]), int(total[i] - sets[i, 2] // 3))
            edges.append(np.column_stack([own, np.broadcast_to(sets[i, :3], (len(own), 3))]))
            held += len(own)
            if held > 20_000:
                yield _edge_rows(edges)
                edges, held = [], 0
    if held:
        yield _edge_rows(edges)


def _edge_rows(edges: list[np.ndarray]) -> pa.RecordBatch:
    e = np.concatenate(edges)
    return _batch(len(e), k=np.full(len(e), -1), ord=e[:, 0], a1=e[:, 1], a2=e[:, 2], n=e[:, 3])


def _needed(hubs: np.ndarray, weight: np.ndarray, own: int, common: int) -> np.ndarray:
    """Hubs of a set that can't be left out. `common`: whole segments that it shares with any partner, at least.

    A set leaves out its weakest hubs as long as they cover less than half of `common`. As its partner does the same,
    a segment that both share always keeps its hub on both sides.
    """
    hubs, at = np.unique(hubs, return_inverse=True)
    weight = np.bincount(at.ravel(), weights=weight)[hubs != own]
    hubs = hubs[hubs != own]
    order = np.argsort(weight, kind="stable")
    return hubs[order[2 * np.cumsum(weight[order]) >= max(common, 0)]]


def _find(rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted pair among sorted distinct pairs, -1 if it is not there."""
    pair = np.dtype([("x", np.int64), ("y", np.int64)])
    have, want = (np.ascontiguousarray(x).view(pair).ravel() for x in (rows, wanted))
    at = np.minimum(np.searchsorted(have, want), len(have) - 1)
    return np.where(have[at] == want, at, -1)


def linked(sets: list[np.ndarray], first: int) -> list[tuple[int, int]]:
    """A forest of the links among the sets; with first > 0 only links between sets[:first] and the others, and among the others."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    token = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), size)
    order = np.argsort(token, kind="stable")
    token, row = token[order], row[order]
    fresh = np.r_[True, token[1:] != token[:-1]]
    column = np.cumsum(fresh) - 1
    often = np.bincount(column)[column] > 1
    row, column = row[often], np.unique(column[often], return_inverse=True)[1]
    both = np.zeros((n, n), np.float32)
    step, at = 4096, 0
    last = int(column.max()) + 1 if len(column) else 0
    while at < last:
        mine = slice(*np.searchsorted(column, [at, at + step]))
        m = np.zeros((n, min(step, last - at)), np.float32)
        m[row[mine], column[mine] - at] = 1
        both += m @ m.T
        at += step
    both = both.astype(np.int64)
    ok = 100 * both >= 75 * (size[:, None] + size[None, :] - both)
    if first:
        ok[:first, :first] = False
    label = np.arange(n)
    np.fill_diagonal(ok, True)
    while True:
        low = np.where(ok, label[None, :], n).min(axis=1)
        low = low[low]
        if (low == label).all():
            break
        label = np.minimum(low, label)
    return [(i, int(label[i])) for i in range(n) if label[i] != i]


def _verify(group: pa.Table) -> pa.Table:
    """One block: a1, a2, old (already joined among themselves), s. Links out."""
    order = np.argsort(~group.column("old").to_numpy(), kind="stable")
    a1, a2 = group.column("a1").to_numpy()[order], group.column("a2").to_numpy()[order]
    packed = group.column("s").to_pylist()
    sets = [np.frombuffer(packed[i], np.uint64) for i in order]
    links = linked(sets, int(group.column("old").to_numpy().sum()))
    x, y = ([p[i] for p in links] for i in (0, 1))
    return pa.table({"x1": a1[x], "x2": a2[x], "y1": a1[y], "y2": a2[y]}, schema=pa.schema([(c, pa.int64()) for c in ("x1", "x2", "y1", "y2")]))


def _with_hot(left: DataFrame, right: DataFrame, keys: list[str], count: str, rows: int, spread: Column) -> DataFrame:
    """left left-joined with right (a row per key, `count`: rows of left with it; rows: all of them), split by how common a key is.

    Keys of many rows are joined by broadcast: a key of more than `rows` / BROADCAST_ROWS rows is one of BROADCAST_ROWS at
    most. The others are joined by shuffle, in which rows that are done are spread by `spread` under keys of their own.
    """
    hot = F.col(count) > max(HOT, rows // BROADCAST_ROWS)
    values = [c for c in right.columns if c not in (*keys, count)]
    few = right.filter(hot).select(*[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(c).alias(f"_h{c}") for c in values])
    many = right.filter(~hot).select(*[F.col(k).alias(f"_c_{k}") for k in keys], *values)
    j = left.join(F.broadcast(few), [F.col(k) == F.col(f"_h_{k}") for k in keys], "left")
    done = F.col(f"_h_{keys[0]}").isNotNull()
    kind = left.schema[keys[0]].dataType
    away = F.xxhash64(spread) if kind.simpleString() == "bigint" else F.struct(*[F.xxhash64(F.lit(i), spread).alias(f.name) for i, f in enumerate(kind.fields)])
    j = j.withColumn("_dealt", F.when(done, away).otherwise(F.col(keys[0])))
    j = j.join(many, [F.col("_dealt") == F.col(f"_c_{keys[0]}"), *[F.col(k) == F.col(f"_c_{k}") for k in keys[1:]]], "left")
    out = [F.when(done, F.col(f"_h{c}")).otherwise(F.col(c)).alias(c) for c in values]
    return j.select(*left.columns, *out)


_LINKS = "x1 long, x2 long, y1 long, y2 long"


def least_labels(links: DataFrame) -> DataFrame:
    """Components of links (x1, x2)-(y1, y2): rows a1, a2, l1, l2 with the least name of the component as label."""
    at = lambda a, b, c: F.struct(F.col(a).alias("p"), F.col(b).alias("q")).alias(c)
    edges = links.select(at("x1", "x2", "u"), at("y1", "y2", "v")).filter("u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before, n = None, edges.count()
    while True:  # each node hangs on to the least neighbour; large star, then small star
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("c"))
        around = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).union(edges.select("u", F.col("v").alias("w")))
        large = _with_hot(around, low, ["u"], "c", 2 * n, F.col("w"))
        large = large.filter(F.col("w") > F.col("u")).select(F.col("w").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("c"))
        small = _with_hot(large, small_low, ["u"], "c", 2 * n, F.col("v"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        edges = cut(small.filter("u > v").distinct())
        n, check = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if (n, check) == before:
            break
        before = (n, check)
    return edges.select(F.col("u.p").alias("a1"), F.col("u.q").alias("a2"), F.col("v.p").alias("l1"), F.col("v.q").alias("l2"))


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """a1, a2, s: packed sets of the wanted classes (ord, a1, a2), each from the documents of one key."""
    w = wanted.select(F.col("ord").alias("_ord"), "a1", "a2")
    chosen = docs.join(F.broadcast(w) if n <= BROADCAST_ROWS else w, docs["ord"].eqNullSafe(w["_ord"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [shingles(t) for t in b.column(0).to_pylist()]
            names = np.array([name_of(s) for s in own], np.int64).reshape(-1, 2)
            right = (names[:, 0] == b.column(1).to_numpy()) & (names[:, 1] == b.column(2).to_numpy())
            made = pa.RecordBatch.from_arrays([b.column(1), b.column(2), pa.array([s.tobytes() for s in own], pa.binary())], ["a1", "a2", "s"])
            yield made.filter(pa.array(right, pa.bool_()))

    return chosen.select("text", "a1", "a2").mapInArrow(run, "a1 long, a2 long, s binary")


def _with_sets(sets: DataFrame, members: DataFrame, n: int) -> DataFrame:
    return sets.join(F.broadcast(members) if n <= BROADCAST_ROWS else members, ["a1", "a2"])


def components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """ord (the key), n_shingles, component_id: the least key of the component; a document without shingles is its own. A row per document."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(key).cast("long").alias("ord"), F.col(text).cast("string").alias("text"))
    finer: dict[int, int] = {}
    only: frozenset[int] | None = None
    classes = edges = None
    while True:
        at_hand = lambda x: x.repartition(parts, "k").sortWithinPartitions("k")
        sent = d.mapInArrow(lambda it, f=dict(finer), o=only: _sketch(it, parts, max(1, parts // 2), f, o), _SKETCH)
        told = at_hand(sent).mapInArrow(lambda it: _groups(it, parts), _SKETCH)
        rows = cut(at_hand(told).mapInArrow(_live, _SKETCH).drop("blob", "total", "shared"))
        own = rows.filter("k <> -1").select("ord", "a1", "a2", F.col("n").alias("n_shingles"), F.col("band").alias("poor"))
        found = rows.filter("k = -1").select(F.col("ord").alias("h"), "a1", "a2", "n")
        classes, edges = (own, found) if classes is None else (classes, edges.union(found))
        poor = [r["poor"] for r in own.filter("poor IS NOT NULL").select("poor").distinct().collect()]  # bands
        if not poor:
            break
        finer |= {b: 4 * finer.get(b, 1) for b in poor}
        only = frozenset(poor)
    edges = edges.distinct()
    least = classes.filter("n_shingles > 0").groupBy("a1", "a2").agg(F.min("ord").alias("ord"))
    # sets a block: BLOCK at most, and fewer where they are long (sets of one hub have sizes of one band)
    fits = F.greatest(F.lit(2), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_SHINGLES) / F.max("n")))).cast("int")
    hubs = edges.groupBy("h").agg(F.count("*").alias("leaves"), fits.alias("fits"))
    hub_sets = hubs.join(least, F.col("h") == F.col("a1")).select("h", "a1", "a2", "leaves", "fits")
    blocks = F.ceil(F.col("leaves") / F.col("fits")).cast("int")
    dealt = edges.join(hubs, "h").select("h", F.pmod(F.xxhash64("a1", "a2"), blocks).cast("int").alias("block"), "a1", "a2", "leaves", "fits")
    with_hub = hub_sets.select("h", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "a1", "a2", "leaves", "fits")
    members = cut(dealt.union(with_hub).distinct())
    wanted = cut(members.select("a1", "a2").distinct().join(least, ["a1", "a2"]))
    n_members, n_wanted = members.count(), wanted.count()
    sets = _sets(d, wanted, n_wanted)
    placed = _with_sets(sets, members.select("h", "block", "a1", "a2"), n_members).withColumn("old", F.lit(False))
    links = cut(placed.groupBy("h", "block").applyInArrow(_verify, _LINKS))
    labels = least_labels(links)
    wide = members.filter(F.col("leaves") > F.col("fits")).select("h", "fits", "a1", "a2").distinct()
    if not wide.isEmpty():  # hubs of several blocks: across blocks, where components still differ
        label = cut(wide.join(labels, ["a1", "a2"], "left").select("h", "fits", "a1", "a2", F.coalesce("l1", "a1").alias("l1"), F.coalesce("l2", "a2").alias("l2")))
        per = label.groupBy("h", "fits", "l1", "l2").agg(F.count("*").alias("c"))
        main = per.groupBy("h", "fits").agg(F.max(F.struct("c", "l1", "l2")).alias("m"), F.sum("c").alias("all"))
        main = main.select("h", F.col("m.l1").alias("m1"), F.col("m.l2").alias("m2"), F.ceil(F.col("m.c") / F.col("fits")).cast("int").alias("ob"), F.ceil((F.col("all") - F.col("m.c")) / F.col("fits")).cast("int").alias("xb"))
        told = label.drop("fits").join(main.filter("xb > 0"), "h").withColumn("old", (F.col("l1") == F.col("m1")) & (F.col("l2") == F.col("m2")))
        told = told.withColumn("place", F.pmod(F.xxhash64("a1", "a2"), F.when(F.col("old"), F.col("ob")).otherwise(F.col("xb"))).cast("int"))
        # the main component's blocks each meet every block of the others; those also meet each other
        with_main = told.filter("old").select("h", F.col("place").alias("i"), F.explode(F.sequence(F.lit(0), F.col("xb") - 1)).alias("j"), "a1", "a2", "old")
        others = told.filter("NOT old").select("h", F.explode(F.sequence(F.lit(0), F.col("ob") - 1)).alias("i"), F.col("place").alias("j"), "a1", "a2", "old")
        low = F.transform(F.sequence(F.lit(0), F.col("xb") - 1), lambda x: F.struct((-1 - F.least(x, F.col("place"))).alias("i"), F.greatest(x, F.col("place")).alias("j")))
        among = told.filter("NOT old").select("h", F.inline(low), "a1", "a2", "old").select("h", "i", "j", "a1", "a2", "old")
        again = cut(with_main.union(others).union(among))
        placed = _with_sets(sets, again, again.count())
        labels = least_labels(links.union(placed.groupBy("h", "i", "j").applyInArrow(_verify, _LINKS)))
    # component of each class with a label or with copies; the documents of all others are their own
    sizes = classes.filter("n_shingles > 0").groupBy("a1", "a2").agg(F.min("ord").alias("least"), F.count("*").alias("c"))
    labels = labels.unionByName(labels.select(F.col("l1").alias("a1"), F.col("l2").alias("a2"), "l1", "l2").distinct())
    grouped = sizes.join(labels, ["a1", "a2"], "left").filter("c > 1 OR l1 IS NOT NULL")
    grouped = cut(grouped.select("a1", "a2", "least", "c", F.coalesce("l1", "a1").alias("l1"), F.coalesce("l2", "a2").alias("l2")))
    heads = grouped.groupBy("l1", "l2").agg(F.min("least").alias("component"), F.count("*").alias("members"))
    placed = _with_hot(grouped, heads, ["l1", "l2"], "members", grouped.count(), F.xxhash64("a1", "a2")).select("a1", "a2", "c", "component")
    some = F.col("n_shingles") > 0  # documents without shingles have one name and no class
    named = classes.select("ord", "n_shingles", F.when(some, F.col("a1")).otherwise(F.xxhash64("ord")).alias("a1"), "a2")
    out = _with_hot(named, placed, ["a1", "a2"], "c", classes.count(), F.col("ord"))
    return out.select("ord", "n_shingles", F.when(some, F.coalesce("component", "ord")).otherwise(F.col("ord")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents")).withColumnRenamed("ord", "doc_id")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document of least id of each component stays, as do documents without shingles. Rows that share an
    id go or stay together, by whether one of them is the least of its component."""
    ids = components(docs).filter(F.col("component_id").eqNullSafe(F.col("ord"))).select(F.col("ord").alias("_kept")).distinct()
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi")
