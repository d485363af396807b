"""Approximate nearest neighbours by cosine: inverted lists with an adaptive dimension scan.

Unit vectors are turned by a fixed random rotation and dealt to the list of their nearest centroid. A query scans
its nearest lists in column blocks: after each block a hypothesis test compares the partial squared distance,
scaled up to all dimensions, with the query's fifth-best distance so far, and abandons candidates that are very
unlikely to get below it. Survivors are scored exactly, in double precision, on the original vectors.

The centroids, and the number of lists to probe for the recall `target`, come from a bounded sample (`sample` rows
at most, the smallest hashes of vec_id); every row is indexed. Lists and their queries are split into blocks of bounded size, so a list that holds a third of all rows is
scanned by many tasks. Candidates are scanned in the order of vec_id, so ties go to the smaller one.

Defined results: rows with a null vec_id, a null, empty or zero vector, or one with null or non-finite components
take no part, nor do vectors whose length differs from the most common one; every row is a candidate and a query of its
own, also if vec_id and vector repeat (of a query, only its own row is left out; for queries from another table, the rows of
its vec_id); vectors are scaled by a power of two before any product, so huge or tiny components are exact; fewer than `k`
candidates: all of them; extra columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, small_batches, table

BLOCK_ROWS, QUERY_ROWS = 8192, 2048


def usable(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0)


def rotation(dim: int, seed: int = 1) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 2) -> np.ndarray:
    """Spherical k-means on unit rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.bincount(own, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-30)
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, target: float, asked: int = 256, seed: int = 4) -> int:
    """Lists to probe so that the share `target` of true neighbours within the sample is found."""
    at = np.random.default_rng(seed).choice(len(x), min(asked, len(x)), replace=False)
    near = x[at] @ x.T
    near[np.arange(len(at)), at] = -2
    best = np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(at), 0), int)
    own = np.argmax(x @ c.T, axis=1)
    place = np.argsort(np.argsort(-(x[at] @ c.T), axis=1), axis=1)
    ranks = np.take_along_axis(place, own[best], axis=1).ravel()
    return int(np.quantile(ranks, target, method="higher")) + 1 if len(ranks) else 1


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows scaled to a largest component between 1/2 and 1, by a power of two: cosines stay as they are."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def scan(q: np.ndarray, x: np.ndarray, qo: np.ndarray, xo: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, width: int, strict: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the best k candidates of one query: q, x rotated unit vectors; qo, xo originals; ids ascending; own: what is none."""
    dim = len(q)
    alive = np.flatnonzero(~own)
    first, rest = alive[: 8 * k], alive[8 * k :]
    score = lambda at: (xo[at] * qo).sum(axis=1) / (np.sqrt((xo[at] * xo[at]).sum(axis=1)) * np.sqrt((qo * qo).sum()))
    got, best = first, score(first)
    for lo in range(0, len(rest), 2048):
        part = rest[lo : lo + 2048]
        bar = 2 - 2 * np.partition(best, -k)[-k] if len(best) >= k else 4.0
        near = np.zeros(len(part))
        for a in range(0, dim, width):
            b = min(dim, a + width)
            gap = x[part, a:b] - q[a:b]
            near += (gap * gap).sum(axis=1)
            if b < dim:  # is the whole distance over the bar, as far as b of the dim rotated dimensions tell?
                keep = near * (dim / b) <= max(bar, 1e-12) * (1 + strict / np.sqrt(b)) ** 2
                part, near = part[keep], near[keep]
                if not len(part):
                    break
        if len(part):
            got, best = np.concatenate([got, part]), np.concatenate([best, score(part)])
            if len(best) > 16 * k:
                top = np.lexsort((ids[got], -best))[:k]
                got, best = got[top], best[top]
    top = np.lexsort((ids[got], -best))[:k]
    return got[top], best[top]


def search(vectors: DataFrame, queries: DataFrame | Column, k: int = 5, target: float = 0.97, sample: int = 20_000, lists: int | None = None, width: int = 16, strict: float = 2.1) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, embedding; queries: likewise, or the condition on vec_id that makes a row of vectors one."""
    spark = vectors.sparkSession
    small_batches(spark)
    clean = lambda d: d.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = clean(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dim, n = sizes["d"], sizes["count"]
    base = clean(vectors).filter(F.size("v") == dim)
    drawn = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()["v"]
    drawn = _matrix(drawn, dim)
    drawn = drawn / np.linalg.norm(drawn, axis=1, keepdims=True)
    n_lists = min(lists or int(min(4096, max(1, np.sqrt(n)))), len(drawn))
    middle = centroids(drawn, n_lists)
    probes = probes_for(drawn, middle, k, target)
    centres = spark.sparkContext.broadcast(middle.astype(np.float32))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            own = np.argmax(x.astype(np.float32) @ centres.value.T, axis=1) if len(x) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column(0), b.column(1)], ["list", "vec_id", "v"])

    path = fresh_path(spark, "lists")  # the index: each row once, with a number of its own
    base.mapInArrow(assign, "list int, vec_id long, v array<double>").withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
    dealt = spark.read.parquet(path)
    held = {r["list"]: r["count"] for r in dealt.groupBy("list").count().collect()}  # a row per list

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.array([held.get(i, 0) for i in range(n_lists)])
        for b in batches:
            x = _matrix(b.column(2), dim)
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            near = np.argsort(-(x.astype(np.float32) @ centres.value.T), axis=1, kind="stable")
            found = []
            for row in near:
                size = np.cumsum(counts[row])
                found.append(row[: max(probes, int(np.searchsorted(size, 16 * k)) + 1)].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int32()))], ["query", "query_id", "v", "lists"])

    inside = isinstance(queries, Column)
    asked = dealt.filter(queries).select("row", "vec_id", "v") if inside else clean(queries).filter(F.size("v") == dim).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v")
    probed = asked.mapInArrow(probe, "query long, query_id long, v array<double>, lists array<int>").select("query", "query_id", "v", F.explode("lists").alias("list"))
    probed = cut(probed)
    asks = {r["list"]: r["count"] for r in probed.groupBy("list").count().collect()}  # a row per list
    parts = spark.createDataFrame([(i, -(-held.get(i, 0) // BLOCK_ROWS), -(-c // QUERY_ROWS)) for i, c in asks.items()], "list int, vb int, qb int").filter("vb > 0")
    parts = F.broadcast(parts)  # a row per list
    own_block = lambda key, blocks: F.pmod(F.xxhash64(key), F.col(blocks)).cast("int")
    all_blocks = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    left = dealt.join(parts, "list").select("list", own_block("row", "vb").alias("b"), all_blocks("qb").alias("c"), "row", "vec_id", "v")
    right = probed.join(parts, "list").select("list", all_blocks("vb").alias("b"), own_block("query", "qb").alias("c"), "query", "query_id", F.col("v").alias("q"))

    def best(vs: pa.Table, qs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, ...]] = []
        if vs.num_rows and qs.num_rows:
            turn = rotation(dim)
            ids = vs.column("vec_id").to_numpy()
            order = np.argsort(ids, kind="stable")
            ids, xo, qo = ids[order], _matrix(vs.column("v"), dim)[order], _matrix(qs.column("q"), dim)
            names = vs.column("row").to_numpy()[order] if inside else ids
            x = xo / np.linalg.norm(xo, axis=1, keepdims=True) @ turn
            q = qo / np.linalg.norm(qo, axis=1, keepdims=True) @ turn
            asking, asking_id = qs.column("query").to_numpy(), qs.column("query_id").to_numpy()
            for i, (own, key) in enumerate(zip(asking, asking_id, strict=True)):
                got, score = scan(q[i], x, qo[i], xo, ids, names == (own if inside else key), k, width, strict)
                out.append((np.full(len(got), own), np.full(len(got), key), ids[got], score))
        columns = [np.concatenate([o[j] for o in out]) if out else [] for j in range(4)]
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("query", "query_id", "vec_id", "score"), columns, [pa.int64()] * 3 + [pa.float64()], strict=True)})

    keys = ["list", "b", "c"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, "query long, query_id long, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)
