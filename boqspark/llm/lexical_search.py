r"""Ranked lexical search: a pipeline of term owners through which item bundles carry sparse document accumulators.

 1. Index. Every task cuts its documents into shards of a bounded number of cells (documents x items) and writes, per
    shard, the postings of the terms that any item has, with the lengths of all documents. Document counts and total
    length come from the same rows.
 2. Owners. The terms are dealt to `stages` owners by rising document count, about as many postings to each.
 3. Pipeline. A bundle holds, for one shard, all items with the documents that they have met and their scores so far. It
    goes from owner to owner: each stage is a cogroup of the bundles with what the owner knows of the shard, which adds
    whole-number contributions. A document leaves a bundle only when its score and the most that later owners can add, by
    the shard's largest contribution of each term, stay under the k-th score that the shard has reached: it cannot be among
    the results, however the rest turns out.
 4. Selection. The last owner gives each shard's best k; a window over these gives the best of all.

Items are the query set: they are broadcast in blocks of bounded size (`BLOCK_PAIRS` item terms, `BLOCK_ITEMS` items),
each of which is searched in all documents. Documents of one shard were neighbours in the input, so a very common term
is spread as the documents are.

Defined results: null text has no terms; documents without any term count nowhere; each row is a document of its own, also
if its doc_id repeats; a null doc_id stands before all others; item rows with one item_id (null as well) are one item with
all their terms; items without terms have no rows; extra columns are dropped; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, table

BLOCK_PAIRS, BLOCK_ITEMS = 400_000, 8192
#: Documents x items of a shard, and documents of one at most.
CELLS, SHARD_DOCS = 4_000_000, 20_000
FIRST_ID = -(1 << 63)
#: Word bytes stay, A-Z in lower case; other ASCII separates.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = [sorted(set(terms_of(t))) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lists, pa.list_(pa.binary()))], ["item_id", "terms"])


def _shards(batches: Iterator[pa.RecordBatch], number: dict[bytes, int], shard_docs: int) -> Iterator[pa.RecordBatch]:
    """Rows in: key, text. Out: a row per shard with keys, lengths, and the postings by term, then document."""
    from pyspark import TaskContext

    first = TaskContext.get().partitionId() << 32
    keys: list[int] = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []
    held = made = 0
    n_terms = len(number)

    def row() -> pa.RecordBatch:
        code, tf = np.unique(np.concatenate(parts) if parts else np.empty(0, np.int64), return_counts=True)
        term, doc = code // shard_docs, code % shard_docs
        df = np.bincount(term, minlength=n_terms)
        n = np.array(lengths, np.int64)
        binary = [np.array(keys, np.int64), n, doc.astype(np.int32), df, tf.astype(np.int32)]
        columns = [pa.array([x], pa.int64()) for x in (first + made, int((n > 0).sum()), int(n.sum()))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([x.tobytes()], pa.binary()) for x in binary)], ["shard", "docs", "length", "keys", "n", "doc", "df", "tf"])

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            words = terms_of(text)
            term = np.fromiter((number.get(w, -1) for w in words), np.int64, len(words))
            term = term[term >= 0]
            parts.append(term * shard_docs + len(keys))
            held += len(term)
            keys.append(FIRST_ID if key is None else key)
            lengths.append(len(words))
            if len(keys) == shard_docs or held > CELLS:
                yield row()
                keys, lengths, parts, held, made = [], [], [], 0, made + 1
    if keys:
        yield row()


_INDEX = "shard long, docs long, length long, keys binary, n binary, doc binary, df binary, tf binary"


class Pipeline:
    """What the stages of one block know: the items' terms, the owner and weight of each term, totals."""

    def __init__(self, items: list[list[int]], df: np.ndarray, n_docs: int, length: int, stages: int, k: int):
        self.n_docs, self.length, self.stages, self.k, self.n_items = n_docs, length, stages, k, len(items)
        self.weight = np.array([weight(n_docs, int(x)) for x in df], np.int64)
        order = np.argsort(df, kind="stable")
        share = np.cumsum(df[order]) - df[order]
        self.owner = np.empty(len(df), np.int64)
        self.owner[order] = np.minimum(share * stages // max(1, int(df.sum())), stages - 1)
        self.item = np.repeat(np.arange(len(items)), [len(x) for x in items])
        self.term = np.array([t for x in items for t in x], np.int64)

    def postings(self, row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bounds of each term's postings in a shard, their documents and contributions."""
        df, doc, tf = (np.frombuffer(row[c], t) for c, t in (("df", np.int64), ("doc", np.int32), ("tf", np.int32)))
        m = 50 + 50 * np.frombuffer(row["n"], np.int64) * self.n_docs // max(1, self.length)
        tf = tf.astype(np.int64)
        part = np.repeat(self.weight, df) * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        return np.r_[0, np.cumsum(df)], doc, part

    def seeds(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An empty bundle per shard, with the most that the owners from each stage on can add to each item."""
        for b in batches:
            for row in b.to_pylist():
                edges, _, part = self.postings(row)
                most = np.maximum.reduceat(np.r_[part, 0], edges[:-1])
                most[np.diff(edges) == 0] = 0
                own = np.zeros((self.stages + 1, self.n_items), np.int64)
                np.add.at(own, (self.owner[self.term], self.item), most[self.term])
                rest = np.cumsum(own[::-1], axis=0)[::-1]
                empty = np.zeros(self.n_items + 1, np.int64).tobytes()
                columns = [pa.array([x], pa.binary()) for x in (empty, b"", b"", rest.tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]]), *columns], ["shard", "edges", "doc", "score", "rest"])

    def knowledge(self, stage: int):
        """What the owner of a stage knows of each shard."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for row in b.to_pylist():
                    edges, doc, part = self.postings(row)
                    sizes = np.where(self.owner == stage, np.diff(edges), 0)
                    mine = np.repeat(self.owner == stage, np.diff(edges))
                    columns = [pa.array([x.tobytes()], pa.binary()) for x in (sizes, doc[mine], part[mine])]
                    keys = row["keys"] if stage == self.stages - 1 else np.int64(len(row["keys"]) // 8).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([row["shard"]]), *columns, pa.array([keys], pa.binary())], ["shard", "sizes", "doc", "part", "keys"])

        return run

    def _scores(self, bundle: dict, known: dict, n: int) -> np.ndarray:
        """Items x documents: what the bundle brings and what this owner adds."""
        edges, doc = np.frombuffer(bundle["edges"], np.int64), np.frombuffer(bundle["doc"], np.int32)
        scores = np.zeros((self.n_items, n), np.int64)
        scores[np.repeat(np.arange(self.n_items), np.diff(edges)), doc] = np.frombuffer(bundle["score"], np.int64)
        at = np.r_[0, np.cumsum(np.frombuffer(known["sizes"], np.int64))]
        doc, part = np.frombuffer(known["doc"], np.int32), np.frombuffer(known["part"], np.int64)
        has = at[self.term + 1] > at[self.term]
        for i, t in zip(self.item[has].tolist(), self.term[has].tolist(), strict=True):
            scores[i, doc[at[t] : at[t + 1]]] += part[at[t] : at[t + 1]]  # a term has a document once
        return scores

    def step(self, stage: int):
        def run(bundles: pa.Table, knowledge: pa.Table) -> pa.Table:
            bundle, known = bundles.to_pylist()[0], knowledge.to_pylist()[0]
            n = int(np.frombuffer(known["keys"], np.int64)[0])
            rest = np.frombuffer(bundle["rest"], np.int64).reshape(self.stages + 1, self.n_items)[stage + 1]
            scores = self._scores(bundle, known, n)
            if n > self.k:
                bar = np.partition(scores, n - self.k, axis=1)[:, n - self.k]
                scores[scores + rest[:, None] < bar[:, None]] = 0
            item, doc = np.nonzero(scores)
            edges = np.searchsorted(item, np.arange(self.n_items + 1)).astype(np.int64)
            columns = [pa.array([x.tobytes()], pa.binary()) for x in (edges, doc.astype(np.int32), scores[item, doc])]
            return pa.table([pa.array([bundle["shard"]]), *columns, pa.array([bundle["rest"]], pa.binary())], ["shard", "edges", "doc", "score", "rest"])

        return run

    def last(self, bundles: pa.Table, knowledge: pa.Table) -> pa.Table:
        bundle, known = bundles.to_pylist()[0], knowledge.to_pylist()[0]
        keys = np.frombuffer(known["keys"], np.int64)
        scores = self._scores(bundle, known, len(keys))
        out = []
        for i, own in enumerate(scores):
            at = np.flatnonzero(own >= (max(1, np.partition(own, -self.k)[-self.k]) if len(own) > self.k else 1))
            at = at[np.lexsort((keys[at], -own[at]))[: self.k]]
            out.append((np.full(len(at), i), keys[at], own[at]))
        columns = [np.concatenate([o[j] for o in out]) for j in range(3)]
        return pa.table({"item": pa.array(columns[0], pa.int32()), "doc_id": pa.array(columns[1]), "score": pa.array(columns[2])})


def _block(docs: DataFrame, items: list[tuple], item_type: str, k: int, stages: int, shard_docs: int) -> DataFrame:
    """The search for one block of items: (item_id, terms)."""
    spark = docs.sparkSession
    number = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in items))))}
    names = spark.sparkContext.broadcast(number)
    shard_docs = max(1, min(shard_docs, CELLS // len(items)))
    path = fresh_path(spark, "postings")
    docs.mapInArrow(lambda it: _shards(it, names.value, shard_docs), _INDEX).write.parquet(path)
    index = spark.read.parquet(path)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(number), np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                total += np.frombuffer(x, np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "df"])

    df = np.zeros(len(number), np.int64)
    for r in index.select("df").mapInArrow(counts, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # terms of the block
        df[r["term"]] = r["df"]
    totals = index.agg(F.sum("docs").alias("docs"), F.sum("length").alias("length")).first()
    plan = Pipeline([[number[t] for t in terms] for _, terms in items], df, totals["docs"] or 0, totals["length"] or 0, stages, k)
    bundles = index.mapInArrow(plan.seeds, "shard long, edges binary, doc binary, score binary, rest binary")
    for stage in range(stages):
        known = index.mapInArrow(plan.knowledge(stage), "shard long, sizes binary, doc binary, part binary, keys binary")
        pairs = bundles.groupBy("shard").cogroup(known.groupBy("shard"))
        if stage < stages - 1:
            bundles = pairs.applyInArrow(plan.step(stage), bundles.schema)
    best = pairs.applyInArrow(lambda b, x: plan.last(b, x), "item int, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = F.broadcast(spark.createDataFrame([(i, key) for i, (key, _) in enumerate(items)], f"item int, item_id {item_type}"))  # a row per item of the block
    return best.join(named, "item").select("item_id", "rank", F.when(F.col("doc_id") != FIRST_ID, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 50, stages: int = 4, key: str = "doc_id", text: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    item_type = items.schema["item_id"].dataType.simpleString()
    terms = items.select("item_id", F.col("text").cast("string")).mapInArrow(_item_terms, f"item_id {item_type}, terms array<binary>")
    terms = terms.groupBy("item_id").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")).filter("size(terms) > 0")
    size = terms.agg(F.count("*").alias("items"), F.sum(F.size("terms")).alias("pairs")).first()
    blocks = max(-(-(size["pairs"] or 0) // BLOCK_PAIRS), -(-size["items"] // BLOCK_ITEMS))
    out = spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for block in range(blocks):
        own = terms.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect()  # a block of the query set
        if own:
            found = _block(rows, [(r["item_id"], [bytes(t) for t in r["terms"]]) for r in own], item_type, k, stages, shard_docs)
            out = found if blocks == 1 else out.unionByName(found)
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_TERMS = r"unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"
OP11_SQL = f"""
WITH words AS (SELECT doc_id, {_TERMS} FROM documents),
found AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM found GROUP BY doc_id),
totals AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sizes),
wanted AS (SELECT DISTINCT item_id, {_TERMS} FROM benchmark),
weights AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w
    FROM found SEMI JOIN wanted USING (term) CROSS JOIN totals GROUP BY term
),
scores AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length))))::BIGINT AS score
    FROM wanted JOIN weights USING (term) JOIN found USING (term) JOIN sizes USING (doc_id) CROSS JOIN totals
    GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
