"""Token ids in a content-addressed store.

Format: a folder with three Parquet tables.
  kind=chunk   hash, data, n: every distinct chunk once; data: zstd of little-endian 16- or 32-bit ids
  recipe       doc_id, start, n_tokens, root, hashes, part: files in ascending doc_id order; start: ids of all documents before
  manifest     part, first_start, n_docs, n_tokens, root: the Merkle root over the document roots of each part, by start

A rolling hash over the last ids cuts the stream of a document where its low bits are zero, so that equal passages
give equal chunks. Chunks are named by SHA-256; a document's root is the Merkle root of its chunk names. Reading
checks chunk names and document roots, and rebuilds each distinct document once, however many copies there are.

Defined results: null text = empty text = the end id alone; repeated rows keep a recipe each, in the order of doc_id,
then root (null doc_id first); an empty table gives empty tables; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_path, small_batches, table
from .word_ids import word_ids

WINDOW, MEAN_BITS, LEAST, MOST = 4, 10, 256, 8192
_ODD = np.uint64(0x9E3779B97F4A7C15)


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * _ODD
    mixed ^= mixed >> np.uint64(29)
    rolled = np.zeros(n - WINDOW + 1, np.uint64)
    for j in range(WINDOW):  # a sum of the window's ids, each times a power of an odd number
        rolled *= _ODD
        rolled += mixed[j : n - WINDOW + 1 + j]
    at = np.flatnonzero(rolled >> np.uint64(64 - MEAN_BITS) == 0) + WINDOW
    ends, last = [], 0
    for e in at.tolist():
        while e - last > MOST:
            last += MOST
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    while n - last > MOST:
        last += MOST
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def fitting(ids: np.ndarray, wide: bool) -> np.ndarray:
    """The ids, if they have room in the store; else an error, as they would come back as others."""
    if not wide and len(ids) and int(ids.max()) > 65_535:
        raise ValueError("an id needs more than 16 bits: write the store with wide=True")
    return ids


def merkle(names: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last node goes up as it is."""
    level = names or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


_ROWS = "kind string, hash binary, data binary, n int, doc_id {kind}, n_tokens long, root binary, hashes array<binary>"


def write_store(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, wide: bool = False, key: str = "doc_id", text: str = "text") -> None:
    """Encode whole texts and write the store. wide: 32-bit ids on disk (vocabularies over 65,536)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    kind, width = rows.schema["k"].dataType.simpleString(), "<u4" if wide else "<u2"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pressed, reader = zstandard.ZstdCompressor(level=3), word_ids(tokenizer_file)
        seen: set[bytes] = set()
        names = ["kind", "hash", "data", "n", "doc_id", "n_tokens", "root", "hashes"]
        for batch in batches:
            key_type = batch.schema.field(0).type
            types = [pa.string(), pa.binary(), pa.binary(), pa.int32(), key_type, pa.int64(), pa.binary(), pa.list_(pa.binary())]
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo in range(0, len(keys), 250):
                out: list[tuple] = []
                for k, ids in zip(keys[lo : lo + 250], reader.encode(texts[lo : lo + 250], end_id), strict=True):
                    fitting(ids, wide)
                    own, last = [], 0
                    for e in cuts(ids):
                        raw = ids[last:e].astype(width).tobytes()
                        own.append(name := hashlib.sha256(raw).digest())
                        if name not in seen:  # pre-aggregation: a task sends a chunk once
                            if len(seen) < 200_000:
                                seen.add(name)
                            out.append(("chunk", name, pressed.compress(raw), e - last, None, None, None, None))
                        last = e
                    out.append(("recipe", None, None, None, k, len(ids), merkle(own), own))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:  # sorted by name: copies of a chunk are neighbours
            keep = []
            for name in batch.column(1).to_pylist():
                keep.append(name is None or name != last)
                last = name
            yield batch.filter(pa.array(keep, pa.bool_()))

    schema = _ROWS.format(kind=kind)
    spread = F.when(F.col("hash").isNotNull(), F.xxhash64("hash")).otherwise(F.xxhash64("root", "doc_id"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(encode, schema).repartition(parts, spread).sortWithinPartitions("kind", "hash")
    dealt.mapInArrow(once, schema).write.partitionBy("kind").option("compression", "none").parquet(f"{path}/rows")
    _order(spark, path, parts, kind)


def _rows(spark: SparkSession, path: str, kind: str, key: str = "long") -> DataFrame:
    schema = "hash binary, data binary, n int, kind string" if kind == "chunk" else f"doc_id {key}, n_tokens long, root binary, hashes array<binary>, kind string"
    return spark.read.schema(schema).parquet(f"{path}/rows").filter(F.col("kind") == kind)


def _order(spark: SparkSession, path: str, parts: int, key: str) -> None:
    """Recipes in ascending doc_id order with their starts, and the manifest."""
    recipes = _rows(spark, path, "recipe", key).select("doc_id", "n_tokens", "root", "hashes")
    ranged = cut(recipes.repartitionByRange(parts, "doc_id", "root").sortWithinPartitions("doc_id", "root").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = sums.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("base"))
    within = Window.partitionBy("part").orderBy("doc_id", "root")
    placed = ranged.join(F.broadcast(before), "part").withColumn(  # a row per shuffle partition
        "start", F.col("base") + F.sum("n_tokens").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    )
    ordered = placed.select("doc_id", "start", "n_tokens", "root", "hashes", "part").repartitionByRange(parts, "start").sortWithinPartitions("start")
    ordered.write.parquet(f"{path}/recipe")

    _manifest(spark.read.parquet(f"{path}/recipe")).write.parquet(f"{path}/manifest")


def _manifest(recipes: DataFrame) -> DataFrame:
    """A row per part of the recipes, which have to be without gaps or copies: part, first_start, n_docs, n_tokens, root."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, following, leaves = None, 0, 0, []
        out: list[tuple] = []
        for b in batches:
            for p, start, n, root in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if p != part:
                    if leaves:
                        out.append((part, first, len(leaves), following - first, merkle(leaves)))
                    part, first, following, leaves = p, start, start, []
                if start != following:
                    raise ValueError("a recipe is missing or repeated")
                following += n
                leaves.append(root)
        if leaves:
            out.append((part, first, len(leaves), following - first, merkle(leaves)))
        if out:
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["part", "first_start", "n_docs", "n_tokens", "root"])

    parts = int(recipes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = recipes.select("part", "start", "n_tokens", "root").repartition(parts, "part").sortWithinPartitions("part", "start")
    return dealt.mapInArrow(roots, "part int, first_start long, n_docs long, n_tokens long, root binary")


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes, once the manifest built from them is the stored one and its parts follow each other; else an error."""
    recipes = spark.read.parquet(f"{path}/recipe")
    columns = ["first_start", "n_docs", "n_tokens", "root"]
    stored = {r["part"]: tuple(r[c] for c in columns) for r in spark.read.parquet(f"{path}/manifest").collect()}  # a row per shuffle partition
    found = {r["part"]: tuple(r[c] for c in columns) for r in _manifest(recipes).collect()}
    if found != stored:
        raise ValueError(f"recipes differ from the manifest in parts {sorted(p for p in {*found, *stored} if found.get(p) != stored.get(p))[:10]}")
    following = 0
    for first, _, n, _ in sorted(stored.values()):
        if first != following:
            raise ValueError("parts of the manifest do not follow each other")
        following += n
    return recipes


def read_contents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """root, ids (little-endian 32-bit): every distinct document rebuilt from its chunks and verified."""
    small_batches(spark)
    recipes = spark.read.parquet(f"{path}/recipe")
    contents = recipes.groupBy("root").agg(F.any_value("hashes").alias("hashes"))
    wanted = contents.select("root", F.posexplode("hashes").alias("pos", "hash"))
    found = wanted.join(_rows(spark, path, "chunk").select("hash", "data"), "hash", "left")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    width = "<u4" if wide else "<u2"

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        opened = zstandard.ZstdDecompressor()
        root, names, data = None, [], []
        out: list[tuple[bytes, bytes]] = []

        def close() -> None:
            if root is not None:
                if merkle(names) != root:
                    raise ValueError("a document differs from its recipe")
                out.append((root, np.frombuffer(b"".join(data), width).astype("<u4").tobytes()))

        def send() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.binary()), pa.array([d for _, d in out], pa.binary())], ["root", "ids"])
            out.clear()
            return batch

        for b in batches:
            for r, h, d in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if r != root:
                    close()
                    root, names, data = r, [], []
                    if len(out) >= 200:
                        yield send()
                raw = opened.decompress(d) if d is not None else b""
                if hashlib.sha256(raw).digest() != h:
                    raise ValueError("a chunk is missing or differs from its name")
                names.append(h)
                data.append(raw)
        close()
        if out:
            yield send()

    ordered = found.repartition(parts, "root").sortWithinPartitions("root", "pos").select("root", "hash", "data")
    return ordered.mapInArrow(rebuild, "root binary, ids binary")


def read_documents(spark: SparkSession, path: str, wide: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document, from the files, verified by the manifest."""
    return verified_recipes(spark, path).select("doc_id", "start", "n_tokens", "root").join(read_contents(spark, path, wide), "root").drop("root")


def op7_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_path(spark, "store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    read = read_contents(spark, path).select("root", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
    return verified_recipes(spark, path).select("doc_id", "start", "root").join(read, "root").drop("root")
