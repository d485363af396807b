r"""Log-bilinear language model trained with noise-contrastive estimation, and a smoothed unigram base.

Every word of the corpus is in the vocabulary: log P(w|h1,h2) = log P(class of w|h1,h2) + log P(w|its class).
 1. Counts of all training tokens (a Counter per task, summed by Spark).
 2. Classes: the `OWN_WORDS` most frequent words and the end are classes of their own; the others are classed by their
    last three letters where these are among the `ENDINGS[0]` most frequent such endings, else by two letters, else
    together. Counts of the classes come from the counts of all words, each with a share for words not seen.
 3. Training in `ROUNDS`: in each, another part of the documents is dealt to replicas that start from the same
    parameters and run noise-contrastive estimation in numpy over all their tokens; Spark averages parameters and step
    sizes. A replica has `REPLICA_TOKENS` tokens or more, so that few documents are not spread over many short runs:
    the number of replicas follows from the tokens, not from the partitions.
 4. Scores: with contexts of two tokens, exp(s(c|h1,h2)) is a product of a term of h1 and one of h2, so one matrix
    product gives the normaliser of every context: log P is then a sum of table look-ups.
Counts of the `HEAD` most frequent words travel to the tasks (a bounded table); the others are joined by word.

Defined results: null text = empty text = the end token alone; tokens are A-Z lower-cased words
`[^\x20\x09-\x0D]+` and one end; a null doc_id is hashed as the empty text; repeated rows are scored one by one;
without training tokens every token has base probability 1 and a uniform model; extra columns are dropped.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, small_batches, table

OWN_WORDS, ENDINGS, HEAD, DIM, NOISE, BATCH, RATE = 1022, (700, 300), 131_072, 24, 32, 512, 0.8
ROUNDS, REPLICAS, REPLICA_TOKENS, SLICES = 3, 8192, 1_000_000, 64
END = b" "  # no word can be this


def tokens(text: str | None) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    words.append(END)
    return words


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def count_tokens(docs: DataFrame) -> DataFrame:
    """word (binary), c: counts over the training documents. docs: k, t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not held_out(k):
                    counts.update(tokens(t))
            if len(counts) > 400_000:
                yield from send(counts)
        yield from send(counts)

    def send(counts: Counter) -> Iterator[pa.RecordBatch]:
        words, numbers = list(counts), list(counts.values())
        counts.clear()
        for lo in range(0, len(words), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[lo : lo + 20_000], pa.binary()), pa.array(numbers[lo : lo + 20_000], pa.int64())], ["word", "c"])

    return docs.mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int = HEAD) -> dict[bytes, int]:
    """The most frequent tokens, `most` at most, by falling count: those over a bound read from a histogram of log counts."""
    level = F.floor(F.log2("c") * 16)
    left, bound = most, None
    for row in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundred levels
        if row["count"] > left:
            break
        left, bound = left - row["count"], row["level"]
    if bound is None:
        return {}
    top = counts.filter(level >= bound).toPandas()
    pairs = zip(map(bytes, top["word"]), map(int, top["c"]), strict=True)
    return dict(sorted(pairs, key=lambda x: (-x[1], x[0])))


class Classes(dict):
    """word -> number of its class: own words first, then endings, then the rest (`rest`), last the end (`end`). Keeps the first words it is asked for."""

    def __init__(self, own: list[bytes], three: list[bytes], two: list[bytes]):
        super().__init__({w: i for i, w in enumerate(own)})
        self.n_own, self.rest = len(own), len(own) + len(three) + len(two)
        self.end = self.rest + 1
        self[END] = self.end
        self.three = {e: len(own) + i for i, e in enumerate(three)}
        self.two = {e: len(own) + len(three) + i for i, e in enumerate(two)}

    def __missing__(self, word: bytes) -> int:
        found = self.three.get(word[-3:])
        if found is None:
            found = self.two.get(word[-2:], self.rest)
        if len(self) < 400_000:
            self[word] = found
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def endings(counts: DataFrame, own: dict[bytes, int]) -> tuple[list[bytes], list[bytes]]:
    """The most frequent last three letters of words that are not own ones, and last two letters of words that neither covers."""

    def best(rows: DataFrame, n: int, size: int, minus: dict[bytes, int]) -> list[bytes]:
        top = rows.groupBy(F.substring("word", -size, size).alias("e")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(n + len(minus)).collect()
        left = sorted(((-(r["c"] - minus.get(bytes(r["e"]), 0)), bytes(r["e"])) for r in top))
        return [e for c, e in left if c < 0][:n]

    minus: Counter = Counter()
    for w, c in own.items():
        minus[w[-3:]] += c
    three = best(counts, ENDINGS[0], 3, minus)
    known = set(three)
    minus = Counter()
    for w, c in own.items():
        if w[-3:] not in known:
            minus[w[-2:]] += c
    others = counts.filter(~F.substring("word", -3, 3).isin(*[F.lit(e) for e in three])) if three else counts
    return three, best(others, ENDINGS[1], 2, minus)


def class_counts(counts: DataFrame, own: list[bytes], three: list[bytes], two: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = Classes(own, three, two)
        n, v = np.zeros(kinds.end + 1, np.int64), np.zeros(kinds.end + 1, np.int64)
        for b in batches:
            at = kinds.of(b.column(0).to_pylist())
            np.add.at(n, at, b.column(1).to_numpy())
            np.add.at(v, at, 1)
        some = np.flatnonzero(v)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array(v[some])], ["k", "n", "v"])

    size = len(own) + len(three) + len(two) + 2
    n, v = np.zeros(size), np.zeros(size)
    for r in counts.select("word", "c").mapInArrow(run, "k long, n long, v long").groupBy("k").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():  # a row per class
        n[r["k"]], v[r["k"]] = r["n"], r["v"]
    return n, v


class LogBilinear:
    """Scores of classes by the two tokens before. W: a row of weights and the bias of each class; R: contexts; C: both context maps."""

    NAMES = ("W", "R", "C", "gW", "gR", "gC")

    def __init__(self, noise: np.ndarray, seed: int = 3):
        v, rng = len(noise), np.random.default_rng(seed)
        self.noise = noise / noise.sum()
        self.log_noise = np.log(self.noise).astype(np.float32)
        self.W = np.concatenate([rng.normal(0, 0.1, (v, DIM)), np.log(self.noise)[:, None]], axis=1).astype(np.float32)
        self.R = rng.normal(0, 0.1, (v, DIM)).astype(np.float32)
        self.C = np.concatenate([np.eye(DIM), 0.5 * np.eye(DIM)]).astype(np.float32)
        self.gW, self.gR, self.gC = (np.full_like(x, 0.1) for x in (self.W, self.R, self.C))
        self.rng = np.random.default_rng(seed + 1)
        self.cumulative = np.cumsum(self.noise)

    @staticmethod
    def _add(p: np.ndarray, grown: np.ndarray, at: np.ndarray, rows: np.ndarray, rate: float) -> None:
        """Adagrad, uphill, on the rows `at` of p; gradients of equal rows are added up first."""
        order = np.argsort(at, kind="stable")
        own = at[order]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        grad, i = np.add.reduceat(rows[order], first, axis=0), own[first]
        total = grown[i] + grad * grad
        grown[i] = total
        p[i] += rate * grad / np.sqrt(total)

    def train(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray, rate: float = RATE) -> None:
        """One step of noise-contrastive estimation; the noise classes are shared by the batch."""
        n = len(w)
        x = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), len(self.noise) - 1)
        r = np.concatenate([self.R[h1], self.R[h2]], axis=1)
        p = np.ones((n, DIM + 1), np.float32)
        np.matmul(r, self.C, out=p[:, :DIM])
        away = np.float32(np.log(NOISE)) + self.log_noise
        own, other = self.W[w], self.W[x]
        data = 1 / (1 + np.exp(np.clip(np.einsum("ij,ij->i", p, own) - away[w], -30, 30)))
        wrong = -1 / (1 + np.exp(np.clip(away[x] - p @ other.T, -30, 30)))
        dp = (data[:, None] * own[:, :DIM] + wrong @ other[:, :DIM]) / n
        rows = np.concatenate([data[:, None] * p, wrong.T @ p]) / n
        dr = dp @ self.C.T
        self._add(self.W, self.gW, np.concatenate([w, x]), rows, rate)
        self._add(self.R, self.gR, np.concatenate([h1, h2]), np.concatenate([dr[:, :DIM], dr[:, DIM:]]), rate)
        dc = r.T @ dp
        self.gC += dc * dc
        self.C += rate * dc / np.sqrt(self.gC)

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in self.NAMES])

    def load(self, flat: np.ndarray) -> "LogBilinear":
        at = 0
        for n in self.NAMES:
            p = getattr(self, n)
            setattr(self, n, flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """s1[h1, c], s2[h2, c] and log z[h1, h2]: log P(c|h1,h2) = s1 + s2 - log z."""
        q, b = self.W[:, :DIM], self.W[:, DIM]
        s1, s2 = self.R @ self.C[:DIM] @ q.T + b, self.R @ self.C[DIM:] @ q.T
        m1, m2 = s1.max(axis=1, keepdims=True), s2.max(axis=1, keepdims=True)
        z = np.exp(s1 - m1) @ np.exp(s2 - m2).T
        return s1, s2, np.log(np.maximum(z, np.finfo(np.float32).tiny)) + m1 + m2.T


def numbers(words: list[bytes], place: dict[bytes, int], other: int) -> np.ndarray:
    get = place.get
    return np.fromiter((get(x, other) for x in words), np.int64, len(words))


def contexts(ids: np.ndarray, ends: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens one and two before, of texts laid end to end; start stands before each text."""
    h1 = np.concatenate([[start], ids[:-1]]) if len(ids) else ids
    h2 = np.concatenate([[start, start], ids[:-2]])[: len(ids)]
    firsts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    h1[firsts] = start
    h2[firsts] = start
    seconds = firsts + 1
    seconds = seconds[seconds < ends]
    h2[seconds] = start
    return h1, h2


def train_round(docs: DataFrame, vocabulary: tuple[list[bytes], ...], noise: np.ndarray, model: LogBilinear, replicas: int) -> LogBilinear:
    """The average of the replicas, weighted by tokens, after each has gone through its documents once."""
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, noise, model.flat()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, rates, start = shared.value
        kinds, own, seen = Classes(*words), LogBilinear(rates).load(start), 0
        for b in batches:
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(keys), 200):
                parts = [kinds.of(tokens(t)) for k, t in zip(keys[lo : lo + 200], texts[lo : lo + 200], strict=True) if not held_out(k)]
                if not parts:
                    continue
                ids = np.concatenate(parts)
                h1, h2 = contexts(ids, np.cumsum([len(p) for p in parts]), kinds.end)
                mix = own.rng.permutation(len(ids))
                for at in range(0, len(ids), BATCH):
                    m = mix[at : at + BATCH]
                    own.train(ids[m], h1[m], h2[m])
                seen += len(ids)
        if seen:
            slices = np.array_split(own.flat(), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([x.tobytes() for x in slices], pa.binary()), pa.array([seen] * SLICES, pa.int64())], ["i", "v", "n"])

    def average(group: pa.Table) -> pa.Table:
        total, n = 0.0, 0
        for v, seen in zip(group.column("v").to_pylist(), group.column("n").to_pylist(), strict=True):
            total, n = total + np.frombuffer(v, np.float32).astype(np.float64) * seen, n + seen
        return pa.table({"i": group.column("i")[:1], "v": pa.array([(total / n).tobytes()], pa.binary())})

    rows = docs.coalesce(replicas).mapInArrow(run, "i int, v binary, n long").groupBy("i").applyInArrow(average, "i int, v binary").collect()  # SLICES rows
    if not rows:
        return model
    return model.load(np.concatenate([np.frombuffer(r["v"], np.float64) for r in sorted(rows, key=lambda r: r["i"])]))


def train_model(docs: DataFrame, vocabulary: tuple[list[bytes], ...], noise: np.ndarray, n_tokens: int) -> LogBilinear:
    """Rounds over all training documents, each document in one of them. docs: k, t."""
    model = LogBilinear(noise)
    replicas = min(REPLICAS, max(1, n_tokens // ROUNDS // REPLICA_TOKENS))
    for i in range(ROUNDS):
        own = F.pmod(F.xxhash64(F.lit(17), F.col("k").cast("string")), F.lit(ROUNDS)) == i
        model = train_round(docs.filter(own), vocabulary, noise, model, replicas)
    return model


def score_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    path = fresh_path(spark, "lm")
    count_tokens(rows).write.parquet(f"{path}/counts")
    counts = spark.read.parquet(f"{path}/counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent(counts)
    own = [w for w in head if w != END][:OWN_WORDS]
    vocabulary = (own, *endings(counts.filter(F.col("word") != F.lit(END)), {w: head[w] for w in own}))
    n_class, v_class = class_counts(counts, *vocabulary)
    model = train_model(rows, vocabulary, n_class + 0.5, int(n))
    # a word of a class of several: its count and a half of those of the class, which has one share for all words not seen
    log_class = np.log10(n_class + 0.5 * (v_class + 1))
    log_class[: len(own)] = 0
    log_class[-1] = 0 if END in head else np.log10(0.5)  # what an end that is not in the head gets from the counts below
    shared = spark.sparkContext.broadcast((vocabulary, head, log_class, model.tables()))
    kind = rows.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, log_class, (s1, s2, log_z) = shared.value
        kinds = Classes(*words)
        place = {w: i for i, w in enumerate(c)}
        logs = np.log10(np.array([*c.values(), 0], np.float64) + 0.5)
        number = np.append(kinds.of(list(c)), 0)
        row = TaskContext.get().partitionId() << 33
        names = ["k", "row", "n_tokens", "n_known", "base", "score", "tail"]
        several = np.ones(kinds.end + 1, bool)  # classes of several words
        several[: kinds.n_own] = False
        several[-1] = False
        for b in batches:
            keys, texts = b.column(0), b.column(1).to_pylist()
            for lo in range(0, len(texts), 200):
                lists = [tokens(t) for t in texts[lo : lo + 200]]
                sizes = np.array([len(x) for x in lists])
                ends = np.cumsum(sizes)
                flat = [w for x in lists for w in x]
                at = numbers(flat, place, len(c))
                ids = number[at]
                in_head = at < len(c)
                tail_at = np.flatnonzero(~in_head)
                ids[tail_at] = kinds.of([flat[i] for i in tail_at])
                h1, h2 = contexts(ids, ends, kinds.end)
                lp = (s1[h1, ids].astype(np.float64) + s2[h2, ids] - log_z[h1, h2]) / np.log(10) - log_class[ids]
                base = np.where(in_head, logs[at], 0.0)
                firsts = ends - sizes
                add = lambda x: np.add.reduceat(x, firsts)
                tails = pa.array([flat[i] for i in tail_at], pa.binary())
                offsets = np.concatenate([[0], add((~in_head).astype(np.int64)).cumsum()]).astype(np.int32)
                m = len(lists)
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(lo, m), pa.array(np.arange(row, row + m)), pa.array(sizes.astype(np.int64)), pa.array(add(in_head.astype(np.int64))),
                        pa.array(add(base)), pa.array(add(lp + np.where(in_head & several[ids], logs[at], 0.0))),
                        pa.ListArray.from_arrays(pa.array(offsets), tails),
                    ], names)
                row += m

    schema = f"k {kind}, row long, n_tokens long, n_known long, base double, score double, tail array<binary>"
    rows.mapInArrow(run, schema).write.parquet(f"{path}/scored")
    scored = spark.read.parquet(f"{path}/scored")
    tail = scored.select("row", F.explode("tail").alias("word")).join(counts, "word", "left")
    tail = tail.groupBy("row").agg(F.count("c").alias("tail_known"), F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("tail_log"))
    whole = scored.drop("tail").join(tail, "row", "left").na.fill({"tail_known": 0, "tail_log": 0.0})
    total = float(np.log10(n + 0.5 * (v + 1)))
    return whole.select(
        F.col("k").alias(key),
        (F.pmod(F.crc32(F.coalesce(F.col("k").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.col("tail_known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("tail_log") - F.col("n_tokens") * F.lit(total)).alias("base_score"),
        (F.col("score") + F.col("tail_log")).alias("score"),
    )


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))
