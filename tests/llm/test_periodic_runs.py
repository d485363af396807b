"""Periodic runs against brute force: random sequences, the registered query on whole tables, and edge rows."""

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
from boqspark.llm import periodic_runs, registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


def brute(w):
    """(start, length, period) of all runs, by comparing all words that stand q apart for every q."""
    n, out = len(w), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(24, 3 * q) and not any(all(w[x] == w[x + r] for x in range(i, j + q - r)) for r in range(1, q)):
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def without(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repeated(r, w):
    for _ in range(r.randint(0, 3) if w else 0):
        a, p = r.randrange(len(w)), r.randint(1, 40)
        b = min(len(w), a + p * r.randint(1, 6))
        w[a:b] = [w[a + (i - a) % p] for i in range(a, b)]
    return w


def test_random_sequences():
    r = random.Random(3)
    for _ in range(300):
        docs = [repeated(r, [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(r.randint(0, 150))]) for _ in range(r.randint(1, 5))]
        begin = np.cumsum([0, *map(len, docs)])
        got = periodic_runs.runs_of(np.repeat(np.arange(len(docs)), list(map(len, docs))), np.array([x for d in docs for x in d], np.int64))
        assert [tuple(x) for x in got.tolist()] == [(s + begin[k], n, q) for k, d in enumerate(docs) for s, n, q in brute(d)]


def test_query_against_brute_force(spark):
    rows = registry.QUERIES["op13_periodic_runs"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    with_run = 0
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = brute(w)
        with_run += bool(runs)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=(None, None, None))
        milli = best[1] and 1000 * best[1] // best[2]
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)) and r.collapsed_sha256 == sha(without(w, runs))
    assert with_run > 10


def test_edges(spark):
    r = random.Random(8)
    long = repeated(r, [str(r.randrange(50)) for _ in range(3000)]) * 30
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a " * 23), (5, "a " * 24), (5, "a " * 24), (None, "b c " * 20), (7, " ".join(long)), (8, "é x " * 30), (9, "x " * 30 + "y " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(5), "period": F.lit("p"), "my col": F.lit(None).cast("int")})
    got = periodic_runs.with_runs(docs.repartition(3)).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() >= {"start", "period", "my col"}
    key = lambda k, runs, kept: (k is None, k or 0, tuple(tuple(x) for x in runs), kept)
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    want = collections.Counter()
    for k, t in rows:
        runs = brute(split(t)) if k != 7 else None
        if runs is not None:
            want[key(k, runs, without(split(t), runs))] += 1
    assert collections.Counter(key(x.doc_id, x._pr_runs, x._pr_collapsed) for x in got if x.doc_id != 7) == want
    assert (0, 90_000, 3000) in next(([tuple(y) for y in x._pr_runs] for x in got if x.doc_id == 7))
    assert periodic_runs.with_runs(docs.filter("false")).collect() == []
    planted = periodic_runs.with_runs(docs, rewrite=periodic_runs.planted)
    assert planted.filter("doc_id IS NULL").first()._pr_runs[0].period == 2


def test_ties_take_the_first_run(spark):
    docs = spark.createDataFrame([(1, "x " * 30 + "y " * 30)], "doc_id long, text string")
    best = periodic_runs.with_runs(docs).select(periodic_runs.strongest(F.col("_pr_runs")).alias("b")).first().b
    assert tuple(best) == (0, 30, 1)
