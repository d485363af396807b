"""Ranked lexical search against brute force: the registered query on whole tables, its SQL form, and edge rows."""

import collections
import math
import random
import re

import duckdb
from boqspark.llm import lexical_search, registry
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return PATTERN.findall((text or "").encode().lower().decode())


def brute(docs, items, k=50):
    """docs: (doc_id, text) rows; items: item_id -> set of terms. Rows (item_id, rank, doc_id, score)."""
    counted = [(d, collections.Counter(terms(t))) for d, t in docs]
    n_docs, length = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, own in items.items():
        scores = []
        for d, c in counted:
            m = 50 + (50 * sum(c.values()) * n_docs) // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s:
                scores.append((-s, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def as_rows(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def test_query_against_brute_force_and_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    docs = con.sql("SELECT doc_id, text FROM documents").fetchall()
    items = {i: set(terms(t)) for i, t in con.sql("SELECT item_id, text FROM benchmark").fetchall()}
    got = as_rows(registry.QUERIES["op11_lexical_search"](spark, SF))
    assert got == brute(docs, items) and len(got) > 500
    assert sorted(con.sql(f"SELECT item_id, rank, doc_id, score FROM ({lexical_search.OP11_SQL})").fetchall(), key=repr) == got


def test_small_shards_stages_and_blocks(spark, monkeypatch):
    """Documents leave bundles early, items come in several blocks: the results stay."""
    r = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(vocabulary[min(59, int(r.expovariate(0.12)))] for _ in range(n))
    docs = [(i, text(r.randint(0, 40))) for i in range(400)]
    items = [(i, text(6)) for i in range(30)]
    want = brute(docs, {i: set(terms(t)) for i, t in items}, 5)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for stages, shard, parts in ((1, 1000, 1), (3, 50, 2), (6, 7, 5)):
        assert as_rows(lexical_search.search(d.repartition(parts), q, 5, stages, shard_docs=shard)) == want
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", 11)
    assert as_rows(lexical_search.search(d, q, 5)) == want


def test_documents_leave_bundles():
    """The bar of a shard: what cannot reach the k-th score any more goes, nothing else does."""
    import numpy as np
    import pyarrow as pa

    plan = lexical_search.Pipeline([[0, 1]], np.array([2, 5]), 9, 90, 2, 1)
    assert plan.owner.tolist() == [0, 1] or plan.owner.tolist() == [0, 0]
    plan.owner = np.array([0, 1])
    rest = np.array([[90], [10], [0]], np.int64)
    bundle = pa.table({"shard": [1], "edges": [np.zeros(2, np.int64).tobytes()], "doc": [b""], "score": [b""], "rest": [rest.tobytes()]})
    known = pa.table({"shard": [1], "sizes": [np.array([3, 0]).tobytes()], "doc": [np.array([0, 1, 2], np.int32).tobytes()], "part": [np.array([50, 40, 39]).tobytes()], "keys": [np.int64(4).tobytes()]})
    out = plan.step(0)(bundle, known).to_pylist()[0]
    assert np.frombuffer(out["doc"], np.int32).tolist() == [0, 1] and np.frombuffer(out["score"], np.int64).tolist() == [50, 40]


def test_edges(spark):
    docs = [(1, None), (2, ""), (3, " ...;"), (4, "Alpha BETA"), (4, "alpha"), (4, "alpha"), (None, "alpha"), (5, "ÉTÉ été \x00x"), (6, "alpha_beta alpha"), (7, "gamma " * 50_000 + "beta")]
    items = [(1, "alpha beta"), (2, None), (3, "!!"), (1, "Gamma"), (None, "Été x"), (9, "unknown")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "score": F.lit(None).cast("int")})
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("x"))
    merged = {1: {"alpha", "beta", "gamma"}, None: set(terms("Été x")), 9: {"unknown"}}
    assert as_rows(lexical_search.search(d.repartition(3), q)) == brute(docs, merged)
    assert lexical_search.search(d.filter("false"), q).collect() == [] and lexical_search.search(d, q.filter("false")).collect() == []
