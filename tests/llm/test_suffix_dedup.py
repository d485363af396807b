"""Suffix-array dedup: the sort against sorted bytes, the query against brute force, edge rows, very frequent anchors."""

import hashlib
import random

import numpy as np
import pytest
from boqspark.llm import anchors, registry, suffix_dedup, suffix_sort
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def brute(rows, window=50):
    """Per row: bytes, removed, spans, bytes kept. rows: (doc_id, text)."""
    rows = [(-1e30 if k is None else k, (t or "").encode()) for k, t in rows]
    first = {}
    for k, b in rows:
        for i in range(len(b) - window + 1):
            w = b[i : i + window]
            if k < first.get(w, 1e30):
                first[w] = k
    out = []
    for k, b in rows:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < k:
                gone[1 + i : 1 + i + window] = True
        kept = bytes(c for c, g in zip(b, gone[1:-1].tolist(), strict=True) if not g)
        out.append((len(b), int(gone.sum()), int((np.diff(gone.astype(int)) == 1).sum()), kept))
    return out


def test_sort_equals_sorted_bytes():
    r = random.Random(1)
    for bits in (64, 64, 6):  # 6-bit hashes collide all the time: the check sees it
        text = bytes(r.choice(b"ab") for _ in range(700))
        at = np.array([r.randrange(650) for _ in range(500)])
        key = np.array([r.randrange(3) for _ in at])
        order, new = suffix_sort.grouped(text, at, np.full(len(at), 20), [key], bits)
        want = sorted(range(len(at)), key=lambda i: (key[i], text[at[i] : at[i] + 20], i))
        assert order.tolist() == want
        said = [(key[i], text[at[i] : at[i] + 20]) for i in want]
        assert new.tolist() == [i == 0 or said[i] != said[i - 1] for i in range(len(said))]
    own = suffix_sort.HashedText(b"abcabcabd")
    assert own.common(np.array([0, 0, 3]), np.array([3, 1, 6]), np.array([6, 5, 2])).tolist() == [5, 0, 2]
    with pytest.raises(suffix_sort.Collision):
        suffix_sort._checked(own, np.array([1, 0]), np.array([2, 2]), np.array([1]))


def test_anchors_of_equal_windows_are_equal():
    r = random.Random(2)
    windows = anchors.ByteWindows(50, 24)
    a = bytes(r.choice(b"abc") for _ in range(400))
    b = bytes(r.choice(b"abc") for _ in range(77)) + a[100:200] + b"x" * 90
    (pa, va), (pb, vb) = windows.anchors(a), windows.anchors(b)
    assert va[100:151].tolist() == vb[77:128].tolist()
    assert ((pa >= np.arange(len(pa))) & (pa <= np.arange(len(pa)) + 26)).all() and len(vb) == len(b) - 49 and len(pb) == len(vb)


def test_query_against_brute_force(spark):
    rows = registry.QUERIES["op12_suffix_dedup"](spark, SF).collect()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    got = {r.doc_id: r for r in rows}
    removed = 0
    for (k, _), (n, gone, spans, kept) in zip(texts, brute(texts), strict=True):
        removed += gone
        assert tuple(got[k])[1:] == (n, gone, spans, hashlib.sha256(kept).hexdigest())
    assert removed > 1000


def some_rows():
    r = random.Random(6)
    text = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    base, passage = text(700), text(49) + "日本"
    near = base[:300] + "#" + base[301:]
    rows = [(1, base), (2, base), (3, near), (4, text(90) + passage + text(40)), (5, text(30) + passage), (6, None), (7, ""), (8, "short"), (9, "short")]
    rows += [(10, "same line\n" * 40), (11, "same line\n" * 7), (12, text(20_000)), (13, base[200:260] + text(9) + base[230:300]), (13, base), (13, base), (14, base[:49]), (15, base[:50])]
    rows += [(None, base[400:480]), (-5, passage[:60] + "x"), (16, near + near), (17, "é" * 60), (18, "x" + "é" * 60)]
    return rows


def check(spark, rows, docs):
    got = suffix_dedup.without_repeats(docs).collect()
    key = lambda k, t, *rest: (str(k), t or "", *rest)
    want = sorted(key(k, t, *w) for (k, t), w in zip(rows, brute(rows), strict=True))
    assert sorted(key(x.doc_id, x.text, x._sb_bytes, x._sb_removed, x._sb_spans, bytes(x._sb_kept)) for x in got) == want


def test_edges(spark):
    rows = some_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"ord": F.lit(1), "t1": F.lit("x"), "spans": F.lit(None).cast("int"), "whole": F.lit(True)})
    check(spark, rows, docs.repartition(5))
    check(spark, rows, docs.coalesce(1))
    assert suffix_dedup.without_repeats(docs.filter("false")).collect() == []


def test_very_frequent_anchors(spark, monkeypatch):
    monkeypatch.setattr(anchors, "HOT_TEXTS", 2)
    monkeypatch.setattr(anchors, "RUN_TEXTS", 1)
    monkeypatch.setattr(anchors, "FOLD", 10)
    monkeypatch.setattr(anchors, "RUN", 2000)
    rows = some_rows()
    d = anchors.prepared(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "doc_id", "text")
    hot, n = anchors.hot_values(d, anchors.ByteWindows(50, 24), len(rows))
    assert len(hot) > 10 and n > 1000
    monkeypatch.setattr(anchors, "BUCKET", 500)
    monkeypatch.setattr(anchors, "FEW_TEXTS", 1)
    monkeypatch.setattr(anchors, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(anchors, "BROADCAST_SPANS", 0)
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
