"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from boqspark.llm import (
    anchors,
    chat_format,
    chunk_store,
    fm_index,
    jaccard_join,
    language_model,
    packing,
    quality_rules,
    sp_codec,
    substring_dedup,
    url_filter,
    vector_search,
)
from boqspark.llm.common import fresh_path

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(5)
WORDS = ["".join(random.choice("abcdeé") for _ in range(random.randint(1, 6))) for _ in range(300)]


def some_words(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def texts():
    base = some_words(400, 1)
    near = list(base)
    near[100] = "changed"
    passage = some_words(60, 2)
    return {
        1: " ".join(base),
        2: " ".join(base),
        3: " ".join(near),
        4: " ".join(some_words(90, 3) + passage + some_words(40, 4)),
        5: " ".join(some_words(20, 5) + passage + some_words(80, 6)),
        6: None,
        7: "",
        8: " \n\t ",
        9: "Short Text",
        10: "short\ttext",
        11: "same line\n" * 40,
        12: "a " * 300,
        13: " ".join(some_words(20_000, 7)),
        14: "日本語 " * 30 + "😀",
        15: "one two three four five",
        16: "ONE two three four five",
        17: " ".join(base[:390] + passage[:30]),
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in texts().items()]
    rows += [(9, "Short Text", "en", "s", 10), (None, " ".join(some_words(30, 9)), "en", "s", 0)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def clash(df):
    """Extra columns with names that the operators use."""
    names = "ids k t w n s p ord t1 t2 a1 a2 l1 whole spans rule kept words start hash root row value band".split()
    return df.withColumns({c: F.lit(1) for c in names})


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- 1 ---


def test_sentencepiece(spark, docs, none):
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=file)
    rows = sp_codec.encode_decode(clash(docs), file).collect()
    assert len(rows) == docs.count()
    known = texts()
    for r in rows:
        if r.doc_id is not None:
            want = sp.encode(known[r.doc_id] or "") + [2]
            assert r.ids == want and r.decoded == sp.decode(want)
    assert sp_codec.encode_decode(none, file).count() == 0


def test_sentencepiece_random_texts():
    import sentencepiece

    file = public_tokenizers.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=file), sp_codec.encoder(file)
    r = random.Random(2)
    for _ in range(1500):
        t = "".join(r.choice(" \n▁abcdethinér-.,!1日😀\t") for _ in range(r.randint(0, 50)))
        assert own.encode(t).tolist() == sp.encode(t) + [2]
        assert own.decode(own.encode(t).tolist()) == sp.decode(sp.encode(t))


# --- 2 ---


def test_chats(spark):
    rows = [
        (1, 0, "user", "### x"), (1, 1, "assistant", "\n</turn>\n### user: no"), (2, 0, None, None), (2, 0, "a:b\\#", "x\\"), (2, 1, "assistant", "\\\\</turn>\\###"),
        (3, None, "assistant", ""), (3, 1, "assistant", "é😀"), (3, 1, "assistant", "é😀"), (None, 1, "user", "</turn>"), (-7, 0, "user", r"\### Assistant: </turn> ok"), (4, 0, "assistant", "x" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1)).repartition(3)
    out = chat_format.format_chats(df).withColumn("read", chat_format.parse_chat(F.col("formatted"))).withColumn("loss", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.conv_id: r for r in out.collect()}
    assert all(r.round_trip for r in got.values())
    for conv, own in itertools.groupby(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")), key=lambda r: r[0]):
        own = list(own)
        assert [(t.role, t.text) for t in got[conv].read] == [(r[2] or "", r[3] or "") for r in own]
        assert got[conv].loss == "".join(r[3] or "" for r in own if r[2] == "assistant")
        for s in got[conv].loss_spans:
            assert chat_format is not None and 0 <= s.start <= len(got[conv].formatted) and got[conv].formatted[s.start + s.length :].startswith(chat_format.CLOSE)
    assert chat_format.format_chats(df.filter("false")).count() == 0


def test_chat_runs_of_hashes(spark):
    texts = [f"{lead}{slashes}{'#' * n}{tail}" for lead in ("", "a\n", "#") for slashes in ("", "\\", "\\\\", "\\\\\\") for n in range(1, 10) for tail in ("", " Steps", "\\####", "</turn>")]
    rows = [(i, 0, "assistant", t) for i, t in enumerate(texts)]
    out = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = out.select("conv_id", "round_trip", chat_format.parse_chat(F.col("formatted")).alias("read"), chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for i in range(len(texts)) for t in got[i].read] == [("assistant", t) for t in texts]
    assert [got[i].loss for i in range(len(texts))] == texts and all(r.round_trip for r in got.values())


def test_chat_text_that_is_not_read_back_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(chat_format, "escape", lambda text: text)
    df = spark.createDataFrame([(1, 0, "user", "#### Steps")], "conv_id long, turn long, role string, text string")
    with pytest.raises(Exception, match="not read back"):
        chat_format.format_chats(df).collect()


# --- 3 ---


def base_counts(text):
    w = words_of(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    many = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if many[g] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality_rules.judge(clash(docs), labels).collect()
    known = texts()
    assert len(out) == docs.count()
    for r in out:
        if r.doc_id is not None:
            want = base_counts(known[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and r.kept == (not r.base_failed)
    assert quality_rules.judge(none, labels).count() == 0


def test_quality_learns_a_threshold(spark):
    rows, labels = [], []
    for i in range(240):
        junk = i % 4 == 0
        rows.append((i, " ".join(w + ("###" if junk else "") for w in some_words(60, i)), "en", "s", 0))
        labels.append((i, 0 if junk else 1, 0))
    labels += [(0, None, None), (None, 0, 0)]
    out = quality_rules.judge(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = {r.doc_id for r in out.filter("kept").collect()}
    assert kept == {i for i in range(240) if i % 4}


# --- 4 ---


def test_language_model(spark, docs, none):
    out = language_model.score_texts(clash(docs)).collect()
    known, counts = texts() | {None: " ".join(some_words(30, 9))}, collections.Counter()
    rows = [*known.items(), (9, known[9])]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    tokens = lambda t: [*(t or "").encode().lower().split(), b" "]
    for k, t in rows:
        if not held(k):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert len(out) == len(rows)
    for r in out:
        own = tokens(known[r.doc_id])
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert r.n_tokens == len(own) and r.n_known == sum(counts[w] > 0 for w in own) and r.train_tokens == n and r.held_out == held(r.doc_id)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score <= 0
    assert language_model.score_texts(none).count() == 0


def test_model_probabilities_sum_to_one():
    m = language_model.LogBilinear(np.array([5.0, 3, 2, 1]))
    rng = np.random.default_rng(0)
    for _ in range(50):
        w = rng.integers(0, 4, 64)
        m.train(w, (w + 1) % 4, w)
    s1, s2, z = m.tables()
    p = np.exp(s1[:, None, :] + s2[None, :, :] - z[:, :, None])
    assert np.allclose(p.sum(axis=2), 1, atol=1e-5)


def test_words_of_a_class_share_its_probability():
    """Own words are classes of their own; the others go by three letters, by two, or together."""
    kinds = language_model.Classes([b"the", b"of"], [b"ing"], [b"ed"])
    assert kinds.of([b"the", b"of", b"going", b"ing", b"used", b"x", b"", language_model.END]).tolist() == [0, 1, 2, 2, 3, 4, 4, 5]
    assert (kinds.rest, kinds.end) == (4, 5)


@pytest.mark.parametrize("parts", [1, 4, 64])
def test_model_beats_the_base_on_held_out_documents(spark, parts):
    """Whatever the number of partitions. Figures at sf0.01: base -4.129, model between -3.81 and -3.85."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").repartition(parts)
    r = language_model.score_texts(docs).filter("held_out").agg(F.sum("base_score").alias("base"), F.sum("score").alias("score"), F.sum("n_tokens").alias("n")).first()
    assert 0.25 < (r.score - r.base) / r.n < 0.4


# --- 5 ---


def test_urls(spark):
    urls = ["http://A.Example.ORG/en/12", "http://x.com/fr/", "http://spam.net/a.html#f", "https://www.spam.net:80/a/", None, "", "no scheme", "x://", "http://com/de/1?a#b", "http://ok.net/?q=://x", "http://spam.net/a?u=1", "http://spam.net/b"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)] + [(0, urls[0], 1), (None, "http://spam.net/a", 1)], "page_id long, url string, host int")
    listing = spark.createDataFrame([("spam.net/a",), ("spam.net/a",), (None,)], "key string")
    got = url_filter.judge_urls(pages, listing).collect()
    assert len(got) == pages.count()
    said = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert said[0] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert said[1] == ("x.com", "/fr/", "com/fr/", "allow") and said[8] == ("com", "/de/1", "com/de/", "block")
    assert said[2][3] == said[3][3] == said[10][3] == said[None][3] == "block" and said[11][3] == "allow"
    assert said[4] == said[5] == said[6] == said[7] == ("", "", None, "allow")
    assert url_filter.judge_urls(pages, listing.filter("false")).filter("verdict = 'block'").count() == 3
    assert url_filter.judge_urls(pages.filter("false"), listing).count() == 0


def test_false_positives_of_the_url_filter_are_taken_out(spark):
    """A filter of few bits takes many URLs for listed ones; the exact join leaves the listed ones only."""
    pages = spark.range(2000).select(F.col("id").alias("page_id"), F.concat(F.lit("n.net/"), F.col("id").cast("string")).alias("_key"))
    keys = spark.range(0, 2000, 10).select(F.concat(F.lit("n.net/"), F.col("id").cast("string")).alias("key"))
    possible = url_filter.with_possible(pages, keys.withColumnRenamed("key", "_key"), 200, keys_per_block=16).filter("_possible").count()
    assert 260 < possible < 1900
    listed = {r.page_id for r in url_filter.with_listed(pages, keys, keys_per_block=16).filter("_listed").collect()}
    assert listed == set(range(0, 2000, 10))


def test_long_urls_and_rules_of_equal_length(spark):
    long = "http://n.net/" + "a/" * 50_000
    pages = spark.createDataFrame([(1, long), (2, long + "b"), (3, "http://x.com/p")], "page_id long, url string")
    rules = (("allow", "com", "/p"), ("block", "x.com", ""), ("allow", "om", "/p/"))
    listing = spark.createDataFrame([("n.net/" + "a/" * 49_999 + "a",)], "key string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, listing, rules).collect()}
    assert got == {1: (None, "block"), 2: (None, "allow"), 3: ("x.com", "block")}


def test_urls_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "BROADCAST_BLOCKS", 0)
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.concat(F.lit("http://n.net/"), (F.col("id") % 50).cast("string")).alias("url"))
    listing = spark.range(0, 50, 2).select(F.concat(F.lit("n.net/"), F.col("id").cast("string")).alias("key"))
    out = url_filter.judge_urls(pages, listing)
    assert out.count() == 500 and out.filter("verdict = 'block'").count() == 250


# --- 6 ---


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    own = list(range(len(rows)))

    def find(x):
        while own[x] != x:
            x = own[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        i = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * i >= 75 * (len(sets[a]) + len(sets[b]) - i):
            own[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for i, (k, _) in enumerate(rows):
        groups[find(i)].append(k)
    least = lambda g: min([k for k in g if k is not None], default=None)
    return sorted(((rows[i][0], len(sets[i]), least(groups[find(i)])) for i in range(len(rows))), key=str)


def got_components(df):
    return sorted(map(tuple, jaccard_join.components(df).collect()), key=str)


def test_components(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert got_components(clash(docs)) == brute_components(rows)
    assert got_components(none) == []


def family(n, size, seed):
    """Edited copies of one text, chains of edits, and strangers that share half of it."""
    r = random.Random(seed)
    base = some_words(size, seed)
    rows = []
    for i in range(n):
        w = list(base) if i % 3 else list(rows[-1][1].split(" ") if rows else base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = f"x{r.randrange(50)}"
        if i % 7 == 0:
            w = w[: size // 2] + some_words(size // 2, seed * 100 + i)
        rows.append((i + seed * 1000, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [768, 5])
def test_components_of_families(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = family(60, 60, 1) + family(40, 25, 2) + family(40, 9, 3) + family(30, 150, 4)
    assert got_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == brute_components(rows)


def test_groups_count_a_set_once_per_bucket():
    """Several buckets in one task: each counts. The same set from several tasks: once."""
    sets = [jaccard_join.shingles(" ".join(some_words(60, 3)[:n])) for n in (60, 58)]
    names = [jaccard_join.name_of(s)[0] for s in sets]
    band = jaccard_join.bands_of(len(sets[0]))[0]
    sketch = []
    for _ in range(2):  # two tasks that sketch the same texts
        batch = jaccard_join.pa.table({"ord": [1, 2], "text": [" ".join(some_words(60, 3)[:n]) for n in (60, 58)]}).to_batches()
        sketch += [b for b in jaccard_join._sketch(iter(batch), 1, 8, {}, None) if b.column("blob").null_count == 0]
    sketch.sort(key=lambda b: b.column("k")[0].as_py())  # as the shuffle brings them
    shared, weights = collections.Counter(), collections.Counter()
    for b in jaccard_join._groups(iter(sketch), 1):
        for blob in b.column("blob").to_pylist():
            a1, bands, met, n_hubs, hubs, weight = (np.frombuffer(x, t) for x, t in zip(blob, ("i8", "i1", "i4", "i4", "i8", "i4"), strict=True))
            owners = np.repeat(np.arange(len(a1)), n_hubs)
            for i, x in enumerate(a1.tolist()):
                if bands[i] == band:
                    shared[x] += int(met[i])
            for i, w in zip(owners.tolist(), weight.tolist(), strict=True):
                if bands[i] == band:
                    weights[int(a1[i])] += w
    whole, less = zip(*([set(v.tolist()) for v in jaccard_join.signatures(s, band, 1)[:2]] for s in sets), strict=True)
    met = [len(whole[i] & (whole[1 - i] | less[1 - i])) for i in (0, 1)]  # by a whole segment, or one with a shingle left out
    assert min(met) > 10 and shared == weights == dict(zip(names, met, strict=True))


def test_left_out_hubs_cover_less_than_half_of_what_partners_share():
    r = random.Random(5)
    for _ in range(300):
        hubs = np.array([r.randrange(1, 12) for _ in range(r.randrange(1, 20))])
        weight = np.array([r.randrange(6) for _ in hubs])
        common = r.randrange(-3, 20)
        kept = set(jaccard_join._needed(hubs, weight, 7, common).tolist())
        gone = sum(w for h, w in zip(hubs.tolist(), weight.tolist(), strict=True) if h != 7 and h not in kept)
        assert 7 not in kept and (2 * gone < common or gone == 0)
        assert common > 0 or kept == set(hubs.tolist()) - {7}


def test_bands_are_cut_finer_until_enough_segments_are_filled(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "n_segments", lambda band, finer: max(2, int(finer * jaccard_join._EDGES[band + 1] // 12)))
    s = jaccard_join.shingles(" ".join(some_words(60, 8)))
    band = jaccard_join.bands_of(len(s))[0]
    poor = [jaccard_join.signatures(s, band, 4**i)[2] for i in range(6)]
    assert not poor[0] and poor[-1]


# --- 7 ---


def test_store(spark, docs, none):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(file)
    path = fresh_path(spark, "store")
    chunk_store.write_store(clash(docs), path, file)
    out = chunk_store.read_documents(spark, path).collect()
    known = texts() | {None: " ".join(some_words(30, 9))}
    assert len(out) == docs.count()
    place = 0
    for r in sorted(out, key=lambda r: r.start):
        want = np.array([*t.encode(known[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert bytes(r.ids) == want.tobytes() and r.start == place and r.n_tokens == len(want)
        place += len(want)
    order = [r.doc_id for r in sorted(out, key=lambda r: r.start)]
    assert order[0] is None and order[1:] == sorted(order[1:])
    chunks = chunk_store._rows(spark, path, "chunk")
    assert chunks.count() == chunks.select("hash").distinct().count()
    empty = fresh_path(spark, "store")
    chunk_store.write_store(none, empty, file)


def test_damaged_store_is_noticed(spark, docs):
    path, broken = fresh_path(spark, "store"), fresh_path(spark, "store")
    chunk_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    spark.read.parquet(f"{path}/rows").filter("kind <> 'chunk' OR n < 300").write.partitionBy("kind").parquet(f"{broken}/rows")
    spark.read.parquet(f"{path}/recipe").write.parquet(f"{broken}/recipe")
    with pytest.raises(Exception, match="missing or differs"):
        chunk_store.read_contents(spark, broken).collect()


def test_ids_of_more_than_16_bits_need_a_wide_store():
    ids = np.array([65_535, 70_000], "<u4")
    assert chunk_store.fitting(ids[:1], False) is not None and chunk_store.fitting(ids, True) is ids
    with pytest.raises(ValueError, match="16 bits"):
        chunk_store.fitting(ids, False)


def test_lost_or_repeated_recipes_are_noticed(spark, docs, none):
    path = fresh_path(spark, "store")
    chunk_store.write_store(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    recipes, manifest = spark.read.parquet(f"{path}/recipe"), spark.read.parquet(f"{path}/manifest")
    first = recipes.filter("start = 0")
    other = recipes.filter("n_tokens > 1").limit(1).withColumn("root", F.sha2("root", 256).cast("binary"))
    damaged = {
        "lost part": recipes.join(manifest.orderBy("first_start").limit(1).select("part"), "part", "left_anti"), "lost end": recipes.filter(f"start < {recipes.agg(F.max('start')).first()[0]}"),
        "repeated": recipes.unionByName(recipes.filter("n_tokens > 1").limit(1)), "changed": recipes.join(other.select("start"), "start", "left_anti").unionByName(other), "whole": recipes.repartition(7),
    }
    assert first.count() == 1
    for name, df in damaged.items():
        broken = fresh_path(spark, "store")
        spark.read.parquet(f"{path}/rows").write.partitionBy("kind").parquet(f"{broken}/rows")
        manifest.write.parquet(f"{broken}/manifest")
        df.select(recipes.columns).write.parquet(f"{broken}/recipe")
        if name == "whole":
            assert chunk_store.read_documents(spark, broken).count() == docs.count()
            continue
        with pytest.raises(Exception, match="missing or repeated|differ from the manifest"):
            chunk_store.read_documents(spark, broken).collect()
    empty = fresh_path(spark, "store")
    chunk_store.write_store(none, empty, public_tokenizers.path("byte_bpe_50k.json"))
    assert chunk_store.read_documents(spark, empty).count() == 0


def test_cuts_cover_and_follow_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50_000, 60_000).astype("<u4")
    ends = chunk_store.cuts(a)
    assert ends[-1] == len(a) and all(0 < y - x <= chunk_store.MOST for x, y in zip([0, *ends], ends, strict=False))
    b = np.concatenate([a[:17], a])
    names = lambda x: {x[i:j].tobytes() for i, j in zip([0, *chunk_store.cuts(x)], chunk_store.cuts(x), strict=False)}
    assert len(names(a) & names(b)) > 0.8 * len(ends)


# --- 8 ---


def brute_removal(rows):
    seen, out = set(), []
    for k, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        w = (t or "").encode().split()
        cover = set()
        for i in range(len(w) - 19):
            g = tuple(w[i : i + 20])
            if g in seen:
                cover |= set(range(i, i + 20))
            seen.add(g)
        kept = b" ".join(x for i, x in enumerate(w) if i not in cover).decode()
        out.append((k, len(w), len(cover), kept))
    return out


def test_substrings(spark, docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {r[0]: r for r in brute_removal(rows)}
    got = substring_dedup.without_repeats(clash(docs)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r._sd_words, r._sd_removed, r._sd_kept) == want[r.doc_id]
    assert substring_dedup.without_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [50_000, 2])
def test_substrings_of_families(spark, monkeypatch, hot):
    monkeypatch.setattr(anchors, "HOT_TEXTS", hot)
    monkeypatch.setattr(anchors, "RUN_TEXTS", 1)
    monkeypatch.setattr(anchors, "FOLD", 50)
    monkeypatch.setattr(anchors, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(anchors, "BROADCAST_SPANS", 0)
    rows = family(40, 120, 6) + family(30, 30, 7) + [(900 + i, "b a " * (15 + i)) for i in range(5)]
    got = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((r.doc_id, r._sd_words, r._sd_removed, r._sd_kept) for r in got) == sorted(brute_removal(rows))


def test_few_spans_meet_their_texts_as_many_do(spark):
    passage = " ".join(f"w{i}" for i in range(40))
    rows = spark.createDataFrame([(1, passage + " a"), (2, "b " + passage), (3, None)], "doc_id long, text string")
    out = substring_dedup.without_repeats(rows)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert {r["doc_id"]: (r["_sd_words"], r["_sd_removed"], r["_sd_kept"], r["text"]) for r in out.collect()} == {1: (41, 0, passage + " a", passage + " a"), 2: (41, 40, "b", "b " + passage), 3: (0, 0, "", None)}


def test_fm_index_finds_all_places():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 400)
    text[::41] = 0
    text[-1] = 0
    index = fm_index.FMIndex(text, reach=64)
    for size in (1, 3, 7):
        for s in range(0, 390, 13):
            p = text[s : s + size]
            if 0 in p:
                continue
            lo, hi = np.array([0]), np.array([len(text)])
            for c in p[::-1]:
                lo, hi = index.extend(np.array([c]), lo, hi)
            assert hi[0] - lo[0] == sum(np.array_equal(text[i : i + size], p) for i in range(len(text) - size + 1))


def test_matching_statistics_equal_brute_force():
    rng = np.random.default_rng(4)
    text = rng.integers(1, 3, 300)
    text[::37] = 0
    text[-1] = 0
    ends = np.arange(1, 300)
    straight = np.arange(300)
    got = fm_index.FMIndex(text, reach=64, order=straight).statistics(text, ends, straight, 3)
    for e, found in zip(ends.tolist(), got.tolist(), strict=True):
        assert found == max([n for n in range(3, 37) if e - n >= 0 and 0 not in text[e - n : e] and any(np.array_equal(text[i : i + n], text[e - n : e]) for i in range(e - n))], default=0)


def test_equal_stretches_take_one_search(monkeypatch):
    """op8 fails the check (CPU seconds): ends with equal words before them go through the index together."""
    asked = []
    step = fm_index.FMIndex.extend
    monkeypatch.setattr(fm_index.FMIndex, "extend", lambda self, symbol, lo, hi: asked.append(len(symbol)) or step(self, symbol, lo, hi))
    piece = " ".join(f"w{i}" for i in range(25)).encode()
    rows = [(7, 7, o, o, 0, 6, piece) for o in range(100)]
    at, lo, hi = substring_dedup.judge(rows)
    assert sorted(zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)) == [(o, 0, 6) for o in range(1, 100)]
    assert sum(asked) < 1000  # 2,500 words in all


def test_known_least_anchors_are_not_worked_out_again(monkeypatch):
    """op8 fails the check (CPU seconds): texts take the least anchor of their list along."""
    windows = anchors.Windows(20, 10)
    text = " ".join(f"w{i}" for i in range(25))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["ord", "t1", "text"])
    (plain,) = anchors._packed(windows)(iter([batch]))
    monkeypatch.setattr(windows, "anchors", None)
    (known,) = anchors._packed(windows)(iter([batch.append_column("least", plain.column("least"))]))
    assert known.equals(plain)


# --- 9 ---


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(file)
    out = packing.pack(clash(docs), file, size=64).collect()
    known = texts() | {None: " ".join(some_words(30, 9))}
    by_seq, total = collections.defaultdict(list), collections.Counter()
    for r in out:
        ids = np.array([*t.encode(known[r.doc_id] or "", add_special_tokens=False).ids, 2], "<u4")
        n = len(r.ids) // 4
        assert n and bytes(r.ids) == ids[r.start : r.start + n].tobytes() and r.doc_tokens == len(ids)
        by_seq[r.sequence_id].append((r.offset, n))
        total[r.doc_id] += n
    assert total[6] == 1 and total[9] == 2 * next(r.doc_tokens for r in out if r.doc_id == 9)
    for own in by_seq.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        filled = sum(n for _, n in own)
        assert filled == 64 or filled & (filled - 1) == 0
    assert packing.pack(none, file).count() == 0


def test_packing_settles_when_many_are_open():
    for most in (1, 3, 2048):
        p = packing.LevelPacker(4096, 0, max_open=most)
        for i in range(200):
            p.add(i, np.arange(100 + i, dtype="<u4"))
        p.settle()
        own = collections.defaultdict(list)
        for doc, start, ids, _, seq, at in p.done:
            own[doc].append((start, np.frombuffer(ids, "<u4").tolist()))
            own[f"seq {seq}"].append((at, len(ids) // 4))
        assert all(sum((x for _, x in sorted(own[i])), []) == list(range(100 + i)) for i in range(200))
        for pieces in (sorted(v) for k, v in own.items() if isinstance(k, str)):
            full = sum(n for _, n in pieces)
            assert [a for a, _ in pieces] == [sum(n for _, n in pieces[:i]) for i in range(len(pieces))] and (full == 4096 or full & (full - 1) == 0)


def test_packing_cuts_little():
    """64 partitions of documents: under a twentieth of the tokens is moved by cuts."""
    r = random.Random(3)
    moved = total = 0
    for _ in range(64):
        p = packing.LevelPacker(4096, 0)
        for i in range(800):
            n = max(1, int(r.lognormvariate(6, 1.2)))
            total += n
            p.add(i, np.zeros(n, "<u4"))
        p.settle()
        moved += p.cut_tokens
    assert moved < 0.05 * total


# --- 10 ---


def test_search(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((600, 16)).astype("f4")
    v[100:160] = v[50]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)]
    rows += [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [None] * 16), (1200, []), (1250, [float("inf")] * 16), (None, rows[3][1]), (1300, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"list": F.lit(1), "v": F.lit(2)}).repartition(3)
    got = collections.defaultdict(list)
    for r in vector_search.search(df, df.filter("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 50))
    x = v.astype("f8")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q, found in got.items():
        s = x @ x[q]
        s[q] = -9
        best = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        hits += len({a for a, _ in found} & set(best.tolist()))
        assert all(abs(score - s[a]) < 1e-9 for a, score in found)
    assert hits >= 0.9 * 5 * len(got)
    assert [a for a, _ in got[50]] == [100, 101, 102, 103, 104]
    few = vector_search.search(df.filter("vec_id < 3"), df.filter("vec_id = 0")).collect()
    assert [r.rank for r in few] == [1, 2]
    assert vector_search.search(df.filter("false"), df).count() == 0
    assert vector_search.search(df, df.filter("false")).count() == 0


def test_search_counts_rows_and_scales_huge_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.1]), (1, [2.0, 0.1]), (2, [1e200, 1e199]), (2, [0.0, -1.0]), (3, [-1e-200, 0.0]), (0, [1.0, 0.0]), (50, [1e308, 1e308])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in vector_search.search(df, F.col("vec_id") % 50 == 0, k=7).orderBy("query_id", "rank", "vec_id").collect():
        got[r.query_id].append((r.rank, r.vec_id, round(r.score, 9)))
    near, far = round(2 / np.hypot(2, 0.1), 9), round(1 / np.hypot(1, 0.1), 9)
    assert got[50][0][1:] == (2, round(1.1 / np.hypot(1, 0.1) / np.sqrt(2), 9)) and len(got[50]) == 7
    one = [(0, 1.0), (1, near), (1, near), (2, far), (50, round(np.sqrt(0.5), 9)), (2, 0.0), (3, -1.0)]
    assert got[0] == [(i + 1, *x) for i, x in enumerate(one) for _ in range(2)]  # two rows ask, each finds the other
    outside = spark.createDataFrame([(1, [1e200, 0.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in vector_search.search(df, outside, k=3).orderBy("rank").collect()] == [0, 0, 2]


# --- tokenizers ---


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_word_ids_equal_the_library(name):
    from tokenizers import Tokenizer

    from boqspark.llm.word_ids import WordIds

    file = public_tokenizers.path(name)
    library, own, r = Tokenizer.from_file(file), WordIds(file), random.Random(11)
    letters = [c for c in map(chr, range(0x80, 0x2000)) if c.isalpha()] + ["\u0130", "\u0958", "\ufb1d"]
    odd = ["<|endoftext|>", "<|startoftext|>", "<|endoftext|", "\u0307", "\u0301", "don't", "'s", "123", "...", " ", "\n", "\t", "😀", "İ,", "İ."]
    texts = [c + mark for c in ["\u0130", "\u0958", "Σ", "ß"] for mark in (".", ",", ".,", "")] + ["a <|endoftext|> b", "x<|endoftext|>.", "<|ENDOFTEXT|>"]
    for _ in range(1500):
        texts.append("".join(r.choice(odd) if r.random() < 0.3 else "".join(r.choice(letters) for _ in range(r.randint(1, 4))) + r.choice([" ", ". ", ", ", ".", ",\n"]) for _ in range(r.randint(1, 8))))
    for lo in range(0, len(texts), 300):
        for t, ids in zip(texts[lo : lo + 300], own.encode(texts[lo : lo + 300], 7), strict=True):
            assert ids.tolist() == [*library.encode(t, add_special_tokens=False).ids, 7], t


def test_words_of_many_lines_are_looked_up_at_once():
    from tokenizers import Tokenizer

    from boqspark.llm.word_ids import WordIds

    file = public_tokenizers.path("byte_bpe_50k.json")
    own, library = WordIds(file), Tokenizer.from_file(file)
    assert own._by_line("a b\nc d") == ["\na", "b", "\nc", "d"]
    texts = ["a b\nc d", "b\na", "x", "a\u2003b\nc", " a", "a ", "a  b", "a\n\nb", "a \nb", "a\n b", "\na", "a\n", "\n", " ", ""]
    for _ in range(2):
        for t, ids in zip(texts, own.encode(texts, 0), strict=True):
            assert ids.tolist() == [*library.encode(t, add_special_tokens=False).ids, 0], t


def test_workers_keep_as_many_words_as_they_are_told():
    from tokenizers import Tokenizer

    from boqspark.llm.word_ids import word_ids

    file = public_tokenizers.path("word_bpe_49k.json")
    own, library = word_ids(file, 50), Tokenizer.from_file(file)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) for i in range(20)]
    for lo in range(0, 20, 5):
        for t, ids in zip(texts[lo : lo + 5] + texts[:1], own.encode(texts[lo : lo + 5] + texts[:1], 2), strict=True):
            assert ids.tolist() == [*library.encode(t, add_special_tokens=False).ids, 2], t
    own.encode(texts[:1], 2)
    assert 30 <= len(own.bare) <= 50 < packing.STAGE_WORDS


# --- pipeline ---


def test_pipeline_stages(spark, docs, none):
    import tempfile

    import corpus_pipeline

    sf = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for start in (clash(docs), none):
        d = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            columns = d.columns
            path = fresh_path(spark, "t")
            stage(spark, d, sf).write.parquet(path)
            d = spark.read.schema(d.schema).parquet(path)
            assert d.columns == columns
        last = corpus_pipeline.STAGES[-1][1](spark, d, sf)
        last.collect()
    kept = quality_rules.stage_quality(spark, docs, sf)
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 13, 17}
    near = jaccard_join.stage_near_duplicates(spark, kept, sf)
    ids = {r.doc_id for r in near.collect()}
    assert 1 in ids and not ids & {2, 3}
    cut = {r.doc_id: r for r in substring_dedup.stage_substrings(spark, near, sf).collect()}
    want = {r[0]: r for r in brute_removal([(r.doc_id, r.text) for r in near.collect()])}
    for k, r in cut.items():
        assert words_of(r.text) == words_of(want[k][3]) and (want[k][2] == 0 or r.n_chars == len(r.text))
    assert hashlib.sha256(cut[1].text.encode()).hexdigest() == hashlib.sha256(texts()[1].encode()).hexdigest()
