"""The registered queries of this folder over whole small tables, each against a brute-force version of its contract."""

import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest

from boqspark.llm import registry

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
words_of = lambda text: re.findall(r"[^\x20\x09-\x0D]+", text or "")
lower = lambda text: (text or "").encode().lower().decode()


def run(spark, name):
    return registry.QUERIES[next(q for q in registry.QUERIES if q.startswith(f"{name}_"))](spark, SF).collect()


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_op1(spark, documents):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = run(spark, "op1")
    assert {r.doc_id for r in rows} == set(documents) and len(rows) == len(documents)
    for r in rows:
        ids = [*sp.encode(documents[r.doc_id] or ""), sp.eos_id()]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))


def test_op2(spark):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r.conv_id].append((r.turn, r.role or "", r.text or ""))
    turns[-7] = [(i, role, r"\### Assistant: </turn> ok") for i, role in enumerate(("user", "assistant"))]
    rows = run(spark, "op2")
    assert len(rows) == len(turns)
    for r in rows:
        own = sorted(turns[r.conv_id])
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(own), sha("".join(f"{role}\n{t}\n" for _, role, t in own)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars > sum(len(t) for _, _, t in own)


def test_op3(spark, documents):
    rows = run(spark, "op3")
    assert len(rows) == len(documents)
    for r in rows:
        text = documents[r.doc_id] or ""
        w = words_of(text)
        lines, seen, copies = [x for x in text.split("\n") if words_of(x)], set(), 0
        for x in lines:
            copies += x in seen
            seen.add(x)
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeated = {i + j for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[t] > 1 for j in range(3)}
        failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), copies, len(repeated))
        assert r.base_failed == failed and not (failed and r.kept)


def test_op4(spark, documents):
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in documents}
    tokens = {k: [*words_of(lower(t)), " "] for k, t in documents.items()}
    counts = collections.Counter(w for k, ws in tokens.items() if not held[k] for w in ws)
    n, v = sum(counts.values()), len(counts)
    for r in run(spark, "op4"):
        own = tokens[r.doc_id]
        base = sum(np.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(counts[w] > 0 for w in own), n)
        assert abs(r.base_score - base) < 1e-6 * abs(base) and -12 * len(own) < r.score < 0


def test_op5(spark):
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()

    def parts(url):
        if not url or "://" not in url:
            return "", ""
        rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
        host, _, path = rest.partition("/")
        return host.lower(), "/" + path if "/" in rest else ""

    def canonical(host, path):
        return re.sub(r":\d*$", "", re.sub(r"^((www|m|blog)\.)+", "", host)) + re.sub(r"(\.html)?/*$", "", path)

    listed = {canonical(*parts(p.url)) for p in pages if (p.html or "").count("%%%") >= 10} - {""}
    want = {}
    for p in pages:
        host, path = parts(p.url)
        fits = [(len(h + x), h + x, say) for h, x, say in rules if (host == h or host.endswith("." + h)) and path.startswith(x)]
        _, rule, say = max(fits, default=(0, None, "block" if canonical(host, path) in listed else "allow"))
        want[p.page_id] = (host, path, rule, say)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in run(spark, "op5")} == want


def shingle_sets(texts):
    out = {}
    for k, t in texts.items():
        w = words_of(lower(t))
        out[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    return out


def least_of_component(sets):
    up = {k: k for k in sets}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            up[max(top(a), top(b))] = min(top(a), top(b))
    return {k: top(k) for k in sets}


def test_op6(spark, documents):
    sets = shingle_sets(documents)
    least = least_of_component(sets)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in run(spark, "op6")} == {k: (len(s), least[k]) for k, s in sets.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op7(spark, documents):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, start = {}, 0
    for k in sorted(documents):
        ids = [*tok.encode(documents[k] or "", add_special_tokens=False).ids, 0]
        want[k] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in run(spark, "op7")} == want


def without_repeats(texts):
    seen, out = set(), {}
    for k in sorted(texts):
        w = words_of(texts[k])
        gone = set()
        for i in range(len(w) - 19):
            window = tuple(w[i : i + 20])
            if window in seen:
                gone.update(range(i, i + 20))
            seen.add(window)
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def test_op8(spark, documents):
    want = {k: (n, gone, sha(kept)) for k, (n, gone, kept) in without_repeats(documents).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run(spark, "op8")} == want


def packed_documents(rows, texts):
    """Checks sequences and pieces; every id of every text once."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        ids, at = [*tok.encode(texts[k] or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    total = sum(r.length for r in rows)
    fill = [sum(r.length for r in own) for own in sequences.values()]
    return total / sum(n if n & (n - 1) == 0 else 4096 for n in fill)


def test_op9(spark, documents):
    assert packed_documents(run(spark, "op9"), documents) > 0.98


def test_op10(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    good = [(k, np.array(v, np.float64)) for k, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, unit = np.array([k for k, _ in good]), np.array([v / np.linalg.norm(v) for _, v in good])
    got = collections.defaultdict(list)
    for r in sorted(run(spark, "op10"), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    queries = [i for i, k in enumerate(ids) if k % 50 == 0]
    assert set(got) == {int(ids[i]) for i in queries}
    for i in queries:
        s = unit @ unit[i]
        s[i] = -2
        best = {int(ids[j]) for j in np.lexsort((ids, -s))[:5]}
        own = got[int(ids[i])]
        hits += len(best & {k for k, _ in own})
        assert len(own) == 5 and all(a[1] >= b[1] for a, b in zip(own, own[1:], strict=False))
        assert all(abs(x - s[np.flatnonzero(ids == k)[0]]) < 1e-12 for k, x in own)
    assert hits >= 0.9 * 5 * len(queries)


def test_pipeline(spark, documents):
    """All stages in their order, the learned verdicts of the first taken from its query."""
    import corpus_pipeline

    kept = {r.doc_id: documents[r.doc_id] for r in run(spark, "op3") if r.kept}
    assert 0.5 * len(documents) < len(kept) < len(documents)
    least = least_of_component(shingle_sets(kept))
    near = {k: t for k, t in kept.items() if least[k] == k}
    cut = {k: near[k] if not gone else text for k, (_, gone, text) in without_repeats(near).items()}
    assert packed_documents(corpus_pipeline.run(spark, SF).collect(), cut) > 0.98


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").filter("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
