import datetime
import random

import pytest
from pyspark.sql import functions as F

from boqspark.functions import cables, classify, codes, text
from boqspark.operators import analysis, learning, matching, search, topk, tree
from boqspark.sources import imports, ingest, mapping
from boqspark.streaming import streams

DAY = datetime.date(2026, 3, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(v):
    return F.lit(v).cast("string")


# --- families and specs ---


def test_specs_of_families(spark):
    spec = lambda family, name, feature="": one(spark, classify.spec(F.lit(family), lit(name), lit(feature)))
    assert spec("电线电缆", "电力电缆", "WDZA-YJY 4×120+1×70mm2") == "YJY-4*120+1*70"
    assert spec("电线电缆", "布电线", "BV-2.5") == "BV-2.5"
    assert spec("电线电缆", "控制电缆", "") == "KVV(无截面)"
    assert spec("电线电缆", "电缆", "铜芯") == "电缆(未识别)"
    assert spec("电线电缆", "电缆头", "YJV 4*16") == "电线电缆(未识别)"
    assert spec("钢筋", "现浇构件", "HRB400 Φ 20") == "HRB400 Φ20" and spec("钢筋", "钢筋笼") == "钢筋_未识别"
    assert spec("混凝土", "柱", "混凝土 C30 泵送") == "C30"
    assert spec("水泥", "水泥", "p.o 425") == "P.O425"
    assert spec("管道", "镀锌钢管", "DN 50") == "镀锌钢管 DN50"
    assert spec("管道", "配管", "SC20") == "焊接钢管 DN20"
    assert spec("配管配线", "配管", "jdg 25") == "JDG25" and spec("配管配线", "配管") == "配管(未识别)"


def test_families_by_text(spark):
    f = lambda name, feature="": one(spark, classify.by_text(lit(name), lit(feature)))
    assert f("PE管 安装") is None or f("HDPE管安装") == "管道"
    assert f("铜管", "DN15") == "管道" and f("止回阀", "DN50") is None and f("铜管", "弯头") is None
    assert f("电缆桥架") is None and f("电力电缆敷设") == "电线电缆" and f("螺纹钢") == "钢筋" and f("白水泥") == "水泥" and f("白水泥", "擦缝") is None
    assert f("基础", "C25 垫层") == "混凝土"


def test_lines_get_family_spec_and_material(spark):
    rows = spark.createDataFrame([(1, "030408001001", "2013", "电力电缆", "YJV 4*16"), (2, None, "2024", None, None), (3, "010502001", "unknown", "柱", "C30")], "id int, item_code string, item_code_version string, item_name string, item_feature string")
    got = {r.id: (r.family, r.spec, r.material_type) for r in classify.with_family(rows).collect()}
    assert got == {1: ("电线电缆", "YJV-4*16", "电力电缆"), 2: (None, None, None), 3: (None, None, None)}


def test_cables(spark):
    f = one(spark, cables.cable_features(F.lit("wdza-yjy-4×120+1x70")))
    assert (f.grade, f.fire, f.halogen_free, f.armoured, f.cores, f.section, f.total_section) == ("A级", False, True, False, "4×120.0+1×70.0", 120.0, 550.0)
    assert "WDZA-YJY4*16" in one(spark, cables.spec_aliases(F.lit("WDZAYJY4*16"))) and "WDZ-AYJY4*16" in one(spark, cables.spec_aliases(F.lit("WDZAYJY4*16")))
    score = lambda a, b: one(spark, cables.feature_score(cables.cable_features(F.lit(a)), cables.cable_features(F.lit(b))))
    assert score("YJV 4*16", "yjv 4×16") == 90 and score("YJV 4*16", "YJV 3*16") == 60 and score("YJV", "BV 2*4") == 15


def test_texts(spark):
    assert one(spark, text.unit_symbol(F.lit("立方米/年"))) == "m³/年" and one(spark, text.unit_symbol(F.lit("千克"))) == "kg"
    assert one(spark, text.clean_spec(F.lit(" φ20 x 30"))) == "Φ20×30"
    assert one(spark, text.attributes(F.lit('{"a": "1", "b": null}'))) == {"a": "1"} and one(spark, text.attributes(F.lit('["x", "y"]'))) == {"0": "x", "1": "y"} and one(spark, text.attributes(lit(None))) == {}
    f = one(spark, text.project_features(F.lit("镀锌钢管 DN50 Φ20")))
    assert {"镀锌", "钢管"} <= set(f.materials) and {"DN50", "Φ20"} <= set(f.specs)
    assert one(spark, codes.code_full(F.lit("z" + "a" * 100))) == "Z" + "A" * 100
    assert one(spark, codes.big_family(F.lit("031001001"), F.lit("2013"))) == "管道" and one(spark, codes.big_family(F.lit("010101"), lit(None))) is None


# --- matching ---


def brute_edit(a, b):
    a, b = a.strip(), b.strip()
    if not a or not b:
        return 0.0

    def ratio(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            old, row = row, [0]
            for j, d in enumerate(y):
                row.append(max(row[-1], old[j + 1], old[j] + (c == d)))
        return 200 * row[-1] / (len(x) + len(y))

    s, l = sorted((a, b), key=len)
    windows = [l[i : i + n] for n in range(1, len(s) + 1) for i in range(len(l)) if i == 0 or i + n >= len(l) or n == len(s)]
    best = max(ratio(s, w) for w in windows if w)
    if len(a) == len(b):
        best = max(best, *(ratio(l, s[i:]) for i in range(len(s))), *(ratio(l, s[:i]) for i in range(1, len(s) + 1)))
    return max(best, ratio(a, b))


def test_edit_score_equals_brute_force():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("电缆线ab ") for _ in range(rng.randint(0, 9)))
    assert matching.edit_score("配电箱", "照明配电箱") == 100 and matching.edit_score(None, "x") == 0
    for _ in range(400):
        a, b = word(), word()
        assert abs(matching.edit_score(a, b) - brute_edit(a, b)) < 1e-9


def node_score(q_name, q_spec, level, name, spec):
    own = topk.edit_score(q_name, name)
    base = 0.7 * own + 0.3 * (topk.edit_score(q_spec, spec) if q_spec else 0)
    s = min(100.0, base * (0.8 if level == "l3" else 1.0) + (30 if own > 90 else 0))
    return round(100.0 if level == "l3" and q_spec and q_spec == spec else s, 6)


def made_up(rng, n, letters="电力缆线箱管钢阀abc"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_edit_top_k_equals_all_pairs(spark, monkeypatch):
    """10,000 made-up names: the best of all pairs, while few are scored."""
    rng = random.Random(8)
    names = list(dict.fromkeys(made_up(rng, 10_500)))[:10_000]
    pool = [(i, "l4" if i % 3 else "l3", n, n[:2]) for i, n in enumerate(names)]
    asked = [(i, n if i % 2 else n[1:] + "x", rng.choice(["", "电力", "缆线"])) for i, n in enumerate(rng.sample(names, 24))]
    p, q = spark.createDataFrame(pool, "dict_id long, level string, name string, spec string"), spark.createDataFrame(asked, "qid long, name string, spec string")
    got = {}
    for r in topk.edit_top_k(q, p, 5).collect():
        got.setdefault(r.qid, {})[r.dict_id] = r.score
    block, scored = topk.NodeBlock([{"level": level, "name": n, "spec": s, "ids": [i]} for i, level, n, s in pool]), 0
    for i, q_name, q_spec in asked:
        all_ = {d: node_score(q_name, q_spec, level, n, s) for d, level, n, s in pool}
        best = sorted(all_, key=lambda d: (-round(all_[d] + 1e-9, 2), d))[:5]
        mine = sorted(got[i], key=lambda d: (-got[i][d], d))[:5]
        assert [round(all_[d] + 1e-9, 2) for d in best] == [got[i][d] for d in mine] and best == mine
        before = block.scored
        block.best(q_name, q_spec, 5, 0.0, frozenset())
        scored += block.scored - before
        assert all(topk.edit_score(q_name, n) <= b + 1e-9 for n, b in zip(block.names.names[::50], block.names.bounds(q_name)[::50], strict=True))
    assert scored < 0.2 * len(asked) * len(pool)
    monkeypatch.setattr(topk, "POOL_ROWS", 3000)
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    again = topk.sim.top_k(topk.edit_top_k(q, p, 5), "qid", 5).collect()
    assert {(r.qid, r.dict_id) for r in again} == {(i, d) for i in got for d in sorted(got[i], key=lambda d: (-got[i][d], d))[:5]}


def test_ratio_pairs_equal_all_pairs(spark, monkeypatch):
    rng = random.Random(12)
    left, right = made_up(rng, 40), made_up(rng, 300) + ["", " ", "电力电缆" * 5]
    a, b = spark.createDataFrame([(x,) for x in [*left, None]], "a string"), spark.createDataFrame([(x,) for x in [*right, None]], "b string")

    def ratio(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            old, row = row, [0]
            for j, d in enumerate(y):
                row.append(max(row[-1], old[j + 1], old[j] + (c == d)))
        return 200 * row[-1] / (len(x) + len(y)) if x or y else 0.0

    all_ = {(x, y): ratio(x, y) for x in set(left) for y in set(right)}
    monkeypatch.setattr(topk, "POOL_ROWS", 90)
    for k, least in ((3, 0.0), (1, 65.0), (None, 60.0)):
        want = {p: s for p, s in all_.items() if s > 0 and s >= least}
        if k:
            best = {x: sorted((y for p, y in want if p == x), key=lambda y: (-round(all_[x, y] + 1e-9, 4), y))[:k] for x in set(left)}  # noqa: B023
            got = {}
            for r in topk.sim.best_by_edit(a, b, "a", "b", k, least).collect():
                got.setdefault(r.a, []).append((r["rank"], r.b))
            assert {x: [y for _, y in sorted(v)] for x, v in got.items()} == {x: v for x, v in best.items() if v}
        else:
            assert {(r.a, r.b): r.score for r in topk.ratio_pairs(a, b, "a", "b", k, least).collect()} == want


def test_cosine_top_k_equals_all_pairs(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[min(39, int(rng.expovariate(0.15)))] for _ in range(rng.randint(0, 12)))) for i in range(400)], "id long, text string")
    v = topk.sim.tfidf(docs, "id", "text", 30)
    a, b = v.filter("id % 7 = 0").withColumnRenamed("id", "a"), v.withColumnRenamed("id", "b")
    want = topk.sim.top_k(topk.sim.cosine_pairs(a, b, "a", "b").withColumn("score", F.round("score", 6)).filter("score > 0"), "a", 6, by="b")
    got = topk.cosine_top_k(a, b, "a", "b", 6)
    assert sorted((r.a, r["rank"], r.b, r.score) for r in got.collect()) == sorted((r.a, r["rank"], r.b, r.score) for r in want.collect())


def brute_recall(spark, q, p, weights, k=5):
    """qid -> [(dict_id, score)]: the edit score of all nodes, the ten nearest of both vector models, weighted means, the best node of each name."""
    pool = {r.dict_id: r for r in p.collect()}
    scores = {}
    for r in q.collect():
        for n in pool.values():
            if s := round(node_score(r.name, r.spec, n.level, n.name, n.spec) + 1e-9, 2):
                scores.setdefault((r.qid, n.dict_id), {})["edit"] = s
    for source, features in (("tfidf", 10_000), ("vector", 512)):
        own, idf = topk.sim.fitted(p.select("dict_id", F.concat_ws(" ", "name", "spec", "path").alias("text")), "dict_id", "text", features)
        mine = topk.sim.transformed(q.select("qid", F.concat_ws(" ", "name", "spec").alias("text")), "qid", "text", idf)
        for r in topk.sim.top_k(topk.sim.cosine_pairs(mine, own, "qid", "dict_id").withColumn("score", F.round("score", 6)).filter("score > 0"), "qid", 10).collect():
            scores.setdefault((r.qid, r.dict_id), {})[source] = r.score
    out = {}
    for r in q.collect():
        w = weights[r.qid]
        means = {d: round(sum(s[x] * w[x] for x in s) / sum(w[x] for x in s) + 1e-9, 2) for (i, d), s in scores.items() if i == r.qid}
        best = {}
        for d in sorted(means, key=lambda d: (-means[d], d)):
            best.setdefault(pool[d].name, d)
        out[r.qid] = [(d, means[d]) for d in sorted(best.values(), key=lambda d: (-means[d], d))[:k]]
    return out


def test_recall_equals_brute_force(spark):
    rng = random.Random(5)
    names = made_up(rng, 250) + ["配电箱", "照明配电箱"] * 3
    rows = [(i, rng.choice(["l3", "l4"]), n, rng.choice([n, "电力", "x1", "缆线 2"]), f"a/{n[:2]}/{n}") for i, n in enumerate(names + names[:40])]
    p = spark.createDataFrame(rows, "dict_id long, level string, name string, spec string, path string")
    asked = [(i, n, rng.choice(["", "电力", "x1", "ab"])) for i, n in enumerate(made_up(rng, 20) + names[:6] + ["配电箱", "zz"])]
    q = spark.createDataFrame(asked, "qid long, name string, spec string")
    plain = {i: topk.sim.FUSION for i, _, _ in asked}
    got = lambda frame: {i: [(r.dict_id, r.score) for r in sorted((r for r in frame if r.qid == i), key=lambda r: r["rank"])] for i, _, _ in asked}
    want = brute_recall(spark, q, p, plain)
    assert got(matching.recall(q, p).collect()) == want and sum(map(len, want.values())) > 100
    own = {i: {"edit": 0.8, "tfidf": 0.1, "vector": 0.1} if i % 2 else {"edit": 0.05, "tfidf": 0.15, "vector": 0.8} for i, _, _ in asked}
    w = lambda a: F.when(F.col("qid") % 2 == 1, own[1][a]).otherwise(own[0][a])
    weighted = q.withColumns({f"w_{a}": w(a) for a in own[0]})
    other = brute_recall(spark, q, p, own)
    assert got(matching.recall(weighted, p).collect()) == other != want


def test_prematch_learns_from_confirmations(spark):
    """Confirmations of a category change the order of its candidates, and of no others."""
    rng = random.Random(6)
    names = made_up(rng, 200, "电力缆线箱管钢阀")
    p = spark.createDataFrame([(i, "l4", n, n, f"a/{n}") for i, n in enumerate(names)], "dict_id long, level string, name string, spec string, path string")
    items = [(i, n, "", f"材料/{'电缆' if i % 2 else '管道'}/x", i % 3, True, None) for i, n in enumerate(made_up(rng, 30, "电力缆线箱管钢阀"))]
    lines = spark.createDataFrame(items, "id long, name string, spec string, path string, import_batch_id long, active boolean, material_dict_id long")
    e = spark.createDataFrame([("材料/电缆", DAY, i, 0, 0, 1) for i in range(60)], "category string, ts date, id long, edit_hit int, tfidf_hit int, vector_hit int").withColumn("ts", F.col("ts").cast("timestamp"))
    learned = learning.replay(e)
    plain = {r.id: r.candidates for r in matching.prematch(lines, p).collect()}
    taught = {r.id: r.candidates for r in matching.prematch(lines, p, learned=learned).collect()}
    assert all(len({c.name for c in r}) == len(r) <= 5 and [c.score for c in r] == sorted((c.score for c in r), reverse=True) for r in taught.values())
    assert all(plain[i] == taught[i] for i in plain if i % 2 == 0) and any(plain[i] != taught[i] for i in plain if i % 2)
    assert {r.id for r in matching.prematch(lines, p, batch=1, first=4).collect()} == {1, 4, 7, 10}
    now = F.lit("2026-01-02 12:00:00").cast("timestamp")
    some = matching.prematch(lines, p, batch=1).withColumn("top_score", F.lit(-1.0))
    old = matching.prematch(lines, p).withColumn("computed_at", F.lit("2025-01-01").cast("timestamp"))
    store = matching.stored(old, some, now)
    kept = {r.id: r for r in store.collect()}
    assert len(kept) == 30 and all((r.top_score == -1) == (i % 3 == 1) for i, r in kept.items())
    assert {r.id for r in matching.fresh_matches(store, now).collect()} == {i for i in kept if i % 3 == 1}


def test_stages_of_the_list_match(spark):
    items = spark.createDataFrame([("a", "配电箱", ""), ("b", "砼", ""), ("c", "照明配电箱安装", ""), ("d", "电力电缆敷", ""), ("e", "零星", "采用石油沥青和镀锌钢管"), ("f", "其他", "")], "item string, name string, feature string")
    d = spark.createDataFrame([(1, "配电箱"), (2, "混凝土"), (3, "电力电缆线"), (4, "镀锌钢管"), (5, "沥青")], "dict_id long, dict_name string")
    s = spark.createDataFrame([("砼", "混凝土"), ("石油沥青", "沥青")], "synonym string, standard string")
    got = {r.item: (r.dict_id, r.how) for r in matching.progressive_all(items, d, s).collect()}
    assert got == {"a": (1, "exact"), "b": (2, "synonym"), "c": (1, "contained"), "d": (3, "fuzzy"), "e": (4, "feature"), "f": (None, "none")}


def test_specs_below_a_matched_node(spark):
    items = spark.createDataFrame([("a", 1, "Φ20 mm"), ("b", 1, ""), ("c", 2, "30")], "item string, dict_id long, spec string")
    nodes = spark.createDataFrame([(11, 1, "20"), (12, 1, "25"), (21, 2, "DN30")], "id long, parent_id long, spec string")
    assert {(r.item, r.child_id) for r in matching.spec_matches(items, nodes).collect()} == {("a", 11), ("c", 21)}


def test_cables_meet_their_baseline(spark):
    items = spark.createDataFrame([("a", "yjv 4×16"), ("b", "WDZAYJY 4*25"), ("c", "ZR-YJV 3*50"), ("d", "BV 2.5"), ("e", None), ("f", "NH-YJV 4*16+1*10")], "item string, spec string")
    base = spark.createDataFrame([(1, "YJV4*16"), (2, "WDZA-YJY4*25"), (3, "YJV 3*50"), (4, "YJY 4*50"), (5, "YJV 4*16")], "base_id long, base_spec string")
    got = {r.item: (r.base_id, r.how, r.score) for r in matching.cable_baseline(items, base).collect()}
    assert got == {"a": (1, "spec", 100), "b": (2, "alias", 100), "c": (3, "feature", 90), "d": (None, "none", 0), "e": (None, "none", 0), "f": (None, "none", 0)}  # 55 points


# --- learning ---


def test_weights_of_one_confirmation():
    """By hand: rate 0.1 * 1.5 * 1.4 = 0.21; hit of score 80: +0.21 * 1.24; second place: -0.21 * 0.8; not found: -0.105."""
    w = learning.Weights()
    w.confirm([True, False, False], [0, 1, -1], [80.0, 70.0, 0.0], 0.4)
    new = [0.3 + 0.3 * 0.2604, 0.35 - 0.3 * 0.168, 0.35 - 0.3 * 0.105]
    assert w.values == [round(x / sum(new), 4) for x in new] and w.n == 1
    before = list(w.values)
    w.reject(0)
    assert w.n_rejected == 1 and w.values[0] < before[0] and abs(sum(w.values) - 1) < 2e-4


def test_strategies_and_fusion():
    w = learning.Weights()
    for i in range(60):
        w.confirm([i % 4 != 0, False, i % 4 == 0], quality=0.5)
    assert w.fusion != learning.FUSION_START and abs(sum(w.fused()) - 1) < 2e-4 and w.fused()[0] == max(w.fused())
    assert learning.Weights(w.state()).state() == w.state()


def test_quality_and_uncertainty(spark):
    q = lambda ids, s: one(spark, learning.info_quality(F.array(*[F.lit(i).cast("int") for i in ids]), F.array(*[F.lit(x) for x in s])))
    assert q([1, None, None], [90.0, 0.0, 0.0]) == 0.3
    assert q([1, 1, 1], [90.0, 90.0, 90.0]) == 0.4
    assert abs(q([1, 2, 3], [90.0, 80.0, 85.0]) - (0.6 + 0.4 * (1 - (50 / 3) / 100))) < 1e-9
    u = lambda ids, a, b: one(spark, learning.uncertainty(F.array(*[F.lit(i).cast("int") for i in ids]), F.array(*[F.lit(x) for x in a]), F.array(*[F.lit(x) for x in b])))
    assert u([1, 1, 1], [90.0, 90.0, 90.0], [60.0, 60.0, 60.0]) == round(0.35 / 3, 4)
    assert u([1, 2, 3], [45.0, 45.0, 45.0], [45.0, 45.0, 45.0]) == 0.725
    assert one(spark, learning.rank_of(F.lit(5), F.array(F.lit(3), F.lit(5)))) == 1 and one(spark, learning.rank_of(F.lit(9), F.array(F.lit(3)))) == -1


def test_hit_rates_do_not_depend_on_chunks(spark):
    rows = [("a" if i % 3 else "b", datetime.datetime(2026, 1, 1) + datetime.timedelta(hours=i), i, i * 7 % 2) for i in range(500)]
    df = spark.createDataFrame(rows, "category string, ts timestamp, id long, hit int")
    one_, many = ({r.id: (r.rate, r.seen) for r in learning.hit_rates(df, 50, chunk).collect()} for chunk in (10**6, 60))
    assert one_ == many and len(one_) == 500


def test_streams(spark, tmp_path):
    rows = [(f"c{i % 2}", i, i, i % 2, i % 3 == 0, 1) for i in range(40)]
    made = spark.createDataFrame([(c, t, k, int(a), int(b), d) for c, t, k, a, b, d in rows], "category string, ts long, id long, edit_hit int, tfidf_hit int, vector_hit int")
    for lo in (0, 20):  # two files, in the order of time
        made.filter((F.col("id") >= lo) & (F.col("id") < lo + 20)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(made.schema).parquet(f"{tmp_path}/in")
    q = streams.learn(stream).writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{tmp_path}/out"))
    q.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    last = {r.category: (r.n, round(r.edit, 6)) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("n").collect()}
    assert last == {r.category: (r.n, round(r.edit, 6)) for r in learning.replay(made).collect()}


def test_files_are_taken_in_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, content in (("a.csv", "x"), ("b.csv", "x"), ("c.csv", "y")):
        (tmp_path / "in" / name).write_text(content)
    go = lambda: streams.ingest_once(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    go()
    (tmp_path / "in" / "d.csv").write_text("y")
    (tmp_path / "in" / "e.csv").write_text("z")
    go()
    assert sorted(bytes(r.content).decode() for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["x", "y", "z"]
    spark.createDataFrame([(1,)], "n int").write.parquet(f"{tmp_path}/p")
    streams.ingest(spark, f"{tmp_path}/p", "n int", f"{tmp_path}/q", f"{tmp_path}/s2").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/q").count() == 1
    streams.for_each_batch(spark.readStream.schema("n int").parquet(f"{tmp_path}/p"), lambda b: b.withColumn("m", F.col("n") + 1), f"{tmp_path}/r", f"{tmp_path}/s3").awaitTermination()
    assert [r.m for r in spark.read.parquet(f"{tmp_path}/r").collect()] == [2]


def test_counts_by_window(spark, tmp_path):
    rows = [(datetime.datetime(2026, 1, 1, 0, m), "a") for m in (1, 30, 59)] + [(datetime.datetime(2026, 1, 1, 1, 5), "a")]
    df = spark.createDataFrame(rows, "ts timestamp, category string")
    assert sorted(r.n for r in streams.windowed_counts(df).collect()) == [1, 3]


# --- import ---


def test_files_of_any_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("某工程;;\n项目编码;项目名称;合价\n030404001001;电缆;1,5\n".encode("gbk"))
    (tmp_path / "b.csv").write_text("项目名称,单位," + ",".join(f"x{i}" for i in range(40)) + "\n阀门,台," + ",".join("1" * 40) + "\n", encoding="utf-8-sig")
    got = {(r.item_code, r.item_name, r.unit, r.total) for r in ingest.records(ingest.read_csv_files(spark, str(tmp_path))).collect()}
    assert got == {("030404001001", "电缆", None, "1,5"), (None, "阀门", "台", None)}


def test_judged_rows(spark):
    rows = [("f", 1, "030404001001", "电缆", "Ｍ", "10", "2", "20"), ("f", 2, None, "第一章", None, None, None, None), ("f", 3, None, "本页小计", None, None, None, "20.01"), ("f", 4, "x1", "灯", "樘", "many", "1", "1,000"), ("f", 5, None, " ", None, None, None, None)]
    r = spark.createDataFrame(rows, "path string, row long, item_code string, item_name string, unit string, quantity string, unit_rate string, total string")
    j = imports.judged(r)
    got = {x.sequence: x for x in j.collect()}
    assert {k: x.kind for k, x in got.items()} == {1: "line", 2: "structure", 3: "summary", 4: "line", 5: "blank"}
    assert got[1].unit_std == "m" and got[1].anomaly_flag == "normal" and got[1].item_code_raw == "030404001001"
    assert got[4].anomaly_reason == "计量单位未归一化: 樘；quantity 非数值: many" and float(got[4].total_num) == 1000
    rep = imports.report(j).first()
    assert (rep.n_lines, rep.n_skipped, rep.n_warnings, rep.total_cents, rep.stated_cents, rep.agrees) == (2, 2, 1, 102000, 2001, False)
    bill = imports.bill(j, F.lit(7).cast("long"))
    after, counts = imports.imported(bill.filter("false"), bill)
    assert after.count() == 2 and [(c.n_imported, c.n_orphaned, c.n_anomalies, c.total_cents) for c in counts.collect()] == [(2, 0, 1, 102000)]
    again, counts = imports.imported(after.drop("change"), bill.filter("sequence = 1"))
    assert {x.change for x in again.collect()} == {"updated", "orphaned"} and counts.first().n_anomalies == 1
    assert {w.row for w in imports.warnings(j).collect()} == {4}


def test_merged_cells(spark):
    cells = spark.createDataFrame([("f", "s", 1, 1, "a"), ("f", "s", 2, 1, None), ("f", "s", 3, 1, "b")], "path string, sheet string, row int, at int, value string")
    ranges = spark.createDataFrame([("f", "s", 1, 2, 1, 2)], "path string, sheet string, first_row int, last_row int, first_at int, last_at int")
    got = {(r.row, r["at"]): r.value for r in imports.merged_cells(cells, ranges).collect()}
    assert got == {(1, 1): "a", (2, 1): "a", (1, 2): "a", (2, 2): "a", (3, 1): "b"}


def test_archive_and_search(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Bill.csv").write_text("x")
    (tmp_path / "in" / "copy.csv").write_text("x")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    folder = str(tmp_path / "archive")
    assert ingest.archive(spark, str(tmp_path / "in"), folder, now, "me").count() == 1
    assert ingest.archive(spark, str(tmp_path / "in"), folder, now, "me").count() == 0
    manifest = spark.read.parquet(f"{folder}/manifest")
    c = ingest.integrity_counts(ingest.integrity(manifest, ingest.archived_files(spark, folder))).first()
    assert (c.total, c.verified, c.mismatch, c.missing) == (1, 1, 0, 0)
    assert ingest.search_archive(manifest, filename=".CSV", operator="me").count() == 1 and ingest.search_archive(manifest, status="gone").count() == 0


def test_dictionary_and_prices(spark, tmp_path):
    rows = spark.createDataFrame([("I001", None, 1, "a"), ("I00101", "I001", 2, "b"), ("I0010101", None, 3, "c")], "code string, parent_code string, level int, name string")
    n = {r.code: r for r in ingest.load_dictionary(rows).collect()}
    assert n["I0010101"].parent_id == n["I00101"].id and (n["I0010101"].cat_l1, n["I0010101"].cat_l3) == ("a", "c") and n["I001"].parent_id is None
    (tmp_path / "w.json").write_text('{"sheets":[{"name":"p1","rows":[["h"],["s","pr","sub","1","c1","电缆","规格:4*16","m","2",{"f":"x","v":1.5},"3"],["s","pr","sub","2","","电缆","","m","2","1","2"],["s","pr","sub","3","c2","灯","","m","2","0","0"]]}]}')
    book = ingest.workbook(spark, str(tmp_path / "w.json"))
    got = ingest.load_prices(book).collect()
    assert [(r.price_period, r.item_code, r.unit_rate_cents, r.total_cents, r.match_key) for r in got] == [("p1", "c1", 150, 300, "std:电缆|4*16|m")]
    assert [(r.sheet, r.n_rows) for r in ingest.sheets(book).collect()] == [("p1", 4)]


def test_unmapped_headers(spark):
    m = spark.createDataFrame([("f", "h1", "item_name"), ("f", "h2", None)], "path string, header string, field string")
    assert [(r.problem, r.name) for r in mapping.mapping_problems(m).collect()] == [("unmapped", "h2")]


# --- analysis and search ---


def price_lines(spark, rows):
    columns = "id long, item_code string, item_code_version string, item_name string, item_feature string, std_name string, unit_rate_cents long, quantity long, price_period date, material_dict_id long, match_key_source string, data_source_type string, anomaly_flag string, active boolean"
    return spark.createDataFrame([(i, "030408001001", "2013", "电力电缆", "YJV 4*16", None, r, q, p, 1, "dict", "completed", "normal", True) for i, (r, q, p) in enumerate(rows)], columns)


def test_price_analysis_weights_and_dedup(spark):
    a = analysis.price_analysis(price_lines(spark, [(5000, 100, DAY), (5500, 200, DAY)]), F.lit(datetime.date(2026, 4, 1)))
    k = a.kpis.first()
    assert k.n == 2 and round(k.avg_rate / 100, 2) == 53.33
    a = analysis.price_analysis(price_lines(spark, [(5000, 100, DAY), (5000, 200, DAY), (5500, 300, DAY)]), F.lit(datetime.date(2026, 4, 1)), family="电线电缆")
    k = a.kpis.first()
    assert (k.n, k.avg_rate / 100, k.threshold) == (2, 53.75, 0.9)
    assert [(g.group_id, g.n, g.n_lines) for g in a.groups.collect()] == [("regex:电线电缆:YJV-4*16", 2, 3)] and a.gate.first().passes
    assert analysis.samples(a.pool, "电线电缆", "YJV-4*16").count() == 3


def test_price_analysis_falls_back_to_all_periods(spark):
    old = datetime.date(2020, 1, 1)
    today = F.lit(datetime.date(2026, 4, 1))
    assert analysis.pool(price_lines(spark, [(5000 + i, 1, DAY) for i in range(5)] + [(9000 + i, 1, old) for i in range(5)]), today).count() == 5
    two = price_lines(spark, [(5000 + i, 1, DAY) for i in range(2)] + [(9000 + i, 1, old) for i in range(5)])
    assert analysis.pool(two, today).count() == 7 and analysis.pool(two, today, fall_back=False).count() == 2


def test_pages(spark):
    df = spark.createDataFrame([(i, i % 3, i, f"n{i}", None if i % 2 else "s") for i in range(10)], "id long, import_batch_id long, sequence long, item_name string, std_name string")
    rows = search.page(df, 99, 4).collect()
    assert [r.id for r in rows] == [6, 9] and rows[0].page == 3 and rows[0].total == 10
    assert [r.id for r in search.page(df, 0, 4).collect()] == [2, 5, 8, 1]
    assert search.page(df.filter("false"), 5, 4).count() == 0


def test_short_searches_fall_back_to_similar_names(spark):
    df = spark.createDataFrame([(1, "配电箱安装", None, None, None), (2, "配电箱体", None, None, None), (3, "阀门", None, None, None)], "id long, item_name string, item_feature string, item_code string, std_name string")
    got = {r.id: r.similarity for r in search.search(df, "配电箱安").collect()}
    assert got[1] is None and 0.2 <= got[2] < 1 and 3 not in got
    assert {r.id for r in search.search(df, "配电箱 安装").collect()} == {1}


# --- dictionary upkeep ---


def test_change_sets(spark):
    nodes = spark.createDataFrame([(1, None, "l1", "a"), (2, 1, "l2", "b"), (3, 1, "l2", "c")], "id long, parent_id long, level string, name string")
    changes = spark.createDataFrame(
        [(1, "create", None, 1, "l2", "d"), (2, "create", None, 1, "l2", "d"), (3, "create", None, 2, "l2", "x"), (4, "update", 2, 1, "l2", "c"), (5, "delete", 1, None, None, None), (6, "delete", 3, None, None, None), (7, "delete", 9, None, None, None), (8, "update", 2, 1, "l2", "b")],
        "change_id long, action string, id long, parent_id long, level string, name string",
    )
    got = {(r.problem, r.change_id) for r in tree.change_problems(changes, nodes, spark.createDataFrame([(3,)], "dict_id long")).collect()}
    assert got == {("same_name", 2), ("no_parent", 3), ("same_name", 4), ("has_children", 5), ("in_use", 6), ("no_node", 7)}


def test_codes_are_filled_and_backfilled(spark):
    nodes = spark.createDataFrame([(1, None, "l1", "a", "I001"), (2, 1, "l2", "b", "I00101"), (3, 2, "l3", "c", None), (4, 2, "l3", "d", "I0010104"), (5, 3, "l4", "e", None)], "id long, parent_id long, level string, name string, code string")
    assert {r.id: r.code for r in tree.fill_codes(nodes).collect()} == {1: "I001", 2: "I00101", 3: "I0010105", 4: "I0010104", 5: "I0010105001"}
    other = nodes.withColumn("id", F.col("id") + 100).withColumn("parent_id", F.col("parent_id") + 100)
    assert {r.id: r.code for r in tree.backfill_codes(nodes.drop("code"), other).collect()} == {1: "I001", 2: "I00101", 3: None, 4: "I0010104", 5: None}
    assert {r.check for r in tree.checks(nodes.filter("id <> 3 AND id <> 5").withColumn("code", F.when(F.col("id") == 4, "I0990101").otherwise(F.col("code")))).collect()} == {"code_prefix"}
    loop = spark.createDataFrame([(1, 2, "l1"), (2, 1, "l2"), (3, None, "l9")], "id long, parent_id long, level string")
    assert {r.id: r.new_level for r in tree.relevelled(loop).collect()} == {1: None, 2: None, 3: "l1"}


def test_links_are_repaired_by_name(spark):
    items = spark.createDataFrame([(1, 5, "x"), (2, 99, "x"), (3, None, "none")], "id long, material_dict_id long, std_name string")
    nodes = spark.createDataFrame([(5, "l3", "x"), (7, "l4", "x"), (6, "l4", "x")], "id long, level string, name string")
    assert {r.id: r.material_dict_id for r in tree.repaired_links(items, nodes).collect()} == {1: 5, 2: 6, 3: None}


def test_a_page_of_children(spark):
    nodes = spark.createDataFrame([(1, None, "l1", "a"), *[(i, 1, "l2", f"n{i}") for i in range(2, 7)], (9, 3, "l3", "z")], "id long, parent_id long, level string, name string")
    got = [(r.id, r.has_child, r.has_more) for r in tree.children_page(nodes, 1, 0, 3).collect()]
    assert got == [(2, False, True), (3, True, True), (4, False, True)]
    assert [(r.id, r.has_more) for r in tree.children_page(nodes, 1, 3, 3).collect()] == [(5, False), (6, False)]


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, i, f"n,{i}\n\"x\"", True) for i in range(5)], "import_batch_id long, sequence long, item_name string, active boolean")
    assert ingest.snapshot(df, 1, f"{tmp_path}/s") == 5
    ingest.export(df, f"{tmp_path}/e", labels=True)
    assert spark.read.csv(f"{tmp_path}/e", header=True).columns == ["批次", "序号", "项目名称"]
    with pytest.raises(ValueError):
        ingest.export(df, f"{tmp_path}/x", ask_above=3)
