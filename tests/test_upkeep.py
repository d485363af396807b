"""Pages, bookmarks, files of the dictionary and the mapping, statistics by ranges, global order of the learner, streams of imports and matches."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from boqspark.functions import text
from boqspark.operators import analysis, learning, matching, pricing, quality, search, similarity, tree
from boqspark.sources import ingest
from boqspark.streaming import streams

DAY = datetime.date(2026, 3, 1)


def test_bookmarks_and_pages(spark):
    items = spark.createDataFrame([(i, f"b{i}", i % 2, 10 - i, i != 3) for i in range(6)], "id long, biz_id string, import_batch_id int, sequence long, active boolean")
    marks = spark.createDataFrame([(1, 4, DAY), (1, 2, DAY + datetime.timedelta(1)), (2, 5, DAY)], "user_id int, item_id long, created_at date")
    assert [r.id for r in search.favourites(items, marks, 1).collect()] == [2, 4]
    assert search.is_favourite(marks, 2, 5) and not search.is_favourite(marks, 2, 4)
    assert [r.id for r in search.item(items, "b3").collect()] == [3] and search.item(items, "zz").isEmpty()
    assert [r.id for r in search.first_items(items, 1, 2).collect()] == [5, 1]
    audit = spark.createDataFrame([(DAY, "a"), (DAY, "b"), (DAY + datetime.timedelta(1), "c")], "ts date, trace_id string")
    assert [r.trace_id for r in search.audit_page(audit, 1, 2).collect()] == ["c", "b"] and [r.trace_id for r in search.audit_page(audit, 2, 2).collect()] == ["a"]


def test_parents_and_levels_by_code(spark):
    nodes = spark.createDataFrame([(1, None, "l9", "I001"), (2, 7, "l9", "I00101"), (3, 7, "l9", None), (4, 1, "l9", "I00999")], "id long, parent_id long, level string, code string")
    got = {r.id: (r.parent_id, r.level) for r in tree.reparented(nodes).collect()}
    assert got == {1: (None, "l1"), 2: (1, "l2"), 3: (7, "l9"), 4: (1, "l2")}


def test_sure_matches_and_newest(spark):
    top = spark.createDataFrame([("a", 1, 95.0), ("a", 2, 79.0), ("b", 1, 95.0), ("b", 2, 80.0), ("c", 1, 90.0), ("d", 1, 89.9)], "item string, rank int, score double")
    assert {r.item: r.sure for r in similarity.high_confidence(top, "item").collect()} == {"a": True, "b": False, "c": True, "d": False}
    rows = spark.createDataFrame([(1, DAY), (2, None), (3, DAY + datetime.timedelta(1)), (4, DAY)], "id int, price_period date")
    assert [r.id for r in analysis.newest(rows, 3).collect()] == [3, 1, 4] and analysis.newest(rows, None).count() == 4
    groups = spark.createDataFrame([("a", -9.0), ("b", 3.0), ("c", 9.0)], "group_id string, deviation double")
    assert [r.group_id for r in analysis.top_groups(groups, 2).collect()] == ["a", "c"]


def test_catalog_keeps_what_people_wrote(spark):
    old = spark.createDataFrame([("k1", 1.0, "mine"), ("k2", 2.0, ""), (None, 5.0, None)], "match_key string, avg_rate double, note string")
    new = spark.createDataFrame([("k1", 10.0, "new"), ("k2", 20.0, "new"), ("k3", 30.0, None), (None, 50.0, "n")], "match_key string, avg_rate double, note string")
    got = {r.match_key: (r.avg_rate, r.note) for r in quality.merge_catalog(old, new, ["note"]).collect()}
    assert got == {"k1": (10.0, "mine"), "k2": (20.0, "new"), "k3": (30.0, None), None: (50.0, "n")}


def test_retention_and_mapping_files(spark, tmp_path):
    manifest = spark.createDataFrame([("a", datetime.datetime(2026, 1, 1)), ("b", datetime.datetime(2026, 2, 20))], "sha256 string, archived_at timestamp")
    today = F.lit(DAY)
    assert [r.sha256 for r in ingest.expired(manifest, today, 30).collect()] == ["a"] and ingest.expired(manifest, today, 0).isEmpty()
    rows = lambda *r: spark.createDataFrame(list(r), "code string, name string, match_type string, similarity string")
    m = ingest.load_mapping({"2013": rows(("03040800", "x", "exact", "1"), ("030408001001", "y", "fuzzy", "0.8")), "2024": rows(("030409001", "z", "exact", None))})
    assert {(r.version, r.code9, r.name, r.similarity) for r in m.collect()} == {("2013", "030408000", "x", 1.0), ("2013", "030408001", "y", 0.8), ("2024", "030409001", "z", None)}
    ingest.export_mapping(m, str(tmp_path / "m"))
    assert spark.read.csv(str(tmp_path / "m"), header=True).count() == 3
    classes = lambda *r: spark.createDataFrame(list(r), "version string, code string, section string, name string")
    both = ingest.full_mapping([classes(("2013", "010502001", "0105", "柱")), classes(("2013", "010502001", "0304", "x"), ("2013", "030408001", "0304", "电缆"))])
    assert both.filter("code9 = '010502001'").count() <= 1


def test_exact_summary_words(spark):
    said = spark.createDataFrame([("合计",), ("本页合计",), (" 总计 ",)], "x string").select(text.is_summary_exact(F.col("x")).alias("y")).collect()
    assert [r.y for r in said] == [True, False, True]


def test_trend_of_weights(spark):
    rows = spark.createDataFrame([("c", i, i) for i in range(15)] + [("d", 1, 1)], "category string, ts int, id int")
    got = learning.trend(rows, 10).collect()
    assert sorted(r.id for r in got if r.category == "c") == list(range(5, 15)) and next(r.back for r in got if r.category == "c" and r.id == 14) == 1


# --- statistics by ranges ---


def quantile_rows(rng):
    """Keys with many rates, few, equal, huge, negative and none."""
    many = [("m", rng.randrange(10**9), 1) for _ in range(3000)] + [("e", 77, 1)] * 50 + [("n", -rng.randrange(5000), 1) for _ in range(40)]
    return many + [("s", v, 1) for v in (10, 11, 12, 13, 14, 15, 16, 1000)] + [(None, 5, 2), (None, 6, 1), ("z", None, 1)]


def test_places_are_found_by_ranges(spark):
    rng = random.Random(2)
    rows = quantile_rows(rng)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, k string, unit_rate_cents long, quantity long").repartition(4)
    got = {r.k: r for r in pricing.index_quantiles(df, "k").collect()}
    kpi = {r.k: r for r in pricing.kpis(df, "k").collect()}
    summary = {r.k: r for r in pricing.summary_rows(df, "k").collect()}
    groups = {r.k: r for r in pricing.group_prices(df, "k").collect()}
    for k in ("m", "e", "n", "s", None):
        v = sorted(r for key, r, _ in rows if key == k)
        n = len(v)
        want = [v[i * n // 4] for i in (1, 2, 3)] if n >= 4 else [None] * 3
        assert [got[k].q1, got[k].q2, got[k].q3] == want and got[k].n == n
        kept = v if n < 8 else [x for x in v if want[0] - 3 * (want[2] - want[0]) <= x <= want[2] + 3 * (want[2] - want[0])]
        m = len(kept)
        assert (kpi[k].n, kpi[k].n_outliers, kpi[k].min_rate, kpi[k].max_rate) == (m, n - m, kept[0], kept[-1])
        if m >= 4:
            assert [kpi[k].q1, kpi[k].q2, kpi[k].q3] == [kept[i * m // 4] for i in (1, 2, 3)]
        assert summary[k].median == v[round(0.5 * (n - 1))] and (groups[k].min_rate, groups[k].max_rate, groups[k].n) == (v[0], v[-1], n)
        odd = sum(abs(x - kpi[k].avg_rate) > 0.3 * abs(kpi[k].avg_rate) for x in kept)
        assert kpi[k].n_anomalies == (odd if m >= 3 else 0)
    assert (groups["z"].n, groups["z"].avg_rate) == (0, 0) and "z" not in kpi
    whole = pricing.kpis(df.filter("k = 's'")).collect()
    assert len(whole) == 1 and whole[0].n == 7
    r = spark.createDataFrame([(x,) for x in sorted(rng.randrange(-(10**12), 10**12) for _ in range(500)) + list(range(-300, 900))], "x long").orderBy("x").select(pricing._range(F.col("x")).alias("r")).collect()
    assert [x.r for x in r] == sorted(x.r for x in r)


# --- the learner over all categories ---


def test_global_order(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("abc"), datetime.datetime(2026, 1, 1) + datetime.timedelta(minutes=rng.randrange(3000)), rng.randrange(2), 1 if rng.random() < 0.1 else None) for i in range(700)]
    e = spark.createDataFrame(rows, "id long, category string, ts timestamp, hit int, rejected int").repartition(5)
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    counted = {r.id: r.n for r in learning.running(e, F.col("rejected").isNull().cast("int"), "n").collect()}
    n, share, want, hits = 0, learning.FUSION_START, {}, []
    for i, _, _, hit, rejected in order:
        n += rejected is None
        assert counted[i] == n
        hits.append(hit)
        if len(hits) >= 20:
            share = 0.9 * share + 0.1 * (0.5 + 0.4 * sum(hits[-20:]) / 20)
        want[i] = share
    for chunk in (64, 100_000):
        got = {r.id: r.fusion for r in learning.fusion(e.drop("category"), chunk).collect()}
        assert set(got) == set(want) and all(abs(got[i] - want[i]) < 1e-9 for i in want)
    each = e.withColumns({f"{a}_hit": F.col("hit") for a in learning.ALGORITHMS})
    out = {r.category: r for r in learning.replay(each, overall=True).collect()}
    states, n = {}, 0
    for _, category, _, hit, rejected in order:
        n += rejected is None
        w = states.setdefault(category, learning.Weights())
        w.reject(rejected, n) if rejected is not None else w.confirm([bool(hit)] * 3, None, None, 0.5, n)
    assert all((out[c].edit, out[c].tfidf, out[c].vector) == tuple(w.values) for c, w in states.items())


# --- streams ---


def bill_file(path, rows):
    path.write_text("项目编码,项目名称,计量单位,工程量,综合单价,合价\n" + "".join(f"{code},{name},m2,{q},7,{7 * q}\n" for code, name, q in rows), encoding="utf-8")


def test_import_stream_is_exactly_once(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    bill_file(source / "a.csv", [("030408001", "cable", 1), ("030408002", "wire", 2), ("030408003", "rod", 3)])
    bill_file(source / "b.csv", [("031001001", "pipe", 5)])
    run = lambda: streams.import_files(spark, str(source), table, str(tmp_path / "check"), 8).awaitTermination()
    run()
    first = {r.path: r for r in streams.import_batches(spark, table).collect()}
    assert {k: (r.n_lines, r.n_imported, r.n_orphaned, r.n, r.total_cents) for k, r in first.items()} == {"a.csv": (3, 3, 0, 3, 4200), "b.csv": (1, 1, 0, 1, 3500)}
    bill_file(source / "again.csv", [("031001001", "pipe", 5)])  # the content of b.csv
    run()
    assert {r.path for r in streams.import_batches(spark, table).collect()} == {"a.csv", "b.csv"}
    sub = tmp_path / "next"
    sub.mkdir()
    bill_file(sub / "a.csv", [("030408001", "cable", 9), ("030408002", "wire", 2)])
    files = spark.read.format("binaryFile").load(str(sub))
    number = streams.load_files(files, table)
    lines = lambda: sorted((r.sequence, r.item_name, r.quantity, r.active) for r in streams.import_lines(spark, table).collect() if r.item_name != "pipe")
    after, batch = lines(), {r.path: r for r in streams.import_batches(spark, table).collect()}
    assert after == [(2, "cable", 9.0, True), (3, "wire", 2.0, True), (4, "rod", 3.0, False)]
    assert (batch["a.csv"].n_lines, batch["a.csv"].n_orphaned, batch["a.csv"].n, batch["a.csv"].load) == (2, 1, 2, number) and batch["b.csv"] == first["b.csv"]
    assert batch["a.csv"].checksum != first["a.csv"].checksum
    streams.load(files, table, number)  # the load is run again: nothing changes
    assert lines() == after and {r.path: r for r in streams.import_batches(spark, table).collect()} == batch
    for p in (tmp_path / f"table/batches/load={number}").glob("*"):
        p.unlink()  # it failed before its rows were there
    (tmp_path / f"table/batches/load={number}").rmdir()
    assert [x[3] for x in lines()] == [True] * 3
    streams.load(files, table, number)
    assert lines() == after and {r.path: r for r in streams.import_batches(spark, table).collect()} == batch


def test_matches_use_what_the_stream_has_learned(spark, tmp_path):
    rng = random.Random(6)
    names = ["".join(rng.choice("电力缆线箱管钢阀") for _ in range(rng.randint(2, 5))) for _ in range(60)]
    pool = spark.createDataFrame([(i, "l4", n, n, f"a/{n}") for i, n in enumerate(names)], "dict_id long, level string, name string, spec string, path string")
    ts = datetime.datetime(2026, 1, 1)
    e = spark.createDataFrame([("材料/电缆", ts, i, 0, 0, 1) for i in range(40)], "category string, ts timestamp, id long, edit_hit int, tfidf_hit int, vector_hit int")
    e.write.parquet(str(tmp_path / "events"))
    learned = streams.learn(spark.readStream.schema(e.schema).parquet(str(tmp_path / "events")))
    streams.learned_to(learned, str(tmp_path / "weights"), str(tmp_path / "c1")).awaitTermination()
    now, want = streams.learned(spark, str(tmp_path / "weights")).collect(), learning.replay(e).collect()
    assert [(r.category, r.n, r.edit, r.vector) for r in now] == [(r.category, r.n, r.edit, r.vector) for r in want]
    items = spark.createDataFrame([(i, n[1:] + "x", "", "材料/电缆/x", True, None) for i, n in enumerate(names[:8])], "id long, name string, spec string, path string, active boolean, material_dict_id long")
    items.write.parquet(str(tmp_path / "items"))
    rows = spark.readStream.schema(items.schema).parquet(str(tmp_path / "items"))
    streams.match_to(rows, pool, str(tmp_path / "weights"), str(tmp_path / "out"), str(tmp_path / "c2")).awaitTermination()
    got = {r.id: [(c.dict_id, c.score) for c in r.candidates] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.id: [(c.dict_id, c.score) for c in r.candidates] for r in matching.prematch(items, pool, learned=learning.replay(e)).collect()}
    assert got == batch and got != {r.id: [(c.dict_id, c.score) for c in r.candidates] for r in matching.prematch(items, pool).collect()}


def test_permits_nothing_to_hide():
    with pytest.raises(ValueError, match="below 80"):
        similarity.near_pairs(None, None, "a", "b", 70)


def test_import_writes_little_beside_the_table(spark, tmp_path):
    import os

    from boqspark.shared import shared_dir

    source = tmp_path / "in"
    source.mkdir()
    for name in range(2):
        lines = [f"{i * 7 % 99991:09d},part {i % 100},m2,{i % 50},7,{i % 50 * 7}" for i in range(20_000)]
        (source / f"{name}.csv").write_text("\n".join(["项目编码,项目名称,计量单位,工程量,综合单价,合价", *lines[name:]]))
    base = shared_dir(spark).removeprefix("file:").replace("//", "/")
    held = lambda: sum(os.path.getsize(os.path.join(r, x)) for r, _, names in os.walk(base) for x in names)
    before, table = held(), str(tmp_path / "table")
    streams.load_files(spark.read.format("binaryFile").load(str(source)), table)
    assert sorted(r["n_lines"] for r in streams.import_batches(spark, table).collect()) == [19_999, 20_000]
    written, size = held() - before, sum(f.stat().st_size for f in source.iterdir())
    assert written < 3 * size
